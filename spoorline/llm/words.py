"""Vectorised words over Arrow text columns.

A batch of texts is one byte buffer and one offset array. Words are found by a byte class, and each
word gets a 64-bit hash from a prefix sum, so a batch costs a few NumPy passes and no Python object
per word. Texts are cut between rows into slices of bounded bytes, so the working memory follows the
slice (or one single longer text), not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(size, factor, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordClass:
    """Which bytes belong to words, and how bytes are folded before hashing.

    All bytes of a non-ASCII character are treated alike, so a class over ASCII plus "everything
    else" is exact on UTF-8.
    """

    def __init__(self, separators: bytes, fold: bool = True, seed: int = 1):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        code = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed) * _BASE)
        if fold:
            code[65:91] = code[97:123]
        self.code = code


#: `[^\x20\x09-\x0D]+`
SPACED = WordClass(bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding A-Z
ALNUM = WordClass(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words:
    """Words of consecutive texts: hash, byte span, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: WordClass):
        inside = kind.inside[data]
        n = len(data)
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = ~inside[:-1]
        fresh[bounds] = True
        self.start = np.flatnonzero(inside & fresh[:n])
        last = np.ones(n, bool)
        last[: n - 1] = ~inside[1:] | fresh[1:n] & False
        edge = bounds[(bounds > 0) & (bounds <= n)]
        last[edge - 1] = True
        self.end = np.flatnonzero(inside & last) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(kind.code[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:  # a null may span bytes that belong to no text
        texts = texts.fill_null("")
        return buffers(texts)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[raw[0] : raw[-1]], raw - raw[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def each_slice(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) for bounded slices of a batch."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    for low, high in slices(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


_WEIGHTS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out += words[i : n - size + 1 + i] * _WEIGHTS[i]
    out = mix(out)
    out.sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def arrow_map(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow from one that takes a batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return run
