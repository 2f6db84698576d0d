"""Token ids in compressed binary files.

**Ids.** The tokenizers library splits a text into pre-tokens and encodes each on its own, so each
distinct pre-token is encoded by the library once per worker and remembered within bounds; texts are
cut into pre-tokens by character class, a slice at a time. The added tokens of the tokenizer file are
cut out before that, as the library does, and have their own ids.

**Coder.** A block of ids is coded on its own: two tables of the block predict the next id from the
last one (order 1) and the last two (order 2), with a confidence per entry; adaptive success rates
per confidence mix them with the order-0 distribution of the file, which is in its header; the mixed
probabilities drive a range coder. All blocks of a file are coded in step, one array
operation for all of them, and each has the crc32 of its ids.

**File.** magic, a JSON header, the order-0 counts and the document index (deflated), the block table,
then the block bodies as 16-bit words; all numbers little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoorline.llm.store import kept, place
from spoorline.llm.words import _power, each_slice, mix

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MAGIC = b"SPIDS001"


@dataclass(frozen=True)
class FileParameters:
    """``block`` ids are coded on their own; a file ends at the first document after ``file_ids`` ids."""

    block: int = 512
    file_ids: int = 1 << 21
    remembered: int = 1_500_000


# --- ids ---

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: Code points of the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the pattern's contractions


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(class, hash code) of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    kind = np.array([first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    kind[_WHITE] = WHITE
    return kind, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x5EED))


def pretoken_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First code point of every pre-token of the texts between ``bounds``.

    The pattern: contractions; an optional space and letters, or numbers, or other characters; white
    space but for its last character where text follows; white space.
    """
    n = len(points)
    kind = _characters()[0][points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~edge[1:n]) if n > 1 else np.zeros(0, int)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & start[:n] & start[1:]) if n else np.zeros(0, int)
    # An opening space keeps the quote out of `start`; a run of other characters has no start after it.
    for ending in _ENDINGS:
        size = len(ending)
        at = quote[quote + size < n]
        good = np.ones(len(at), bool)
        for k, c in enumerate(ending, 1):
            good &= (points[at + k] == ord(c)) & ~edge[at + k]
        at = at[good]
        start[at + 1] = False
        start[at + 1 + size] = True
    return np.flatnonzero(start[:n])


def _byte_letters() -> np.ndarray:
    """The letter that byte-level models write for each byte: itself if printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return np.array([b if b in own else next(others) for b in range(256)], "<u2")


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens of a tokenizer file; such a token is one id wherever it stands."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    for token in tokens:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added token {token['content']!r} takes in its surroundings")
    return tuple((t["content"], t["id"]) for t in tokens)


class Remembered:
    """Numbers from 0 for 64-bit hashes, in an open table of NumPy arrays: a batch costs a few gathers."""

    def __init__(self, room: int):
        slots = 1 << (2 * room).bit_length()
        self.mask = slots - 1
        self.keys, self.numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.count = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = hashes.view(np.int64) & self.mask
        out = self.numbers.take(at)
        other = np.flatnonzero((self.keys.take(at) != hashes) & (out >= 0))
        at, wanted = at[other], hashes[other]
        while len(other):
            at = (at + 1) & self.mask
            out[other] = found = self.numbers.take(at)
            on = (self.keys.take(at) != wanted) & (found >= 0)
            other, at, wanted = other[on], at[on], wanted[on]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number hashes that differ from each other and from all that have a number."""
        numbers = np.arange(self.count, self.count + len(hashes), dtype=np.int32)
        self.count += len(hashes)
        at = hashes.view(np.int64) & self.mask
        while len(at):
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[free]
            mine = self.numbers[at] == numbers  # one of those that meet in a place
            self.keys[at[mine]] = hashes[mine]
            at, numbers, hashes = (at[~mine] + 1) & self.mask, numbers[~mine], hashes[~mine]


class IdEncoder:
    """Ids of texts by a tokenizer file; remembers the ids of pre-tokens.

    ``added`` are the tokens to cut out first; without them their strings are ordinary text.

    The library's model encodes a pre-token written in byte letters; its whole pipeline would cut
    the pre-token out again and keep offsets that nobody reads.
    """

    def __init__(self, path: str, remembered: int, added: tuple[tuple[str, int], ...] = ()):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path).model
        self.added = dict(added)
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest)))
        self.letters = _byte_letters()
        self.remembered = remembered
        self.forget(remembered)

    def forget(self, room: int) -> None:
        self.place = Remembered(room)
        self.first = np.zeros(room + 1, np.int64)
        self.flat = np.zeros(4 * room, np.uint16)

    def _added_at(self, text: str, edges: np.ndarray) -> np.ndarray:
        """First code point and end of every added token, one after the other; none reaches over an edge."""
        if not any(a in text for a in self.added):
            return np.zeros(0, np.int64)
        ends = edges.tolist()
        found = (m.span() for low, high in pairwise(ends) for m in self.cut.finditer(text, low, high))
        return np.fromiter(chain.from_iterable(found), np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode and remember words that have no place yet."""
        # The byte 0xFF is in no UTF-8 text, so its letter separates words.
        raw = np.frombuffer(b"\xff".join(map(str.encode, words)), np.uint8)
        letters = self.letters.take(raw).tobytes().decode("utf-16-le").split(chr(self.letters[0xFF]))
        ids: list[int] = []
        ends = []
        # Every added token was cut out, so a pre-token that equals one is one.
        added = {w: i for w, i in self.added.items() if w in words}
        for w, x in zip(words, letters, strict=True):
            if w in added:
                ids.append(added[w])
            else:
                ids += [t.id for t in self.model.tokenize(x)]
            ends.append(len(ids))
        known = self.place.count
        self.place.add(hashes)
        ends = self.first[known] + np.array(ends)
        self.first[known + 1 : known + 1 + len(ends)] = ends
        if ends[-1] > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(ends[-1], np.uint16)]
        self.flat[self.first[known] : ends[-1]] = ids

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids) of UTF-8 bytes."""
        text = data.tobytes().decode("utf-8", "replace")
        if text.isascii():
            points, edges = data, bounds
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            edges = bounds - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), bounds)
        tokens = self._added_at(text, edges)
        starts = pretoken_starts(points, np.r_[edges, tokens] if len(tokens) else edges)
        if len(tokens):  # a start strictly inside an added token follows its first code point only
            inside = np.searchsorted(tokens, starts, "right") % 2 == 1
            starts = starts[~inside | np.isin(starts, tokens[::2])]
        n = len(points)
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_characters()[1].take(points) * up[:n], out=sums[1:])
        ends = np.append(starts[1:], n)
        bits = sums.take(np.append(starts, n))
        hashes = mix((bits[1:] - bits[:-1]) * down.take(starts))
        token = self.place.find(hashes)
        fresh = np.flatnonzero(token < 0)
        if len(fresh):
            unique, sample = np.unique(hashes[fresh], return_index=True)
            if self.place.count + len(unique) > self.remembered:
                unique, sample = np.unique(hashes, return_index=True)
                fresh = np.arange(len(hashes))
                self.forget(max(self.remembered, len(unique)))
            sample = fresh[sample]
            spans = zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)
            self._learn(unique, [text[low:high] for low, high in spans])
            token[fresh] = self.place.find(hashes[fresh])
        begin = self.first.take(token)
        sizes = self.first.take(token + 1) - begin
        upto = np.r_[0, np.cumsum(sizes)]
        ids = self.flat.take(np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1]))
        return ids, upto[np.searchsorted(starts, edges[1:])]


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int) -> IdEncoder:
    return IdEncoder(path, remembered, added_tokens(path))


# --- coder ---

_BITS0 = 20  # order-0 frequencies sum to 2**20
_WEIGHT = 12  # mixing weights sum to 2**12
_LEAST = np.uint64(1 << 48)
_SLOTS = 256
_NONE = 0xFFFF  # no prediction yet
_STARTING = (256, 700, 1400, 2000)  # success rates out of 2**12, by confidence


def order0(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies with sum 2**20, their running sums); every id that occurs has one at least."""
    total = 1 << _BITS0
    here = counts > 0
    spare = total - int(here.sum())
    freq = np.where(here, 1 + counts * spare // max(1, int(counts.sum())), 0).astype(np.int64)
    freq[int(np.argmax(counts))] += total - int(freq.sum())
    return freq, np.r_[0, np.cumsum(freq)]


class Mixer:
    """The predictions of all blocks at one step, and their adaptive mixing.

    A table entry holds a predicted id and its confidence from 0 to 3. The two rates together stay
    below 2**12, so order 0 always has some weight, and above 0. Row 0 of every array is order 2, row 1
    order 1; the arrays are made once and filled at each step, and choices are products with 0 or 1.
    """

    def __init__(self, blocks: int, freq: np.ndarray, below: np.ndarray):
        both = (2, blocks)
        self.cells = 4 * np.arange(2 * blocks).reshape(both)
        # Slot by slot, so that the slots of frequent ids stand together for all blocks.
        self.base = np.array([[0], [_SLOTS * blocks]]) + np.arange(blocks)
        self.table = np.full(2 * blocks * _SLOTS, _NONE << 2, np.int32)
        self.rate = np.tile(np.array(_STARTING, np.int32), 2 * blocks)
        self.slot, self.cell = self.base.copy(), self.cells.copy()
        self.entry, self.guess, self.trust, self.old, self.weight, self.hit, self.work = np.zeros((7, *both), np.int32)
        self.contexts = np.zeros(both, np.uint32)
        self.before, self.one = self.contexts
        self.miss, self.left = np.zeros((2, blocks), np.int32)
        # Two 32-bit halves of one 64-bit number: sizes below, starts above.
        self.ranges = (below[:-1].astype(np.uint64) << np.uint64(32)) | freq.astype(np.uint64)
        self.halves = np.zeros((2, blocks, 2), np.int32)
        self.known, self.rest = self.halves.view(np.uint64)[..., 0]
        self.zero = np.zeros(blocks, np.uint64)
        self.start, self.size = np.zeros((2, blocks), np.uint64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, weights) of order 2 and order 1; order 0 has what is left of 2**12."""
        self.table.take(self.slot, out=self.entry, mode="clip")
        np.right_shift(self.entry, 2, out=self.guess)
        np.bitwise_and(self.entry, 3, out=self.trust)
        np.add(self.cells, self.trust, out=self.cell)
        self.rate.take(self.cell, out=self.old, mode="clip")
        self.weight[0] = self.old[0]
        np.not_equal(self.guess[0], self.guess[1], out=self.miss)
        np.multiply(self.old[1], self.miss, out=self.weight[1])
        np.subtract(1 << _WEIGHT, self.weight[0], out=self.left)
        np.subtract(self.left, self.weight[1], out=self.left)
        return self.guess, self.weight

    def ranged(self, hit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) out of 2**32 of each id; ``hit`` tells with 0 or 1 by which order it is coded."""
        used, above = np.multiply(hit, self.weight, out=self.work)
        np.add(used, above, out=self.halves[0, :, 0])
        np.equal(self.halves[0, :, 0], 0, out=self.miss)
        np.multiply(self.left, self.miss, out=self.halves[1, :, 0])
        np.subtract(self.weight[0], used, out=used)
        np.multiply(self.weight[1], self.miss, out=above)
        np.add(used, above, out=self.halves[0, :, 1])
        self.ranges.take(ids, out=self.start, mode="clip")
        np.multiply(self.start, self.rest, out=self.start)
        np.left_shift(self.known, np.uint64(_BITS0), out=self.size)
        np.add(self.start, self.size, out=self.size)
        np.right_shift(self.size, np.uint64(32), out=self.start)
        np.bitwise_and(self.size, np.uint64(0xFFFFFFFF), out=self.size)
        return self.start, self.size

    def update(self, small: np.ndarray, hit: np.ndarray) -> None:
        """``small`` holds the ids as 32-bit numbers; ``hit`` tells which orders predicted them."""
        work = self.work
        np.multiply(hit, 1976, out=work)
        work += 24
        work -= self.old
        work >>= 4
        work += self.old
        self.rate[self.cell] = work
        np.add(self.trust, 1, out=work)
        np.minimum(work, 3, out=work)
        work *= hit
        work += small << 2
        self.table[self.slot] = work
        ids = small.view(np.uint32)
        np.multiply(ids, np.uint32(40503), out=self.one)
        self.before += self.one
        self.before >>= np.uint32(3)
        self.one >>= np.uint32(4)
        self.contexts &= np.uint32(_SLOTS - 1)
        self.contexts *= np.uint32(len(self.one))
        np.add(self.base, self.contexts, out=self.slot)
        np.multiply(ids, np.uint32(60493), out=self.before)


def encode_blocks(ids: np.ndarray, block: int, freq: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words, words of each block) of blocks of ``block`` ids; the last one is filled up with its last id.

    A step notes the upper half of ``low`` and how many words of it go out; words and carries are
    gathered from the notes when all steps are done.
    """
    blocks = -(-len(ids) // block)
    grid = np.full(blocks * block, ids[-1], np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, (1 << 64) - 1, np.uint64)
    unit, shift = np.zeros((2, blocks), np.uint64)
    high = np.zeros((block + 2, blocks), np.uint32)
    sent = np.full((block + 2, blocks), 2, np.uint8)
    carried = np.zeros((block + 2, blocks), bool)
    few, fewer = np.zeros((2, blocks), bool)
    mixer = Mixer(blocks, freq, below)
    for t, small in enumerate(grid):
        guess, _ = mixer.predict()
        hit = np.equal(guess, small, out=mixer.hit)
        start, size = mixer.ranged(hit, small)
        np.right_shift(span, np.uint64(32), out=unit)
        np.multiply(unit, start, out=start)
        np.add(low, start, out=low)
        np.less(low, start, out=carried[t])
        np.multiply(unit, size, out=span)
        high[t] = low.view(np.uint32)[1::2]
        np.less(span, _LEAST, out=few)
        np.less(span, _LEAST >> np.uint64(16), out=fewer)
        np.add(few.view(np.uint8), fewer.view(np.uint8), out=sent[t])
        np.multiply(sent[t], np.uint64(16), out=shift)
        np.left_shift(low, shift, out=low)
        np.left_shift(span, shift, out=span)
        mixer.update(small, hit)
    high[block], high[block + 1] = low >> np.uint64(32), low
    upto = np.cumsum(sent, axis=0, dtype=np.uint16 if block < 1 << 14 else np.int64)
    sizes = upto[-1].astype(np.int64)
    step, column = np.nonzero(carried)
    over = (np.cumsum(sizes) - sizes)[column] + upto[step - 1, column] - 1  # the last word sent before the step
    high, sent = np.ascontiguousarray(high.T), np.ascontiguousarray(sent.T)
    there = np.stack([sent > 0, sent > 1], axis=-1)
    words = ((high << np.uint32(16)) | (high >> np.uint32(16))).view(np.uint16).reshape(there.shape)[there]
    while len(over):  # a word that was full hands the carry on
        words[over] += 1
        over = over[words[over] == 0] - 1
    return words, sizes


def decode_blocks(
    words: np.ndarray, sizes: np.ndarray, count: int, block: int, freq: np.ndarray, below: np.ndarray
) -> np.ndarray:
    """The ``count`` ids of blocks whose words stand one after the other."""
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
    # Damaged words must not lead beyond the end; the checksum tells.
    padded = np.r_[words, np.zeros(8, np.uint16)].astype(np.uint32)
    ahead = (padded[:-1] << np.uint32(16)) | padded[1:]
    blocks, first = len(sizes), np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    at = first + 4
    code = (ahead.take(first, mode="clip").astype(np.uint64) << np.uint64(32)) | ahead.take(first + 2, mode="clip")
    span = np.full(blocks, (1 << 64) - 1, np.uint64)
    unit, shift, value = np.zeros((3, blocks), np.uint64)
    few, fewer = np.zeros((2, blocks), bool)
    read = np.zeros(blocks, np.uint8)
    top, both, small = np.zeros((3, blocks), np.int32)
    found, index, quotient = np.zeros(blocks, np.uint16), np.zeros(blocks, np.int64), np.zeros(blocks)
    rest, near = np.zeros((2, blocks), np.uint32)
    out = np.zeros((block, blocks), np.uint16)
    mixer = Mixer(blocks, freq, below)
    for t in range(block):
        guess, weight = mixer.predict()
        hit = mixer.hit
        np.right_shift(span, np.uint64(32), out=unit)
        np.maximum(unit, np.uint64(1), out=unit)
        np.floor_divide(code, unit, out=value)
        rest[:] = value.view(np.uint32)[::2]  # below 2**32
        np.right_shift(rest, np.uint32(_BITS0), out=top.view(np.uint32))
        np.add(weight[0], weight[1], out=both)
        np.less(top, weight[0], out=hit[0])
        np.less(top, both, out=hit[1])
        hit[1] -= hit[0]
        # Below 2**32 the quotient of doubles has the right whole part.
        np.left_shift(both, _BITS0, out=both)
        np.subtract(rest, both.view(np.uint32), out=rest)
        np.divide(rest, mixer.left, out=quotient)
        np.copyto(index, quotient, casting="unsafe")
        symbol.take(index, out=found, mode="clip")
        start, size = mixer.ranged(hit, found)
        np.multiply(found, mixer.miss, out=small)
        np.multiply(guess, hit, out=mixer.work)
        small += mixer.work[0]
        small += mixer.work[1]
        np.multiply(unit, start, out=start)
        np.subtract(code, start, out=code)
        np.multiply(unit, size, out=span)
        np.less(span, _LEAST, out=few)
        np.less(span, _LEAST >> np.uint64(16), out=fewer)
        np.add(few.view(np.uint8), fewer.view(np.uint8), out=read)
        np.multiply(read, np.uint64(16), out=shift)
        np.left_shift(code, shift, out=code)
        np.left_shift(span, shift, out=span)
        ahead.take(at, out=near, mode="clip")
        np.subtract(np.uint64(32), shift, out=shift)
        np.right_shift(near, shift, out=value)
        np.bitwise_or(code, value, out=code)
        np.add(at, read, out=at)
        out[t] = small
        mixer.update(small, np.equal(guess, small, out=hit))
    return out.T.reshape(-1)[:count]


# --- files ---


def packed(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int) -> bytes:
    """The bytes of one file."""
    held = np.bincount(ids, minlength=1)
    freq, below = order0(held)
    words, sizes = encode_blocks(ids, block, freq, below) if len(ids) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    raw = memoryview(ids.astype("<u2").view(np.uint8))
    sums = [zlib.crc32(raw[i : i + 2 * block]) for i in range(0, len(raw), 2 * block)]
    table = zlib.compress(held.astype("<u4").tobytes())
    index = zlib.compress(
        np.array([d is None for d in doc_ids], "<u1").tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + counts.astype("<i8").tobytes()
    )
    blocks = np.stack([sizes, np.array(sums, np.int64)], axis=1).astype("<u4").tobytes()
    head = json.dumps({
        "ids": len(ids), "documents": len(doc_ids), "block": block, "table": len(table), "index": len(index),
        "index_crc32": zlib.crc32(index), "table_crc32": zlib.crc32(table),
    }).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, index, blocks, words.astype("<u2").tobytes()])


def unpacked(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ids) of a file; raises ValueError if a checksum does not hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack_from("<I", data, 8)[0]
    head = json.loads(data[12 : 12 + size])
    at = 12 + size
    table, index = data[at : at + head["table"]], data[at + head["table"] : at + head["table"] + head["index"]]
    if zlib.crc32(table) != head["table_crc32"] or zlib.crc32(index) != head["index_crc32"]:
        raise ValueError("header is damaged")
    at += head["table"] + head["index"]
    n, rows, block = head["ids"], head["documents"], head["block"]
    index = zlib.decompress(index)
    absent = np.frombuffer(index, "<u1", rows)
    names = np.frombuffer(index, "<i8", rows, rows)
    counts = np.frombuffer(index, "<i8", rows, 9 * rows)
    blocks = -(-n // block)
    entries = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(-1, 2)
    words = np.frombuffer(data, "<u2", int(entries[:, 0].sum()), at + 8 * blocks)
    ids = np.zeros(0, np.uint16)
    if n:
        freq, below = order0(np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64))
        ids = decode_blocks(words, entries[:, 0].astype(np.int64), n, block, freq, below)
    raw = memoryview(ids.astype("<u2").view(np.uint8))
    for k, known in enumerate(entries[:, 1].tolist()):
        if zlib.crc32(raw[2 * k * block : 2 * (k + 1) * block]) != known:
            raise ValueError(f"block {k} is damaged")
    return [None if a else int(d) for a, d in zip(absent, names, strict=True)], counts, ids


MANIFEST = "part int, piece int, file string, documents bigint, ids bigint, bytes bigint"


def write_ids(docs: DataFrame, target: str, path: str = MODEL, p: FileParameters | None = None) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, and return the manifest of files.

    A file is written under a passing name and moved, so a task that runs twice leaves the same file.
    """
    p = p or FileParameters()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, p.remembered)
        store, base = fs.FileSystem.from_uri(target)
        part, piece = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, ids, total, piece
            body = packed(names, np.concatenate(counts), np.concatenate(ids), p.block)
            name = f"part-{part:06d}-{piece:06d}.ids"
            passing = f"{base}/.{name}.{uuid.uuid4().hex}"
            store.create_dir(base)
            with store.open_output_stream(passing) as out:
                out.write(body)
            store.move(passing, f"{base}/{name}")
            row = [part, piece, name, len(names), total, len(body)]
            names, counts, ids, total, piece = [], [], [], 0, piece + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                names=["part", "piece", "file", "documents", "ids", "bytes"],
            )

        for batch in batches:
            for low, high, data, bounds in each_slice(batch, limit=1 << 20):
                found, ends = own.encode(data, bounds)
                sizes = np.diff(np.r_[0, ends])
                whole = np.insert(found, ends, END_ID)
                names += batch.column(0).slice(low, high - low).to_pylist()
                counts.append(sizes + 1)
                ids.append(whole)
                total += len(whole)
                if total >= p.file_ids:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return kept(ordered.mapInArrow(write, MANIFEST), "token-manifest")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(manifest: DataFrame, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    names, counts, ids = unpacked(f.read())
                body = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(counts)
                sums = [zlib.crc32(body[e - 4 * c : e]) for e, c in zip(ends, counts, strict=True)]
                start = row["start"] + ends // 4 - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # Totals by part and within a part: neither window gathers more than parts, or files of a part.
    upto = (Window.unboundedPreceding, -1)
    pieces = manifest.select(
        "part", "piece",
        F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("piece").rowsBetween(*upto)), F.lit(0)).alias("inside"),
    )
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("ahead"))
    # A file's offset is joined to its name, so nothing is joined to documents after reading.
    start = (F.col("ahead") + F.col("inside")).alias("start")
    placed = manifest.select("part", "piece", "file").join(pieces, ["part", "piece"]).join(parts, "part")
    # The manifest is small, so the number of tasks must be named: one for each file, up to a bound.
    files = placed.select("file", start).repartition(min(max(manifest.count(), 1), 20_000))
    return files.mapInArrow(read, READ)


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop resolves it to, as Arrow's file systems name it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    scheme = {"s3a": "s3", "s3n": "s3"}.get(whole.getScheme(), whole.getScheme())
    return f"{scheme}://{whole.getAuthority() or ''}{whole.getPath()}"


def stored_ids(spark: SparkSession, docs: DataFrame, path: str = MODEL, p: FileParameters | None = None) -> DataFrame:
    """Encode, write, read back: (doc_id, start, n_tokens, ids_crc32) per document.

    ``start`` counts the ids of all documents before it in doc_id order; ``n_tokens`` includes the
    end id 2; the crc32 is over the ids as little-endian unsigned 32-bit integers. A null text is
    empty and has the end id only. Null doc_ids come first; rows of one doc_id follow one another.
    Other columns are ignored; an empty table writes no file.
    """
    target = arrow_uri(spark, place(spark, "token-files"))
    manifest = write_ids(docs, target, path, p)
    return read_ids(manifest, target)
