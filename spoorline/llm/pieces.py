"""SentencePiece encoding and decoding by best-scoring segmentation.

An Aho-Corasick automaton over the pieces reports, at each position, every piece that ends there (its
own output and those along its output links); a single-pass Viterbi relaxes the best score of the
position from the start of each. No piece holds a space mark after another character, so a text falls
apart into chunks (space marks, then other characters) whose best segmentations are independent;
short chunks are remembered within bounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from spoorline.llm.words import arrow_map, buffers, slices

MARK = "▁"  # stands for a space
MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN_PENALTY = 10.0  # fixed value of the format: an unknown character scores this below the worst piece
REMEMBERED = 400_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceCodec:
    """Pieces of a model file with byte fallback. Ids are the best-scoring segmentation."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        worst = 0.0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses a word boundary")
                score = model.get_score(i)
                worst = min(worst, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes[i] = piece.encode()
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        self.memory: dict[str, tuple[int, ...]] = {}

    def segment(self, chunk: str) -> tuple[int, ...]:
        """Ids of the best segmentation; of equal scores, the one whose last piece is longest."""
        n = len(chunk)
        best = [0.0] + [float("-inf")] * n
        via: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        alone = bytearray(n)
        at = 0
        for end, (size, score, piece) in self.automaton.iter(chunk):
            while at < end:
                if not alone[at] and best[at] + self.unknown > best[at + 1]:
                    best[at + 1] = best[at] + self.unknown
                    via[at + 1] = (1, -1)
                at += 1
            if size == 1:
                alone[end] = 1
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1] = total
                via[end + 1] = (size, piece)
        while at < n:
            if not alone[at] and best[at] + self.unknown > best[at + 1]:
                best[at + 1] = best[at] + self.unknown
                via[at + 1] = (1, -1)
            at += 1
        out: list[int] = []
        while n:
            size, piece = via[n]
            if piece < 0:
                out += [self.byte_id[b] for b in reversed(chunk[n - 1].encode())]
            else:
                out.append(piece)
            n -= size
        return tuple(reversed(out))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.memory.get(chunk)
        if found is None:
            found = self.segment(chunk)
            if len(chunk) <= 48:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        """A space is put before a text that is not empty; spaces become marks; nothing else changes."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.chunk, _CHUNK.findall((" " + text).replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks become spaces, and the space put before the text goes."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


ENCODED = (
    "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
)


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip) for every document, whole texts.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    ``round_trip`` says that decoding gives the text back; it is false only for texts that hold
    U+2581 itself, which decodes to a space. A null text is encoded as an empty one: no ids. Other
    columns are ignored. ``path`` must name the model file on every machine.
    """

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        _, offsets = buffers(batch.column(1))
        for low, high in slices(offsets):
            ids, counts, sums, same = [], [], [], []
            for text in batch.column(1).slice(low, high - low).to_pylist():
                found = own.encode(text or "")
                values = np.array(found, np.int32)
                ids.append(values)
                counts.append(len(found))
                sums.append(zlib.crc32(values.astype("<u4").tobytes()))
                same.append(own.decode(found) == (text or ""))
            ends = np.r_[0, np.cumsum(counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())
                    ),
                    pa.array(counts, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(same),
                ],
                names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(arrow_map(encode), ENCODED)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(arrow_map(decode), "doc_id bigint, text string")
