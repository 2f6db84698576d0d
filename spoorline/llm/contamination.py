"""Benchmark decontamination: an FM-index per shard of training text, searched for test phrases.

A shard is a bounded slice of documents. Its index covers the runs of words that occur in the phrase
block at hand and are long enough to hold a phrase: no occurrence can leave such a run, so nothing is
lost. Every run ends in a separator of its own rank, which makes the suffix order strict and lets a
walk stop at the first word of a run. Phrases are found by backward search through the ranks of a
wavelet matrix, all phrases at once; occurrences are located by walking back to sampled suffixes; the
word spans are merged per document.

Phrases go to the tasks in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.store import kept
from spoorline.llm.words import ALNUM, Words, arrow_map, each_slice

WINDOW = 13
BLOCK_ROWS = 200_000
#: Stands for items whose item_id is null, which count as one item.
UNNAMED = -(1 << 63)
SHARD_BYTES = 1 << 20


class FmIndex:
    """Full-text index of runs of symbols from 1 to ``top``.

    ``text`` holds the runs, each followed by 0. ``sample`` is the distance between located suffixes;
    the first suffix of each run is always sampled.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 32):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (max(n, top + len(ends)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            fresh = np.r_[False, key[order][1:] != key[order][:-1]]
            place = np.cumsum(fresh)
            rank = np.empty(n, np.int64)
            rank[order] = place
            if not n or place[-1] == n - 1:
                break
            step *= 2
        before = np.where(order > 0, text[order - 1], 0)
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        level = before.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            on = (level >> bit) & 1
            self.ones.append(np.r_[0, np.cumsum(on)].astype(np.int32))
            self.zeros.append(n - int(on.sum()))
            level = np.concatenate([level[on == 0], level[on == 1]])
        self.before = before
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        first = np.zeros(n, bool)
        first[0:1] = True
        first[ends[ends < n - 1] + 1] = True
        self.sampled = (first | (np.arange(n) % sample == 0))[order]
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row of the transformed text."""
        high, low = row.astype(np.int64), np.zeros(len(row), np.int64)
        for k in range(self.bits):
            on = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[high], ones[low]
            high = np.where(on, zeros + a, high - a)
            low = np.where(on, zeros + b, low - b)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; phrases are right-aligned rows of symbols."""
        last = phrases[:, -1]
        low, high = self.below[last].copy(), self.below[last + 1].copy()
        for t in range(1, phrases.shape[1]):
            go = np.flatnonzero((lengths > t) & (low < high))
            if not len(go):
                break
            symbol = phrases[go, -1 - t]
            low[go] = self.below[symbol] + self.rank(symbol, low[go])
            high[go] = self.below[symbol] + self.rank(symbol, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        row, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            go = np.flatnonzero(~self.sampled[row])
            if not len(go):
                return self.samples[self.sample_rank[row]] + steps
            symbol = self.before[row[go]]
            row[go] = self.below[symbol] + self.rank(symbol, row[go])
            steps[go] += 1


@dataclass(frozen=True)
class Phrases:
    """One block of distinct phrases over a sorted vocabulary, with the items that hold each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(rows: list[tuple[bytes, int]]) -> Phrases:
        rows = sorted(rows)
        bodies = [b for i, (b, _) in enumerate(rows) if i == 0 or rows[i - 1][0] != b]
        first = [i for i, (b, _) in enumerate(rows) if i == 0 or rows[i - 1][0] != b]
        words = [np.frombuffer(b, np.uint64) for b in bodies]
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = np.zeros((len(words), int(lengths.max(initial=1))), np.int64)
        for row, w in zip(symbols, words, strict=True):
            row[len(row) - len(w) :] = np.searchsorted(vocabulary, w) + 1
        return Phrases(
            vocabulary, symbols, lengths, np.array([*first, len(rows)]), np.array([i for _, i in rows])
        )

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence inside one text of the shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(words.hash)
        if not n or not len(self.lengths):
            return none
        spot = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == words.hash
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = known[1:] != known[:-1]
        fresh[words.first] = True
        starts = np.flatnonzero(fresh)
        sizes = np.diff(starts)
        good = known[starts[:-1]] & (sizes >= self.lengths.min())
        starts, sizes = starts[:-1][good], sizes[good]
        if not len(starts):
            return none
        room = np.cumsum(sizes + 1)
        begin = room - sizes - 1
        where = np.repeat(starts - begin, sizes + 1) + np.arange(room[-1])
        text = spot[np.minimum(where, n - 1)] + 1
        text[room - 1] = 0
        index = FmIndex(text, len(self.vocabulary))
        low, high = index.search(self.symbols, self.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        return phrase, where[index.locate(rows)]


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (phrase, item_id): every run of ``width`` words of an item, or all words of a shorter one."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items = batch.column(0).to_pylist()
        for low, high, data, bounds in each_slice(batch):
            words = Words(data, bounds, ALNUM)
            phrases, owners = [], []
            for i in range(high - low):
                own = words.hash[words.first[i] : words.first[i + 1]]
                size = min(width, len(own))
                if size:
                    found = {own[j : j + size].tobytes() for j in range(len(own) - size + 1)}
                    phrases += found
                    owners += [items[low + i]] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrases, pa.binary()), pa.array(owners, pa.int64())], names=["phrase", "item_id"]
            )

    known = F.coalesce(F.col("item_id").cast("bigint"), F.lit(UNNAMED))
    rows = benchmark.select(known.alias("item_id"), "text")
    return rows.mapInArrow(arrow_map(cut), "phrase binary, item_id bigint").distinct()


#: A row is known by its doc_id and text_key: hits follow from the text, so rows equal in both need no telling apart.
HITS = "doc_id bigint, text_key bigint, n_words bigint, words array<int>, chars array<int>, items array<bigint>"


def _hits(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """One row per document: hit spans as flat pairs (start, end) of words and of code points."""

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, data, bounds in each_slice(batch, limit=SHARD_BYTES):
            words = Words(data, bounds, ALNUM)
            phrase, place = phrases.occurrences(words)
            rows = high - low
            delta = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(delta, place, 1)
            np.add.at(delta, place + phrases.lengths[phrase], -1)
            hit = np.cumsum(delta)[:-1] > 0
            text = np.searchsorted(words.first, np.arange(len(hit)), "right") - 1
            edge = np.ones(len(hit) + 1, bool)
            edge[1:-1] = (hit[1:] != hit[:-1]) | (text[1:] != text[:-1])
            cuts = np.flatnonzero(edge)
            starts, ends = cuts[:-1], cuts[1:]
            starts, ends = starts[hit[starts]], ends[hit[starts]]
            glyphs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            owner = text[starts]
            head = words.first[owner]
            base = glyphs[bounds[owner]]
            span_words = np.stack([starts - head, ends - head], axis=1)
            span_chars = np.stack([glyphs[words.start[starts]] - base, glyphs[words.end[ends - 1]] - base], axis=1)
            counts = np.diff(phrases.first)[phrase]
            which = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            item = phrases.items[np.repeat(phrases.first[phrase], counts) + which]
            pair = np.unique(np.stack([np.repeat(text[place], counts), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
            span_at = np.searchsorted(owner, np.arange(rows + 1))
            item_at = np.searchsorted(pair[:, 0], np.arange(rows + 1))

            def listed(at, values, kind):
                return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, rows),
                    batch.column("text_key").slice(low, rows),
                    pa.array(np.diff(words.first), pa.int64()),
                    listed(2 * span_at, span_words.ravel(), pa.int32()),
                    listed(2 * span_at, span_chars.ravel(), pa.int32()),
                    listed(item_at, pair[:, 1], pa.int64()),
                ],
                names=["doc_id", "text_key", "n_words", "words", "chars", "items"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(arrow_map(find), HITS)


def _merged(hits: DataFrame, blocks: int) -> DataFrame:
    """Hit rows of several phrase blocks, each with one per input row, as one per input row."""

    def union(lists: list) -> list:
        spans = sorted(p for flat in lists for p in zip(flat[::2], flat[1::2], strict=True))
        out: list[int] = []
        for start, end in spans:
            if out and start <= out[-1]:
                out[-1] = max(out[-1], end)
            else:
                out += [start, end]
        return out

    def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = batch.to_pydict()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([union(x) for x in rows["words"]], pa.list_(pa.int32())),
                pa.array([union(x) for x in rows["chars"]], pa.list_(pa.int32())),
                pa.array(rows["items"], pa.list_(pa.int64())),
            ],
            names=batch.schema.names,
        )

    grouped = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set("words").alias("words"),
        F.collect_set("chars").alias("chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("bigint").alias("rows"),
    )
    each = grouped.withColumn("rows", F.explode(F.sequence(F.lit(1), "rows"))).drop("rows")
    return each.mapInArrow(arrow_map(merge), HITS)


def hits(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(doc_id, text_key, n_words, words, chars, items) for every document, null and repeated ids too.

    ``words`` and ``chars`` are flat lists start, end, start, end of merged hit spans, in words and in
    code points; ``items`` are the items with an occurring window. Null texts have no words. Repeated
    or equal items each count; items with a null item_id are one item, ``UNNAMED``. A phrase block has about ``block_rows`` (phrase, item) rows, which
    bounds what a task is sent. Other columns are ignored; an empty benchmark hits nothing.
    ``text_key`` is a hash of the text.
    """
    phrases = kept(windows(benchmark, width), "phrases")
    blocks = max(1, -(-phrases.count() // block_rows))
    if blocks == 1:
        return _hits(docs, Phrases.of([(bytes(r[0]), r[1]) for r in phrases.collect()]))
    block = F.pmod(F.xxhash64("phrase", "item_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = [(bytes(r[0]), r[1]) for r in phrases.filter(block == b).collect()]
        own = _hits(docs, Phrases.of(rows))
        found = own if found is None else found.unionByName(own)
    return _merged(found, blocks)


def _sum_of_spans(column: str):
    parts = F.transform(column, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if any word is hit and at least one in twenty is. The items with a
    null item_id count as one, whose name in the digest is empty.
    """
    found = hits(docs, benchmark, **parameters).withColumn("n_hit", _sum_of_spans("words"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: F.when(x == UNNAMED, "").otherwise(x.cast("string")))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents, same columns, with the merged hit spans cut from the contaminated ones.

    Documents that are not contaminated stay as they are. A text cut to nothing stays as an empty
    text. ``n_chars``, where present, follows a changed text. doc_id may be null or repeated.
    """
    found = hits(docs, benchmark, **parameters).withColumn("n_hit", _sum_of_spans("words"))
    spans = (
        found.filter(_contaminated())
        .select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), F.col("chars").alias("_chars"))
        .dropDuplicates(["_doc", "_text"])
    )
    ends = F.transform("_chars", lambda x, i: F.when(i % 2 == 1, x))
    stays = F.concat(F.array(F.lit(0)), F.filter(ends, lambda x: x.isNotNull()))
    starts = F.filter(F.transform("_chars", lambda x, i: F.when(i % 2 == 0, x)), lambda x: x.isNotNull())
    upto = F.concat(starts, F.array(F.length("text")))
    pieces = F.transform(F.arrays_zip(stays.alias("a"), upto.alias("b")), lambda s: F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"]))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    joined = docs.join(spans, same, "left")
    changed = joined.withColumn(
        "text", F.when(F.col("_chars").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn(
            "n_chars", F.when(F.col("_chars").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return changed.select(*docs.columns)
