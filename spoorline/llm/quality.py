"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing gives every word a fixed sparse ternary index vector, drawn from its 64-bit hash; a
word's vector is the sum of the index vectors of its neighbours over the whole corpus. The sums are
whole numbers, one for each word of the corpus, so the table grows with the vocabulary and does not depend
on how the rows are dealt. Words travel packed: a row holds the words of one share (a range of hashes)
of one task or block, in order and compressed. To be scored, documents are cut into blocks of bounded
bytes; each block asks the table once for each of its distinct words, share by share, and meets the
answers in one task. There its texts stand as ranks of its words by frequency, which take less room
than the texts do.
Documents are pooled by mean, spread and change from word to word. Runs of digits are words by their
length alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.store import dropped, kept
from spoorline.llm.words import _power, each_slice, mix

SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


@dataclass(frozen=True)
class QualityParameters:
    """``most_labels`` bounds the labelled rows that are fitted and calibrated on (by a hash of doc_id);
    ``block_bytes``: texts that ask for word vectors together (one longer text is a block of its own);
    ``most_held``: words that a task adds up before it sends them on. ``width`` is even. Word hashes
    are dealt out by their ``share_bits`` leading bits; None: as the shuffle partitions call for."""

    width: int = 32
    nonzero: int = 4
    reach: int = 2
    block_bytes: int = 1 << 25
    most_held: int = 240_000
    hidden: int = 24
    epochs: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    most_labels: int = 20_000
    threshold: float = 0.3
    seed: int = 11
    share_bits: int | None = None


def _classes() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = kind[128:] = LETTER
    return kind


_KIND = _classes()
_CODE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_CODE[48:58] = _CODE[48]


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text): runs of letters, of digits, of marks."""
    n = len(data)
    kind = _KIND[data]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = kind[1:] != kind[:-1]
    fresh[bounds] = True
    start = np.flatnonzero(fresh[:n])
    end = np.append(start[1:], n)[: len(start)]
    real = kind[start] != SPACE if n else np.zeros(0, bool)
    start, end = start[real], end[real]
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, bounds)


def index_vectors(words: np.ndarray, p: QualityParameters) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the index vectors of word hashes, both (words, nonzero)."""
    step = np.arange(1, p.nonzero + 1, dtype=np.uint64) + (np.uint64(p.seed) << np.uint64(40))
    draw = mix(words[:, None] ^ mix(step)[None, :])
    return (draw % np.uint64(p.width)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and the sum of their rows."""
    hashes = np.concatenate([w for w, _ in parts])
    rows = np.concatenate([r for _, r in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[cuts], np.add.reduceat(rows, cuts, axis=0) if len(cuts) else rows


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, lowest first, as many as the largest one needs."""
    depth = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = [(values >> values.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(depth)]
    return b"".join([bytes([depth]), *planes])


def packed(words: np.ndarray, rows: np.ndarray | None = None) -> bytes:
    """Ascending word hashes by their differences, and a row of whole numbers for each, compressed."""
    body = np.uint64(len(words)).tobytes() + _planes(np.diff(words, prepend=np.uint64(0)))
    if rows is not None:
        body += _planes(((rows << 1) ^ (rows >> (8 * rows.itemsize - 1))).view(f"u{rows.itemsize}"))
    return zstandard.ZstdCompressor(level=3).compress(body)


def _numbers(data: np.ndarray, at: int, size: int, kind: type = np.uint64) -> tuple[np.ndarray, int]:
    """The numbers of ``_planes`` that begin at a byte, and the byte after them."""
    out, depth = np.zeros(size, kind), int(data[at])
    for i in range(depth):
        plane = data[at + 1 + i * size : at + 1 + (i + 1) * size]
        out |= plane.astype(kind) << kind(8 * i)
    return out, at + 1 + depth * size


def unpacked(body: bytes, columns: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(words, rows) of ``packed``."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = int(data[:8].view(np.uint64)[0])
    steps, at = _numbers(data, 8, n)
    words = np.cumsum(steps, dtype=np.uint64)
    folded = _numbers(data, at, n * columns)[0] if columns else np.zeros(0, np.uint64)
    rows = (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)
    return words, rows.reshape(n, columns)


def _bits(spark: SparkSession, p: QualityParameters) -> int:
    """Leading bits of a hash that name its share: at least as many shares as shuffle partitions."""
    return p.share_bits or max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _shared(words: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shares of ascending words, and where each stands."""
    edges = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for share in np.flatnonzero(np.diff(edges)):
        yield int(share), slice(int(edges[share]), int(edges[share + 1]))


ROWS, SEALS, TEXTS = -1, -2, -3  # in place of a share: what a block sends of itself
HELD = "share int, home bigint, body binary"


def _held(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    share, home, body = zip(*rows) if rows else ((), (), ())
    columns = [pa.array(share, pa.int32()), pa.array(home, pa.int64()), pa.array(body, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["share", "home", "body"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["share"][i].as_py(), batch["home"][i].as_py(), batch["body"][i].as_py()


def word_sums(docs: DataFrame, p: QualityParameters) -> DataFrame:
    """(share, home, body): each word of the corpus with its count and the sum of its contexts' index
    vectors, one packed row per share; ``home`` is -1.

    Tasks add up their own words, a bounded number at a time, before the shuffle; after it the rows
    of a share follow each other and are added one by one, so a task holds the words of one share.
    """
    bits = _bits(docs.sparkSession, p)
    most_seen = (1 << 30) // (2 * p.reach * p.nonzero)  # sums of so many words fit four bytes

    def sent(words: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return _held([(share, -1, packed(words[part], rows[part])) for share, part in _shared(words, bits)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = fresh = 0
        for batch in batches:
            for _, _, data, bounds in each_slice(batch, limit=1 << 19):
                hashes, first = tokens(data, bounds)
                words, found = np.unique(hashes, return_inverse=True)
                places, signs = index_vectors(words, p)
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
                total = np.zeros(len(words) * p.width)
                for step in range(1, p.reach + 1):
                    near = np.flatnonzero(text[step:] == text[:-step])
                    for one, other in ((near, near + step), (near + step, near)):
                        row, context = found[one] * p.width, found[other]
                        for k in range(p.nonzero):
                            at, sign = row + places[context, k], signs[context, k]
                            total += np.bincount(at, weights=sign, minlength=total.size)
                if held and seen + len(hashes) > most_seen:
                    yield sent(*_merged(held))
                    held, seen, fresh = [], 0, 0
                seen += len(hashes)
                rows = np.empty((len(words), p.width + 1), np.int32 if seen <= most_seen else np.int64)
                rows[:, 0] = np.bincount(found, minlength=len(words))
                rows[:, 1:] = total.reshape(len(words), p.width)
                held.append((words, rows))
                fresh += len(words)
                if fresh > p.most_held // 2:
                    held, fresh = [_merged(held)], 0
                    if len(held[0][0]) > p.most_held:
                        yield sent(*held.pop())
                        seen = 0
        if held:
            yield sent(*_merged(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for share, _, body in _each(batches):
            if share != now and held:
                yield _held([(now, -1, packed(*_merged(held)))])
                held = []
            now = share
            held.append(unpacked(body, p.width + 1))
            if sum(len(w) for w, _ in held[1:]) > len(held[0][0]):
                held = [_merged(held)]
        if held:
            yield _held([(now, -1, packed(*_merged(held)))])

    partial = docs.select("text").mapInArrow(gather, HELD)
    return partial.repartition("share").sortWithinPartitions("share").mapInArrow(add, HELD)


def word_vectors(docs: DataFrame, p: QualityParameters) -> DataFrame:
    """(share, home, body): word vectors without their common direction, at unit length, in steps of
    1/7; ``body`` holds the words of a share and their codes, ``home`` is -1.

    Two steps share a byte. The sums are written once; only the common direction, one row a task,
    comes to the driver.
    """
    sums = kept(word_sums(docs, p), "quality-words")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.width + 1, np.int64)
        for _, _, body in _each(batches):
            total += unpacked(body, p.width + 1)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in total], names=[f"v{i}" for i in range(len(total))])

    shape = ", ".join(f"v{i} bigint" for i in range(p.width + 1))
    added = sums.mapInArrow(whole, shape).agg(*[F.sum(f"v{i}") for i in range(p.width + 1)]).first()
    mean = np.array([v or 0 for v in added[1:]], float) / max(added[0] or 0, 1)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, home, body in _each(batches):
            words, rows = unpacked(body, p.width + 1)
            own = rows[:, 1:] / rows[:, :1] - mean
            own /= np.maximum(np.abs(own).max(axis=1, keepdims=True), 1e-9)
            step = np.rint(own * 7).astype(np.int8).view(np.uint8) & 15
            code = (step[:, ::2] | step[:, 1::2] << 4).astype(np.int64)
            yield _held([(share, home, packed(words, code))])

    return sums.mapInArrow(unit, HELD)


def decoded(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes, one row each; a word without direction is zero."""
    step = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), 2 * codes.shape[1]).astype(np.int8)
    own = np.where(step > 7, step - 16, step).astype(np.float32)
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)


def worded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct words of a column, each word of its texts as a place among them, words a text)."""
    held, sizes = [], []
    for _, _, data, bounds in each_slice(batch, column, 1 << 18):
        hashes, first = tokens(data, bounds)
        own, found = np.unique(hashes, return_inverse=True)
        held.append((own, found.astype(np.uint32)))
        sizes.append(np.diff(first))
    words = np.unique(np.concatenate([own for own, _ in held]))
    places = [np.searchsorted(words, own).astype(np.uint32)[found] for own, found in held]
    return words, np.concatenate(places), np.concatenate(sizes)


def spelled(places: np.ndarray, sizes: np.ndarray) -> bytes:
    """``places`` and ``sizes`` of ``worded``, compressed: frequent words are small numbers."""
    counts = np.bincount(places)
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    body = np.array([len(counts), len(sizes), len(places)], np.uint64).tobytes()
    body += _planes(counts) + _planes(sizes) + _planes(rank[places])
    far = zstandard.ZstdCompressionParameters.from_level(3, window_log=25, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=far).compress(body)


def unspelled(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of ``spelled``."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n, texts, length = (int(v) for v in data[:24].view(np.uint64))
    counts, at = _numbers(data, 24, n)
    sizes, at = _numbers(data, at, texts)
    ranks, _ = _numbers(data, at, length, np.uint32)
    order = np.argsort(-counts.astype(np.int64), kind="stable").astype(np.uint32)
    return order[ranks], sizes.astype(np.int64)


def pooled(places: np.ndarray, n: np.ndarray, vectors: np.ndarray, p: QualityParameters) -> np.ndarray:
    """One row per text: mean, spread and mean change of its word vectors, and its log length.

    ``places`` and ``n`` are those of ``worded``; ``vectors`` has one row for each distinct word.
    """
    found, text = places, np.repeat(np.arange(len(n), dtype=np.int32), n)
    sums = np.zeros((len(n), 3 * p.width))
    for low in range(0, len(found), 1 << 15):
        part = slice(low, low + (1 << 15))
        own, where = vectors[found[part]], text[part]
        before = np.maximum(np.arange(low, low + len(own)) - 1, 0)
        change = np.abs(own - vectors[found[before]])
        change[text[before] != where] = 0
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        block = np.concatenate([own, own * own, change], axis=1)
        sums[where[cuts]] += np.add.reduceat(block, cuts, axis=0)
    sums /= np.maximum(n, 1)[:, None]
    mean, square, change = np.split(sums, 3, axis=1)
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, spread, change, np.log1p(n)[:, None]], axis=1)


def with_features(
    rows: DataFrame,
    vectors: DataFrame,
    p: QualityParameters,
    emit: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch],
    schema: T.StructType | str,
    whole: bool = False,
) -> DataFrame:
    """``emit(rows of a block, their features)`` for all rows; they have a column ``text``, which
    ``emit`` gets only if ``whole``.

    ``rows`` is a stored table, or a function of one that keeps its order: it is read once for the
    words of its blocks and once for their texts, and a block whose words differ between the two
    raises an error. A word is asked for once per block. The table's row of a share comes before the
    asking blocks, which pass by it one by one. Texts travel compressed, as ranks of words unless ``whole``.
    """
    bits = _bits(rows.sparkSession, p)
    names = [f"c{i}" for i in range(len(rows.columns))]
    text = names[rows.columns.index("text")]
    plain = rows.toDF(*names)
    sent = names if whole else [n for n in names if n != text]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        numbers = count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for low, high, _, _ in each_slice(batch, text, p.block_bytes):
                yield next(numbers), batch.slice(low, high - low)

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        own = [np.unique(tokens(d, b)[0]) for _, _, d, b in each_slice(batch, text, 1 << 18)]
        return np.unique(np.concatenate(own))

    def seals(words: np.ndarray) -> bytes:
        return b"".join(np.uint32(share).tobytes() + _seal(words[part]) for share, part in _shared(words, bits))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in blocks(batches):
            words = words_of(batch)
            yield _held([(share, number, packed(words[part])) for share, part in _shared(words, bits)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for share, home, body in _each(batches):
            if share != now:
                now, known, codes = share, np.zeros(0, np.uint64), np.zeros((1, p.width // 2), np.uint8)
            if home == -1:
                known, rows = unpacked(body, p.width // 2)
                codes = np.zeros((len(known) + 1, p.width // 2), np.uint8)  # the last: words without a vector
                codes[:-1] = rows
            else:
                words, _ = unpacked(body)
                found = np.searchsorted(known, words)
                found[np.append(known, np.uint64(0))[found] != words] = len(known)
                yield _held([(share, home, _seal(words) + zstandard.compress(codes[found].tobytes()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.select(sent).schema) as stream:
                stream.write_batch(batch.select(sent))
            parts = [(ROWS, number, zstandard.compress(sink.getvalue()))]
            if not whole:
                words, places, sizes = worded(batch, text)
                parts += [(SEALS, number, seals(words)), (TEXTS, number, spelled(places, sizes))]
            yield _held(parts)

    def meet(block: pa.Table) -> pa.Table:
        parts = {share: body for share, _, body in _each(block.to_batches())}
        with pa.ipc.open_stream(zstandard.decompress(parts.pop(ROWS))) as stream:
            batch = stream.read_next_batch()
        if whole:  # slice by slice: the texts are held already
            words = words_of(batch)
            own = seals(words)
            read = (tokens(d, b) for _, _, d, b in each_slice(batch, text, 1 << 18))
            texts = ((np.searchsorted(words, hashes), np.diff(first)) for hashes, first in read)
        else:
            own = parts.pop(SEALS)
            texts = iter([unspelled(parts.pop(TEXTS))])
        shares = sorted(parts)  # ranges of hashes, so the words of one follow those of another
        if own != b"".join(np.uint32(share).tobytes() + parts[share][:32] for share in shares):
            raise RuntimeError("rows changed between two reads: store the documents before they are scored")
        codes = [zstandard.decompress(parts.pop(share)[32:]) for share in shares]
        edges = np.cumsum([0] + [2 * len(c) // p.width for c in codes])
        vectors = np.zeros((edges[-1], p.width), np.float32)
        for low, high, code in zip(edges, edges[1:], codes):
            vectors[low:high] = decoded(np.frombuffer(code, np.uint8).reshape(-1, p.width // 2))
        found = [pooled(places, sizes, vectors, p) for places, sizes in texts]
        return pa.Table.from_batches([emit(batch, np.concatenate(found))])

    asked = plain.mapInArrow(ask, HELD).unionByName(vectors)
    answers = asked.repartition("share").sortWithinPartitions("share", "home").mapInArrow(answer, HELD)
    return plain.mapInArrow(cut, HELD).unionByName(answers).groupBy("home").applyInArrow(meet, schema)


def _seal(words: np.ndarray) -> bytes:
    return hashlib.sha256(words.tobytes()).digest()


@dataclass(frozen=True)
class Network:
    """Scaling, two layers and the temperature; ``constant`` replaces them without labels."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return _sigmoid(_logits((features - self.centre) / self.scale, self.weights) / self.temperature)


@dataclass(frozen=True)
class QualityModel:
    """The network and the table of word vectors, which stays in the shared folder."""

    vectors: DataFrame
    network: Network
    parameters: QualityParameters


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logits(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, p: QualityParameters) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the mean log loss, whole batch, fixed seed."""
    rng = np.random.default_rng(p.seed)
    w = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], p.hidden)),
        np.zeros(p.hidden),
        rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for t in range(1, p.epochs + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        error = (_sigmoid(hidden @ w[2] + w[3]) - y) / len(y)
        back = np.outer(error, w[2]) * (1 - hidden * hidden)
        steps = [x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
        for i, g in enumerate(steps):
            g = g + p.decay * w[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - p.rate * (first[i] / (1 - 0.9**t)) / (
                np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8
            )
    return tuple(w)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not fitted."""
    if len(y) == 0:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, p: QualityParameters | None = None) -> QualityModel:
    """Word vectors from all of ``docs``; the network from labelled rows that are not held out.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out and never read here; of the rest, those
    with remainder 1 set the temperature. A doc_id labelled more than once counts by its mean label;
    null labels are ignored. Without labels of both kinds every score is the share of label 1 (0.5
    without any label).
    """
    p = p or QualityParameters()
    p = replace(p, share_bits=_bits(docs.sparkSession, p))
    vectors = word_vectors(docs, p)
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .withColumn("fold", fold())
        .filter("fold <> 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(p.most_labels)
    )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # At most `most_labels` rows of three numbers, so this side may be broadcast.
    sample = kept(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label", "fold"), "quality-sample")

    def features(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        body = pa.array([r.tobytes() for r in rows], pa.binary())
        columns = [*batch.columns, body]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "fold", "body"])

    schema = "doc_id bigint, label int, fold int, body binary"
    rows = with_features(sample, vectors, p, features, schema).collect()  # bounded by `most_labels`
    dropped(sample)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["body"])))
    none = np.zeros(1)
    if not rows:
        return QualityModel(vectors, Network(none, none, (), 1.0, 0.5), p)
    x = np.array([np.frombuffer(r["body"]) for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    part = np.array([r["fold"] for r in rows]) != 1
    if len(set(y[part])) < 2:
        return QualityModel(vectors, Network(none, none, (), 1.0, float(y.mean())), p)
    centre, scale = x[part].mean(axis=0), x[part].std(axis=0) + 1e-6
    weights = fit_network((x[part] - centre) / scale, y[part], p)
    heat = temperature(_logits((x[~part] - centre) / scale, weights), y[~part])
    return QualityModel(vectors, Network(centre, scale, weights, heat, None), p)


def fold():
    """crc32 of the doc_id as text, modulo 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row; a null text scores as an empty one. Other columns are ignored."""
    network = model.network

    def run(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        scores = pa.array(network.probabilities(rows))
        return pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, score double"
    return with_features(rows, model.vectors, model.parameters, run, schema)


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows, all columns unchanged, that score at least the model's threshold."""
    network, threshold, names = model.network, model.parameters.threshold, docs.columns

    def run(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        good = batch.filter(pa.array(network.probabilities(rows) >= threshold))
        return pa.RecordBatch.from_arrays(good.columns, names=names)

    return with_features(docs, model.vectors, model.parameters, run, docs.schema, whole=True)


def judged(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted); held_out of a row without doc_id is null."""
    return scored(docs, model).select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= model.parameters.threshold).cast("int").alias("predicted"),
    )
