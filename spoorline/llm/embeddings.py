"""Near-duplicate embeddings: product quantisation over inverted lists, then the exact cosine.

Unit vectors go to the nearest of a set of coarse centroids (inverted lists); the residual is stored
as one code per subspace, with the length of what the codes miss. A vector asks every list that a
partner at the threshold, in a random direction from it, would fall into with more than a small
probability; a pair is found if either side asks the other's list, and counted once. Inside a list,
table lookups give the distance from the vector to the coded members, and a member stays if that is
at most the threshold distance plus its own coding error: an exact bound. The cosine in double
precision decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.store import components, kept
from spoorline.operators.skew import ordered_numbers
from spoorline.llm.words import arrow_map


@dataclass(frozen=True)
class VectorParameters:
    """Centroids and codes are fitted on at most ``most_fitted`` vectors, chosen by a hash of vec_id;
    every vector is indexed. ``per_list`` vectors are aimed at in a list, ``most_lists`` bounds them.
    ``tail``, in standard deviations, is how unlikely a partner must be for its list not to be asked:
    2 misses about 2 % of pairs at the threshold from one side, and far fewer from both and above it."""

    cosine: float = 0.9
    tail: float = 2.0
    most_fitted: int = 16_384
    per_list: int = 256
    most_lists: int = 4096
    subspace: int = 8
    codes: int = 64
    rounds: int = 8
    tile: int = 1024
    block: int = 8192
    seed: int = 5


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids (lists, width) and codebooks (subspaces, codes, subspace width)."""

    centroids: np.ndarray
    books: np.ndarray

    def residuals(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Residuals cut into subspaces, the last one padded with zeros."""
        parts, _, size = self.books.shape
        out = np.zeros((len(units), parts * size))
        out[:, : units.shape[1]] = units - self.centroids[lists]
        return out.reshape(len(units), parts, size)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def _means(x: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from distinct starts; a centre that loses all rows keeps its place."""
    starts = np.unique(x, axis=0)
    centres = starts[rng.permutation(len(starts))[:count]].copy()
    for _ in range(rounds):
        owner = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        held = np.bincount(owner, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def fit(units: np.ndarray, total: int, p: VectorParameters) -> Quantiser:
    rng = np.random.default_rng(p.seed)
    lists = int(np.clip(total // p.per_list, 1, p.most_lists))
    centroids = _means(units, lists, p.rounds, rng)
    parts = -(-units.shape[1] // p.subspace)
    blank = Quantiser(centroids, np.zeros((parts, 1, p.subspace)))
    cut = blank.residuals(units, _nearest(units, centroids))
    books = np.zeros((parts, p.codes, p.subspace))
    for s in range(parts):
        found = _means(cut[:, s], p.codes, p.rounds, rng)
        books[s, : len(found)] = found
        books[s, len(found) :] = found[0]
    return Quantiser(centroids, books)


def _units(bodies: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, unit vectors) in double precision, from bytes of the given type."""
    rows = np.frombuffer(b"".join(bodies), kind).astype(np.float64).reshape(len(bodies), -1)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / scale
    return rows, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def prepared(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """(vec_id, key, body): a digest and the bytes of every usable vector; null for the others."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, bodies = [], []
        for value in batch.column(1).to_pylist():
            key = body = None
            if value and None not in value:
                row = np.zeros(width)
                row[: len(value)] = value
                if np.isfinite(row).all() and row.any():
                    body = (row + 0.0).astype(kind).tobytes()
                    key = hashlib.blake2b(body, digest_size=16).digest()
            keys.append(key)
            bodies.append(body)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())],
            names=["vec_id", "key", "body"],
        )

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return rows.mapInArrow(arrow_map(run), "vec_id bigint, key binary, body binary")


INDEXED = (
    "id bigint, copies bigint, home int, error double, codes binary, body binary, "
    "probes array<int>, asked binary"
)


def probed(units: np.ndarray, centres: np.ndarray, p: VectorParameters) -> tuple[np.ndarray, np.ndarray]:
    """(own list, which lists are asked).

    A partner y = cos x + sin z, z random and orthogonal to x, lies beyond the plane between the own
    centroid and another if y.(own - other) < (|own|^2 - |other|^2) / 2; the left side is normal with
    standard deviation sin |own - other| / sqrt(width - 1).
    """
    square = (centres * centres).sum(axis=1)
    dots = units @ centres.T
    own = np.argmin(square[None, :] - 2 * dots, axis=1)
    rows = np.arange(len(own))
    gap = np.sqrt(np.maximum(square[own][:, None] + square[None, :] - 2 * (centres @ centres.T)[own], 0))
    spread = np.sqrt(1 - p.cosine**2) / np.sqrt(max(units.shape[1] - 1, 1)) * gap
    plane = (square[own][:, None] - square[None, :]) / 2
    # a partner nearer than the threshold lies between x and y, so the nearer of both means counts
    mean = dots[rows, own][:, None] - dots
    asked = plane - np.minimum(mean, p.cosine * mean) >= -p.tail * spread - 1e-9
    asked[rows, own] = True
    return own, asked


def indexed(classes: DataFrame, quantiser: Quantiser, p: VectorParameters, kind: str) -> DataFrame:
    """Every class with its list, codes, coding error, and the lists that it asks."""
    centres = quantiser.centroids

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            _, units = _units(part.column(2).to_pylist(), kind)
            own, near = probed(units, centres, p)
            cut = quantiser.residuals(units, own)
            codes = np.stack([_nearest(cut[:, s], b) for s, b in enumerate(quantiser.books)], axis=1)
            coded = np.stack([b[codes[:, s]] for s, b in enumerate(quantiser.books)], axis=1)
            error = np.sqrt(((cut - coded) ** 2).sum(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(own, pa.int32()), pa.array(error),
                    pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()),
                    part.column(2),
                    pa.array([np.flatnonzero(n).astype(np.int32) for n in near], pa.list_(pa.int32())),
                    pa.array([n.tobytes() for n in np.packbits(near, axis=1)], pa.binary()),
                ],
                names=["id", "copies", "home", "error", "codes", "body", "probes", "asked"],
            )

    return classes.select("id", "copies", "body").mapInArrow(arrow_map(run), INDEXED)


FOUND = "a bigint, b bigint, links bigint"


def searched(rows: DataFrame, quantiser: Quantiser, p: VectorParameters, kind: str) -> DataFrame:
    """(a, b, links) from rows (list, tile, block, asks, id, copies, home, error, codes, body, asked).

    A pair counts where the smaller id asks; where the larger asks, only if the smaller does not
    ask back, which the member's own list of asked lists tells.

    Rows with b null say how many vectors a class is linked with in one group; the others join a
    class to the smallest class it reaches there. Both are as many as the rows, not as the links.
    """
    radius = float(np.sqrt(2 - 2 * p.cosine)) + 1e-9
    parts = len(quantiser.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            names = ("list", "tile", "block", "asks")
            keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            low = 0
            for high in range(1, len(keys) + 1):
                if high == len(keys) or keys[high] != keys[low]:
                    group, asks = keys[low][:3], keys[low][3]
                    if group != at:
                        at, held = group, []
                    part = batch.slice(low, high - low)
                    if not asks:
                        held.append(part)
                    elif held:
                        yield from matched(group[0], held, part)
                    low = high

    def unpacked(part: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(part)
        rows, units = _units(whole.column("body").to_pylist(), kind)
        return whole, rows, units, whole.column("id").to_numpy(), whole.column("copies").to_numpy()

    def matched(own: int, held, part) -> Iterator[pa.RecordBatch]:
        whole, rows, _, ids, copies = unpacked(held)
        codes = np.frombuffer(b"".join(whole.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        reach = ((whole.column("error").to_numpy() + radius) ** 2 + 1e-4).astype(np.float32)
        asked = np.frombuffer(b"".join(whole.column("asked").to_pylist()), np.uint8)
        asked = np.unpackbits(asked.reshape(len(ids), -1), axis=1).astype(bool)
        norms = np.linalg.norm(rows, axis=1)
        other, asking, units, names, weights = unpacked([part])
        home = other.column("home").to_numpy()
        for low in range(0, len(names), 128):
            cut = slice(low, low + 128)
            shifted = quantiser.residuals(units[cut], np.full(len(names[cut]), own))
            distance = np.zeros((len(shifted), len(ids)), np.float32)
            for s, book in enumerate(quantiser.books):
                table = (shifted[:, s] ** 2).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * shifted[:, s] @ book.T
                distance += np.take(table.astype(np.float32), codes[:, s], axis=1)
            maybe = distance <= reach[None, :]
            q, m = np.nonzero(maybe)
            mine, theirs = names[cut][q], ids[m]
            once = (mine < theirs) | ((mine > theirs) & ~asked[m, home[cut][q]])
            q, m = q[once], m[once]
            exact = np.zeros(len(q), bool)
            for i in range(0, len(q), 1 << 14):
                x, y = asking[cut][q[i : i + (1 << 14)]], rows[m[i : i + (1 << 14)]]
                dot = (x * y).sum(axis=1)
                exact[i : i + (1 << 14)] = dot / (
                    np.linalg.norm(x, axis=1) * norms[m[i : i + (1 << 14)]]
                ) >= p.cosine
            linked = np.zeros(maybe.shape, bool)
            linked[q[exact], m[exact]] = True
            yield from summed(linked, names[cut], weights[cut], ids, copies)

    def summed(linked, names, weights, ids, copies) -> Iterator[pa.RecordBatch]:
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            return
        linked = linked[np.ix_(rows, cols)]
        left, right = names[rows], ids[cols]
        low, high = left.copy(), right.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_low = np.minimum(low, np.where(linked, high[None, :], top).min(axis=1))
            new_high = np.minimum(high, np.where(linked, new_low[:, None], top).min(axis=0))
            if (new_low == low).all() and (new_high == high).all():
                break
            low, high = new_low, new_high
        counts = np.r_[linked @ copies[cols], weights[rows] @ linked]
        nodes, roots = np.r_[left, right], np.r_[low, high]
        none = np.zeros(len(nodes), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[nodes, nodes]),
                pa.array(np.r_[none, roots], mask=np.r_[none == 0, none == 1]),
                pa.array(np.r_[counts, none]),
            ],
            names=["a", "b", "links"],
        )

    return rows.mapInArrow(run, FOUND)


def near_vectors(vectors: DataFrame, p: VectorParameters | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors are linked if they are found and their cosine in double precision is at least the
    threshold. Vectors
    that are null, empty, zero, or hold a null or non-finite component are linked with nothing;
    shorter vectors count as padded with zeros. Equal vectors are one class, linked among itself
    and counted copy by copy. Rows that share a vec_id are rows of their own, each with its own
    links; ``component_id`` is the smallest vec_id of the group, null only if the group has none, and
    ``kept`` tells whether the two are equal, two nulls included. Other columns are ignored.
    """
    p = p or VectorParameters()
    vectors = vectors.select("vec_id", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    kind = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    rows = kept(prepared(vectors, max(width, 1), kind), "vectors")
    grouped = (
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
    )
    classes = kept(grouped.select("key", F.col("name").alias("id"), "name", "copies", "body"), "vector-classes")
    total, named, distinct = classes.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first()
    if total == 0:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    if not total == named == distinct:  # null or shared ids: numbers in the order of the ids stand for them
        order = [F.col("name").asc_nulls_last(), F.col("key").asc()]
        classes = kept(ordered_numbers(classes.drop("id"), [], order, "id"), "vector-classes")
    # A bounded sample, as a documented parameter; every vector is indexed and searched below.
    fitted = classes.select("id", "body").orderBy(F.xxhash64("id"), "id").limit(p.most_fitted)
    bodies = [bytes(r["body"]) for r in fitted.collect()]
    quantiser = fit(_units(bodies, kind)[1], total, p)
    index = kept(indexed(classes, quantiser, p, kind), "vector-index")

    # At most `most_lists` rows on either side of this join.
    held = index.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("members"))
    asked = index.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("askers"))
    sizes = held.join(asked, "list").select(
        "list",
        F.ceil(F.col("members") / F.lit(p.tile)).cast("int").alias("tiles"),
        F.ceil(F.col("askers") / F.lit(p.block)).cast("int").alias("blocks"),
    )
    sizes = F.broadcast(kept(sizes, "vector-lists"))
    tile = F.pmod(F.xxhash64("id"), "tiles").cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")
    carried = ["id", "copies", "home", "error", "codes", "body", "asked"]
    members = index.withColumn("list", F.col("home")).join(sizes, "list").select(
        "list", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(False).alias("asks"), *carried,
    )
    askers = (
        index.withColumn("list", F.explode("probes"))
        .join(sizes, "list")
        .select(
            "list", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), block.alias("block"),
            F.lit(True).alias("asks"), "id", "copies", "home", F.lit(0.0).alias("error"), F.lit(b"").alias("codes"),
            "body", F.lit(b"").alias("asked"),
        )
    )
    dealt = (
        members.unionByName(askers)
        .repartition("list", "tile", "block")
        .sortWithinPartitions("list", "tile", "block", "asks")
    )
    found = kept(searched(dealt, quantiser, p, kind), "vector-links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    if not total == named == distinct:
        names = classes.select(F.col("id").alias("root"), F.col("name").alias("root_name"))
        roots = roots.join(names, "root")
    else:
        roots = roots.withColumn("root_name", F.col("root"))
    known = (
        classes.select("key", "id", "name", "copies")
        .join(links.withColumnRenamed("a", "id"), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "key",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root_name", "name").alias("component_id"),
        )
    )
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
