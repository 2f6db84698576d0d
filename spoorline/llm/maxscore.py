"""Exact top-k search by integer inner products, pruned by MaxScore.

Each dimension is a term; its postings in a shard are the rows whose component has the query's sign,
and its bound is the largest product there. Terms whose bounds together stay below a query's k-th
best score are non-essential: a row in no essential posting cannot enter. Rows of essential postings
are scored term by term, from the largest bound, and leave once the rest cannot lift them.

Rows are ordered by a sign signature and cut into shards of ``SHARD``, so rows of a shard are alike
and its bounds are tight. A grid of (query group, shard group) tasks streams shards past a bounded
block of queries, and the tops of all shard groups are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.store import kept
from spoorline.operators.skew import ordered_numbers

SHARD = 4096
CELL_QUERIES = 16_384
SIGNS = 16
STEP = 8
EXACT = float(1 << 53)
LAST = np.iinfo(np.int64).max


def _components(column: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * x) of every vector; such a floor is itself exact in double precision."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    cuts = column.offsets.to_numpy()
    whole = np.floor(values * scale)
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_PLANES: list[np.ndarray] = []


def _signature(vectors: list[np.ndarray]) -> np.ndarray:
    """One bit a random plane; equal vectors have equal signatures."""
    width = max((len(v) for v in vectors), default=0)
    if not _PLANES or len(_PLANES[0]) < width:
        _PLANES[:] = [np.random.default_rng(11).standard_normal((max(width, 64), SIGNS))]
    dense = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    with np.errstate(all="ignore"):
        bits = dense @ _PLANES[0][:width] > 0
    return bits @ (1 << np.arange(SIGNS - 1, -1, -1))


def _signed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _components(batch.column(2), scale)
            blobs = pa.array([v.tobytes() for v in vectors], pa.binary())
            signs = pa.array(_signature(vectors).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs, signs], ["id", "asked", "weights", "sign"])

    return run


def _dense(blobs: list[bytes]) -> np.ndarray:
    """Rows by dimensions; shorter vectors end in zeros."""
    width = max((len(b) for b in blobs), default=0) // 8
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b)
    return out


PACK = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
    ("floors", pa.list_(pa.float64())), ("width", pa.int32()), ("weights", pa.binary()),
])
PACK_DDL = (
    "kind int, shard bigint, ids array<bigint>, places array<bigint>, floors array<double>, width int, weights binary"
)


def _scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as Python integers, for components too large for doubles."""
    return rows.astype(object).dot(query.astype(object)) if len(query) else np.zeros(len(rows), object)


def _integers(a: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object)


def _product(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; what no long can hold ends at the largest or smallest long."""
    reach = np.abs(rows).max(axis=0, initial=0)
    if float(np.abs(query) @ reach) < EXACT:
        return (rows @ query).astype(np.int64)
    whole = _scores(_integers(query), _integers(rows))
    return np.array([max(-LAST - 1, min(LAST, int(x))) for x in whole], np.int64)


def _packed(k: int, size: int):
    """Packs each shard, and its queries with the k-th best score in their own shard as a floor."""

    def pack(shard: int, ids: list, asked: list, blobs: list) -> Iterator[pa.RecordBatch]:
        dense = _dense(blobs)
        base = shard * size
        which = np.flatnonzero(asked)
        out = [{
            "kind": 1, "shard": shard, "ids": ids, "places": [base], "floors": [], "width": dense.shape[1],
            "weights": dense.tobytes(),
        }]
        if len(which):
            floors = []
            for i in which:
                scores = np.delete(_product(dense[i], dense), i)
                floors.append(float(np.partition(scores, -k)[-k]) if len(scores) >= k else -math.inf)
            out.append({
                "kind": 0, "shard": shard, "ids": [ids[i] for i in which], "places": (which + base).tolist(),
                "floors": floors, "width": dense.shape[1], "weights": dense[which].tobytes(),
            })
        for row in out:
            yield pa.RecordBatch.from_pylist([row], PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, ([], [], [])
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != shard:
                    if held[0]:
                        yield from pack(shard, *held)
                    shard, held = row[0], ([], [], [])
                for part, value in zip(held, row[1:], strict=True):
                    part.append(value)
        if held[0]:
            yield from pack(shard, *held)

    return run


class Best:
    """The k best rows of one query so far: by score, then id (null last), then place."""

    __slots__ = ("scores", "ids", "places", "floor", "k")

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores = self.ids = self.places = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        scores, ids, places = (
            np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.places, places))
        )
        order = np.lexsort((places, ids, ~scores))[: self.k]  # ~x falls as x rises, without overflow
        self.scores, self.ids, self.places = scores[order], ids[order], places[order]
        if len(order) == self.k:
            self.floor = max(self.floor, float(self.scores[-1]))


class Shard:
    def __init__(self, row: dict):
        self.rows = np.frombuffer(row["weights"]).reshape(len(row["ids"]), row["width"])
        self.columns = np.ascontiguousarray(self.rows.T)
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        self.base = row["places"][0]
        self.most = self.columns.max(axis=1, initial=0)
        self.least = self.columns.min(axis=1, initial=0)
        self._postings: dict[tuple[int, bool], np.ndarray] = {}

    def postings(self, term: int, positive: bool) -> np.ndarray:
        key = (term, positive)
        if key not in self._postings:
            column = self.columns[term]
            self._postings[key] = np.flatnonzero(column > 0 if positive else column < 0)
        return self._postings[key]

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: Best) -> None:
        """Offer the rows that may enter; ``bounds`` are the terms' largest products here."""
        n = len(self.ids)
        if float(np.abs(query) @ np.maximum(self.most, -self.least)) >= EXACT:
            rows, scores = np.arange(n), _product(query, self.rows)
        else:
            order = np.argsort(bounds)
            total = np.cumsum(bounds[order])
            light = int(np.searchsorted(total, best.floor, "left"))
            if best.floor == -math.inf:
                rows = np.arange(n)
            else:
                seen = np.zeros(n, bool)
                for t in order[light:][::-1]:
                    seen[self.postings(t, query[t] > 0)] = True
                rows = np.flatnonzero(seen)
            sums = np.zeros(len(rows))
            for high in range(len(order), 0, -STEP):  # the largest bounds first
                terms = order[max(0, high - STEP) : high]
                sums += query[terms] @ self.columns[np.ix_(terms, rows)]
                rest = total[high - STEP - 1] if high > STEP else 0.0
                stays = sums + rest >= best.floor
                if not stays.all():
                    rows, sums = rows[stays], sums[stays]
                if not len(rows):
                    return
            scores = sums.astype(np.int64)
        if 0 <= own - self.base < n:
            other = rows != own - self.base
            rows, scores = rows[other], scores[other]
        best.add(scores, self.ids[rows], rows + self.base)


def _searched(k: int):
    schema = pa.schema([("query_place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("place", pa.int64()), ("score", pa.int64())])

    def results(asked: list) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(asked), 1024):
            some = asked[low : low + 1024]
            sizes = [len(best.scores) for *_, best in some]
            gather = lambda name: np.concatenate([getattr(best, name) for *_, best in some] or [np.zeros(0, np.int64)])
            ids = gather("ids")
            columns = [
                pa.array(np.repeat([place for place, *_ in some], sizes).astype(np.int64)),
                pa.array([i for (_, i, *_), n in zip(some, sizes, strict=True) for _ in range(n)], pa.int64()),
                pa.array(ids, mask=ids == LAST),
                pa.array(gather("places")),
                pa.array(gather("scores")),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def offer(asked: list, shard: Shard) -> None:
        width = max([len(shard.most), *(len(q) for _, _, q, _ in asked)])
        grow = lambda a: np.pad(a, (0, width - len(a)))
        if len(shard.most) < width:
            shard.columns = np.vstack([shard.columns, np.zeros((width - len(shard.most), len(shard.ids)))])
            shard.rows = shard.columns.T
            shard.most, shard.least = grow(shard.most), grow(shard.least)
        for low in range(0, len(asked), 1024):
            some = asked[low : low + 1024]
            queries = np.stack([grow(q) for _, _, q, _ in some])
            with np.errstate(all="ignore"):
                bounds = np.maximum(queries * shard.most, queries * shard.least)
                reach = bounds.sum(axis=1)
            for i, (place, _, _, best) in enumerate(some):
                if not reach[i] < best.floor:
                    shard.search(queries[i], place, bounds[i], best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from results(asked)
                    cell, asked = row["cell"], []
                if row["kind"] == 1:
                    if asked:
                        offer(asked, Shard(row))
                    continue
                dense = np.frombuffer(row["weights"]).reshape(len(row["ids"]), row["width"])
                for place, i, floor, q in zip(row["places"], row["ids"], row["floors"], dense, strict=True):
                    asked.append((place, i, q, Best(k, floor)))
        yield from results(asked)

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query row.

    ``vectors`` holds vec_id and embedding; rows for which ``asked`` is true are queries, all rows but
    the query's own are candidates. Components become floor(scale * x). Ties go to the smaller
    vec_id, a null one last. A null vector, or one with a null or non-finite component, takes no part;
    a shorter vector ends in zeros; an empty or zero one scores 0. Rows that share a vec_id are rows
    of their own: each is asked and found separately. A score that no long holds is the nearest long.
    Fewer than k candidates are all returned; an empty table gives no rows.

    Every row of vectors is sent once per ``CELL_QUERIES`` queries, so the work is queries x rows less
    what bounds rule out; no pair of rows leaves a task, only k rows per query and shard group.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(F.col("embedding").isNotNull() & ~odd)
    signed = rows.mapInArrow(_signed(scale), "id bigint, asked boolean, weights binary, sign int")
    order = [F.col("sign").asc(), F.col("id").asc(), F.xxhash64("weights").asc(), F.col("weights").asc()]
    placed = ordered_numbers(signed, [], order, "place").withColumn("place", F.col("place") - 1)
    shard = F.expr(f"place div {SHARD}").alias("shard")
    packed = kept(
        placed.select(shard, "id", "asked", "weights", "place")
        .repartition("shard")
        .sortWithinPartitions("shard", "place")
        .select("shard", "id", "asked", "weights")
        .mapInArrow(_packed(k, SHARD), PACK_DDL),
        "shards",
    )
    size = packed.agg(F.max("shard").alias("last"), F.sum(F.when(F.col("kind") == 0, F.size("ids"))).alias("asked")).first()
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, math.ceil((size["asked"] or 0) / CELL_QUERIES))
    lines = max(1, min((size["last"] or 0) + 1, math.ceil(tasks / columns)))
    spread = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell))
    fields = ["kind", "shard", "ids", "places", "floors", "width", "weights"]
    shards = packed.filter("kind = 1").withColumn("cell", spread(columns, lambda c: c * lines + F.col("shard") % lines))
    queries = packed.filter("kind = 0").withColumn("cell", spread(lines, lambda r: F.col("shard") % columns * lines + r))
    found = (
        shards.unionByName(queries)
        .select("cell", *fields)
        .repartition(columns * lines, "cell")
        .sortWithinPartitions("cell", "kind", "shard")
        .mapInArrow(_searched(k), "query_place bigint, query_id bigint, vec_id bigint, place bigint, score bigint")
    )
    best = Window.partitionBy("query_place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "place")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


CHECK = """
with row as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as w
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (select q.rid, q.vec_id as query_id, v.vec_id, list_inner_product(q.w, v.w)::bigint as score, v.rid as other
  from row q join row v on v.rid <> q.rid where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by rid order by score desc, vec_id nulls last, other)::int as rank from pair)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
