"""Sharding by weighted rendezvous hashing; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, whose score for the key is highest.

    A score is -weight / ln(u), u uniform from a digest of key and shard, so each shard wins with
    probability weight / sum(weights). The key and a shard alone decide a score: a shard that is
    added or made heavier only draws keys to itself. Equal scores go to the larger u, then to the
    smaller shard. A null key counts as the empty one; weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    shards = F.array(*[
        F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)
    ])
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(s: Column) -> Column:
        digest = F.md5(F.concat(name, F.lit(":"), s["shard"].cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-s["weight"] / F.log(u)).alias("score"), u.alias("u"), (-s["shard"]).alias("back"))

    return -F.array_max(F.transform(shards, score))["back"]


def numbered(rows: DataFrame, shard: str, key: str, name: str) -> DataFrame:
    """Add a gapless number from 0 within each shard, by digest bucket of the key, then by key.

    A shard is cut into 4,096 buckets by a digest, so no task sorts a whole shard; the bucket totals,
    at most 4,096 rows a shard, say where each bucket starts. Repeated keys are numbered in any order.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    cut = rows.withColumn("_bucket", F.substring(F.md5(text.cast("binary")), 1, BUCKET_DIGITS))
    totals = cut.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(key)
    return (
        cut.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, [shard, "_bucket"])
        .withColumn(name, (F.col("_place") + F.col("_start")).cast("bigint"))
        .drop("_bucket", "_place", "_start")
    )


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law ``key``.

    ``size`` is the text's UTF-8 bytes plus one; a null text has none and the crc32 of no bytes, 0.
    ``grown_shard`` is the shard with one more shard: the same, or the new one. Rows of one doc_id
    share a shard. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * shards).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", "doc_id", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_sharded(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 1) -> None:
    """Write the rows in folders shard=0, shard=1, ... of about ``files`` files each."""
    placed = docs.withColumn("shard", rendezvous(F.col(key), weights).cast("int"))
    salt = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(len(weights) * files, "shard", salt).write.partitionBy("shard").parquet(path)


_DIGEST = "md5(coalesce(doc_id::varchar, '') || ':' || k)"
CHECK = f"""
with recursive step(n, k, c) as (
  select n, 0, n::bigint from range(256) t(n)
  union all
  select n, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc as (select list(c order by n) as t from step where k = 8),
row as (select doc_id, encode(coalesce(text, '')) as body from documents),
summed as (select doc_id, octet_length(body) + 1 as size, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(octet_length(body)),
      lambda i: ('0x' || substr(hex(body), 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32 from row, crc),
score as (select doc_id, k, substr({_DIGEST}, 1, 13) as u from documents, range(17) t(k)),
best as (select doc_id, arg_max(k, u) filter (where k < 16) as shard, arg_max(k, u) as grown_shard
  from score group by doc_id)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  (row_number() over (partition by shard
    order by substr(md5(coalesce(doc_id::varchar, '')), 1, 3), doc_id) - 1)::bigint as slot,
  grown_shard::int as grown_shard
from summed join best using (doc_id)
"""
