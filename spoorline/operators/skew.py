"""Building blocks that keep one hot key from landing in one task.

A window partitioned by a key sends the whole key to one task. These helpers give the same answers
from partial aggregates, range partitions and broadcasts whose size has a proven bound. Joins are
plain: adaptive execution splits the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import durable


def with_group_facts(
    df: DataFrame, keys: Sequence[str], facts: Sequence[Column], having: Column | None = None
) -> DataFrame:
    """Add per-group aggregates to every row (keys must not be null).

    One aggregate, which combines before the shuffle, and one join; ``having`` keeps only rows of
    some groups, and filters the groups before they are joined.
    """
    grouped = df.groupBy(*keys).agg(*facts)
    return df.join(grouped if having is None else grouped.filter(having), list(keys), "inner")


def hash_ordered_numbers(
    df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], name: str, digits: int = 2
) -> DataFrame:
    """row_number() per key in order of a hex digest, split over 16**digits buckets per key.

    Digests are uniform, so a hot key spreads evenly over its buckets; bucket totals (at most
    16**digits rows per key) give each bucket its starting number.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", F.substring(digest, 1, digits))
    totals = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest, *ties)
    numbered = cut.withColumn("_local", F.row_number().over(inside))
    return (
        numbered.join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_local") + F.col("_start")).cast("bigint"))
        .drop("_bucket", "_local", "_start")
    )


def ordered_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """row_number() per key in any order, without gathering a key in one task.

    Rows are range-partitioned on (keys, order), so a hot key spans many partitions. A key that
    spans partitions is numbered from the counts of the partitions before it. At most two such
    (partition, key) rows exist per partition boundary, which bounds the broadcast.
    """
    keys = list(keys)
    ranged = durable(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    sizes = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_size"))
    if keys:
        spanning = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1")
        sizes = sizes.join(F.broadcast(spanning.drop("_parts")), keys, "left_semi")
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "_part", *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .join(F.broadcast(starts), ["_part", *keys], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_start", F.lit(0))).cast("bigint"))
        .drop("_part", "_local", "_start")
    )


def running_total(
    df: DataFrame, position: str, value: str, name: str, length: int, span: int = 4096
) -> DataFrame:
    """Running sum over a dense integer position up to ``length``, as a tree of spans.

    Each window holds at most ``span`` rows: of one span, or of the totals of ``span`` spans, whose
    own running sum is taken the same way one level up.
    """
    inside = Window.partitionBy("_span").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = df.withColumn("_span", F.floor(F.col(position) / F.lit(span)))
    local = cut.withColumn(name, F.sum(value).over(inside))
    if length < span:  # all positions, from 0 or 1, are in the first span
        return local.drop("_span")
    totals = cut.groupBy("_span").agg(F.sum(value).alias("_total")).withColumnRenamed("_span", "_at")
    before = running_total(totals, "_at", "_total", "_upto", length // span, span).select(
        F.col("_at").alias("_span"), (F.col("_upto") - F.col("_total")).alias("_start")
    )
    return local.join(before, "_span").withColumn(name, F.col(name) + F.col("_start")).drop("_span", "_start")


def lookup(
    rows: DataFrame,
    key: str | Sequence[str],
    facts: DataFrame,
    facts_key: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join rows to a table that is unique on its key; the planner picks how, and splits hot keys."""
    keys = [key] if isinstance(key, str) else list(key)
    if facts_key and facts_key != keys[0]:
        facts = facts.withColumnRenamed(facts_key, keys[0])
    return rows.join(facts, keys, how)
