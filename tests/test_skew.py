"""Helpers against plain joins and sorts, with a third of the rows under one key."""

from support import rows
from pyspark.sql import functions as F

from spoorline.operators.skew import (
    hash_ordered_numbers,
    lookup,
    ordered_numbers,
    running_total,
    with_group_facts,
)


def skewed(spark):
    """300 rows, a third of them under one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(300).select("id", key.alias("k"), (F.col("id") * 7 % 101).alias("v"))


def test_group_facts_with_hot_keys(spark):
    df = skewed(spark)
    facts = [F.min("v").alias("low")]
    low = {r["k"]: r["low"] for r in df.groupBy("k").agg(*facts).collect()}
    got = with_group_facts(df, ["k"], facts)
    assert rows(got, "id", "k", "low") == sorted((r["id"], r["k"], low[r["k"]]) for r in df.collect())


def test_group_facts_having(spark):
    df = skewed(spark)
    several = with_group_facts(
        df, ["v"], [F.count(F.lit(1)).alias("n")], having=F.col("n") > 2
    )
    assert {r["n"] for r in several.collect()} == {3}


def test_lookup_with_hot_and_null_keys(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("id") % 10 != 1, F.col("k")))
    facts = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, f int")
    got = rows(lookup(df, "k", facts, how="left"), "id", "f")
    want = rows(df.join(facts, "k", "left"), "id", "f")
    assert sorted(got, key=str) == sorted(want, key=str)
    inner = lookup(df, "k", facts)
    assert rows(inner, "id", "f") == rows(df.join(facts, "k"), "id", "f")


def _expected(df, keys, order):
    out, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: tuple(r[c] for c in [*keys, *order])):
        k = tuple(r[c] for c in keys)
        seen[k] = seen.get(k, 0) + 1
        out[r["id"]] = seen[k]
    return out


def test_ordered_numbers_across_partitions(spark):
    df = skewed(spark)
    for keys in ([], ["k"]):
        got = ordered_numbers(df, keys, [F.col("v"), F.col("id")], "n")
        assert {r["id"]: r["n"] for r in got.collect()} == _expected(df, keys, ["v", "id"])


def test_hash_ordered_numbers(spark):
    df = skewed(spark).withColumn("d", F.sha2(F.col("id").cast("string"), 256))
    for keys in ([], ["k"]):
        got = hash_ordered_numbers(df, keys, "d", ["id"], "n", digits=1)
        assert {r["id"]: r["n"] for r in got.collect()} == _expected(df, keys, ["d", "id"])


def test_running_total(spark):
    """Three levels of spans, and a single one."""
    df = spark.range(1, 401).select(F.col("id").alias("p"), (F.col("id") % 4).alias("v"))
    for span in (7, 4096):
        got = {r["p"]: r["t"] for r in running_total(df, "p", "v", "t", 400, span=span).collect()}
        assert got == {p: sum(q % 4 for q in range(1, p + 1)) for p in range(1, 401)}
