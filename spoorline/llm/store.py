"""Intermediate tables in the shared folder, and connected components over links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import shared_dir


def place(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder that the cluster names."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once and read from the shared folder: lost executors repeat no earlier work."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``kept`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable.

    Large-star and small-star rounds until nothing changes. Each round is two aggregates that combine
    before the shuffle and two joins on a unique side, and is written to the shared folder.
    """
    edges = kept(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        following = kept(small.distinct(), "links")
        dropped(edges)
        edges, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    )
