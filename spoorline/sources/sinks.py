"""Sinks: write-once tables, the content store, append-only logs, records, and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.keys import store_path
from spoorline.operators.validate import suffix
from spoorline.sources.files import attribute_names, unfold_attributes


def write_once(df: DataFrame, path: str, form: str = "parquet", **options: object) -> None:
    """Never overwrites: an existing path is an error."""
    df.write.mode("errorifexists").format(form).options(**options).save(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest as CSV with its ``attr_`` columns, sorted by image id, once."""
    flat = unfold_attributes(manifest, attribute_names(manifest))
    # leading and trailing spaces are content, and quotes are doubled as the reader expects
    write_once(
        flat.orderBy("image_id"),
        path,
        "csv",
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def plan_store(files: DataFrame) -> DataFrame:
    """Adds each file's content-addressed target; copies of one content share one target."""
    dotted = F.concat(F.lit("."), suffix("relative_path"))
    return files.withColumn("target", store_path("dataset_id", "file_sha256", dotted))


def write_store(files: DataFrame, path: str) -> None:
    """One row of bytes per content, partitioned by dataset and digest prefix.

    Contents that the store holds already are not written again, so ingesting twice changes nothing.
    Bytes that do not hash to their name are refused before anything is written.
    """
    planned = plan_store(files)
    wrong = store_collisions(planned)
    if not wrong.isEmpty():
        named = ", ".join(r["target"] for r in wrong.select("target").distinct().orderBy("target").limit(10).collect())
        raise ValueError(f"content does not match its digest: {named}")
    one = planned.groupBy("dataset_id", "file_sha256").agg(
        F.min("target").alias("target"), F.first("content").alias("content")
    )
    spark = files.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.parquet(path).select("dataset_id", "file_sha256")
        one = one.join(held, ["dataset_id", "file_sha256"], "left_anti")
    cut = one.withColumn("sha2", F.substring("file_sha256", 1, 2))
    cut.repartition("dataset_id", "sha2").write.mode("append").partitionBy("dataset_id", "sha2").parquet(path)


def store_collisions(store: DataFrame) -> DataFrame:
    """Stored rows whose bytes no longer hash to their name."""
    return store.withColumn("actual", F.sha2("content", 256)).filter("actual <> file_sha256").select(
        "target", "file_sha256", "actual"
    )


def verify_store(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(image_id, status): ok, missing, or mismatch, by re-hashing each manifest row's file.

    ``store``: dataset_id, file_sha256, content.
    """
    held = store.select(
        "dataset_id", "file_sha256", F.sha2("content", 256).alias("actual")
    ).groupBy("dataset_id", "file_sha256").agg(F.min("actual").alias("actual"))
    joined = manifest.select("image_id", "dataset_id", "file_sha256").join(
        held, ["dataset_id", "file_sha256"], "left"
    )
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("file_sha256"), "mismatch")
        .otherwise("ok")
    )
    return joined.select("image_id", status.alias("status"))


def artifact_verify(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(pin_id, file, status) of every pinned file against found digests.

    ``files``: file, file_sha256. ``pins``: pin_id, files map of name to digest. Both sides grow
    together, and digests take far more than the columns that a planner judges them by, so neither
    is sent through the driver.
    """
    wanted = pins.select("pin_id", F.explode("files").alias("file", "expected"))
    joined = wanted.join(files.select("file", "file_sha256").hint("merge"), "file", "left")
    status = (
        F.when(F.col("file_sha256").isNull(), "missing")
        .when(F.col("file_sha256") != F.col("expected"), "mismatch")
        .otherwise("ok")
    )
    return joined.select("pin_id", "file", status.alias("status"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_record(df: DataFrame, path: str) -> None:
    """Nested records as JSON with sorted top-level keys, once."""
    write_once(df.select(*sorted(df.columns)), path, "json", ignoreNullFields=False)
