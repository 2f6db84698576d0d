"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own.

    It names its own shared folder: on one machine, a temporary folder is shared by all tasks.
    """
    shared = tempfile.mkdtemp(prefix="spark-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spoorline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", shared)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC: every timestamp rule here is stated in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_FALLBACK:
        _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL_FALLBACK[0]


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so a lost executor costs no rerun of the loop."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
