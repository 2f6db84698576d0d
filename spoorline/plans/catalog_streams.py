"""Registered streaming twins: each drains a given table as a stream; the checks are the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators.keys import fold_attributes
from spoorline.plans.catalog_field import ISO, QUOTA, REPLAY
from spoorline.plans.catalog_sets import ACCEPTED, BURST, BURST_GROUPS
from spoorline.plans.registry import query, scratch, stamp
from spoorline.sources.adapters import micros_to_time, table, view
from spoorline.streaming import twins


FILES_PER_BATCH = 64


def whole_log(clock: DataFrame, per_ms: int = 1) -> twins.Arrival:
    """The files of a table have no order of arrival, so its rows wait until its log is closed."""
    return twins.Arrival(4 * 10**12 * per_ms, per_ms, clock)


def stream_of(
    spark: SparkSession, sf: str, name: str, files_per_batch: int = FILES_PER_BATCH
) -> dict[str, DataFrame]:
    """The table as a file stream with the schema of its batch form.

    A table is one file or a folder of part files; the pattern matches either. A micro-batch reads
    a bounded number of files.
    """
    source = spark.readStream.schema(table(spark, sf, name).schema)
    source = source.option("maxFilesPerTrigger", files_per_batch)
    return {name: source.parquet(f"{sf}/{name}.parque[t]")}


@query("stream_attach_quota", QUOTA.replace("m.id, ", "").replace(
    ",\n    coalesce(case when place <= 5 then cast(first_seq as string) end, '') as stored_seq", ""
))
def stream_attach_quota(spark, sf):
    media = view(spark, sf, "media_v", stream_of(spark, sf, "lineitem"))
    ready = media.filter("status = 'READY'")
    done = twins.drained(
        spark, scratch(spark, "quota"), lambda clock: twins.stream_attach_quota(ready, arrival=whole_log(clock, 10**6))
    )
    return done.drop("late")


@query("stream_seal_guard", ACCEPTED + " select seq, accepted, registered from judged")
def stream_seal_guard(spark, sf):
    log = view(spark, sf, "seal_log_v", stream_of(spark, sf, "events"))
    requests = log.withColumn("registered_configs", F.array("config_sha256", "also_registered"))
    done = twins.drained(
        spark, scratch(spark, "guard"), lambda clock: twins.stream_seal_guard(requests, whole_log(clock))
    )
    return done.drop("late").withColumn("registered", F.array_join("registered", ","))


@query(
    "stream_bootstrap",
    f"""select provider, provider_subject, {ISO.format('min(at_us)')} as created_at,
  {ISO.format('max(at_us)')} as last_login_at from login_log_v where trim(provider) <> ''
  group by 1, 2""",
)
def stream_bootstrap(spark, sf):
    log = micros_to_time(view(spark, sf, "login_log_v", stream_of(spark, sf, "events")))
    kept = twins.run_to_table(twins.stream_bootstrap(log), scratch(spark, "logins"), "update")
    return kept.groupBy("provider", "provider_subject").agg(
        stamp(F.min("created_at")).alias("created_at"),
        stamp(F.max("last_login_at")).alias("last_login_at"),
    )


@query(
    "stream_replay_encounters", REPLAY + " select encounter_id, seq, outcome from fold where step > 0"
)
def stream_replay_encounters(spark, sf):
    log = micros_to_time(view(spark, sf, "edit_log_v", stream_of(spark, sf, "events")))
    parks, zones = view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    done = twins.drained(
        spark,
        scratch(spark, "edits"),
        lambda clock: twins.stream_replay_encounters(log, parks, zones, whole_log(clock)),
    )
    return done.drop("late")


@query(
    "stream_burst_sessions",
    BURST_GROUPS
    + f""" select 'ev:' || who || ':left' as side_id, aware, {ISO.format('min(us)')} as first_at,
  {ISO.format('max(us)')} as last_at, cast(count(*) as bigint) as images, min(image_id) as burst
  from runs group by who, aware, run""",
)
def stream_burst_sessions(spark, sf):
    captures = fold_attributes(view(spark, sf, "captures_v", stream_of(spark, sf, "events")))
    stream = twins.stream_burst_sessions(captures, BURST, lateness="40 days")
    kept = twins.run_to_table(stream, scratch(spark, "bursts"), "complete")
    last = kept.agg(F.max("batch").alias("b")).first()["b"]
    done = kept.filter(F.col("batch") == last).drop("batch")
    return done.withColumns({"first_at": stamp("first_at"), "last_at": stamp("last_at")})


