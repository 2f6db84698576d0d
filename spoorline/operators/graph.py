"""Connected components and leakage groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.dedup import burst_pairs, frame_links, link_union, near_links
from spoorline.operators.keys import side_id
from spoorline.operators.skew import lookup, with_group_facts
from spoorline.session import durable


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], int(row["s"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); the root is the smallest node.

    Alternating large-star and small-star rounds, each two partial aggregates and two joins on a
    unique side. Rounds grow with the logarithm of a chain's length, and each ends in a durable
    cut, so plans stay flat and a lost executor repeats one round at most.
    """
    current = durable(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _fingerprint(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("low"))
        nearest = nearest.select("u", F.least("u", "low").alias("low"))
        large = (
            lookup(both, "u", nearest)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = lookup(large, "u", lowest).select(
            F.col("v").alias("u"), F.col("low").alias("v")
        )
        small = moved.filter("u <> v").unionByName(lowest.select("u", F.col("low").alias("v")))
        current = durable(small.distinct())
        previous, mark = mark, _fingerprint(current)
        if mark == previous:
            break
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def leakage_groups(
    manifest: DataFrame, near_pairs: DataFrame, burst_seconds: float = 0.0
) -> DataFrame:
    """(image_id, side_id, group): images that may not be separated; group is g:<smallest id>.

    Sessions collapse first, so the graph holds one node per session rather than per image. Links
    across identities are conflicts, reported by ``conflicts`` and never merged here. ``near_pairs``
    may name images that ``manifest`` leaves out.
    """
    session = F.coalesce("capture_session_id", F.lit("")).alias("session")
    rows = durable(manifest.select("image_id", side_id().alias("side_id"), session))
    sessions = durable(
        with_group_facts(
            rows,
            ["side_id", "session"],
            [F.min("image_id").alias("rep")]
        ).select("image_id", "side_id", "rep")
    )
    links = [frame_links(manifest, within_side=True), near_links(manifest, near_pairs)]
    if burst_seconds > 0:
        links.append(burst_pairs(manifest, burst_seconds))
    linked = durable(link_union(*links))
    left = sessions.toDF("a", "side_a", "rep_a")
    right = sessions.toDF("b", "side_b", "rep_b")
    crossing = (
        lookup(linked, "a", left)
        .join(right, "b")
        .filter((F.col("side_a") == F.col("side_b")) & (F.col("rep_a") != F.col("rep_b")))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    roots = components(crossing)
    grouped = lookup(sessions, "rep", roots, "node", how="left")
    return grouped.select(
        "image_id",
        "side_id",
        F.concat(F.lit("g:"), F.coalesce("root", "rep")).alias("group"),
    )
