"""From image-level scores to identity ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_identity(scores: DataFrame) -> DataFrame:
    """(query_id, side_id, score): an identity scores as its best photo; combines map-side."""
    return scores.groupBy("query_id", "side_id").agg(F.max("score").alias("score"))


def not_finite(scores: DataFrame) -> DataFrame:
    """Score rows that a ranking refuses."""
    s = F.col("score")
    return scores.filter(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("side_id").asc()]


def rank_identities(best: DataFrame) -> DataFrame:
    """Every identity of every query, best first; ties go to the smaller identity."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    return best.select("query_id", "side_id", "score", place.alias("rank"))


def true_rank(best: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank) by counting better identities; no sort. Null rank: truth not in gallery.

    ``truth``: query_id, side_id. The true score comes from an equi-join on (query, identity); the
    count is one partial aggregate per query.
    """
    answer = truth.select("query_id", "side_id").join(best, ["query_id", "side_id"]).select(
        "query_id", F.col("side_id").alias("_truth"), F.col("score").alias("_own")
    )
    better = (F.col("score") > F.col("_own")) | (
        (F.col("score") == F.col("_own")) & (F.col("side_id") < F.col("_truth"))
    )
    ranks = (
        best.join(answer, "query_id")
        .groupBy("query_id")
        .agg((F.count_if(better) + 1).alias("rank"))
    )
    return truth.select("query_id").join(ranks, "query_id", "left")


def best_score(best: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, best): minus infinity for a query without candidates."""
    tops = best.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(tops, "query_id", "left").select(
        "query_id", F.coalesce("best", F.lit(float("-inf"))).alias("best")
    )


def top_candidates(best: DataFrame, k: int) -> DataFrame:
    """(query_id, candidates): the k best as an array of structs, best first.

    The rank filter sits directly on the window, so each task keeps k rows per query before the
    shuffle.
    """
    ranked = rank_identities(best).filter(F.col("rank") <= k)
    listed = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "side_id", "score"))).alias("_all")
    )
    return listed.select(
        "query_id",
        F.transform("_all", lambda c: F.struct(c["side_id"], c["score"])).alias("candidates"),
    )
