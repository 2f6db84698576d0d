import math

import pytest
from support import rows
from pyspark.sql import functions as F

from spoorline.functions.stats import rate, wilson_interval
from spoorline.operators import metrics, ranking


def ranks_of(spark, values):
    return spark.createDataFrame(
        [(f"q{i}", r) for i, r in enumerate(values)], "query_id string, rank bigint"
    )


def bests_of(spark, values, letter="q"):
    return spark.createDataFrame(
        [(f"{letter}{i}", float(v)) for i, v in enumerate(values)], "query_id string, best double"
    )


def test_best_photo_per_identity_and_tie_order(spark):
    scores = spark.createDataFrame(
        [("q", "k", 0.15), ("q", "k", 0.35), ("q", "m", 0.35), ("q", "d", 0.35), ("q", "x", 0.8), ("q", "m", 0.1)],
        "query_id string, side_id string, score double",
    )
    ranked = ranking.rank_identities(ranking.best_per_identity(scores))
    order = [(r[1], r[2]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert order == [("x", 0.8), ("d", 0.35), ("k", 0.35), ("m", 0.35)]


def test_true_rank_counts_and_reports_absent_truth(spark):
    best = spark.createDataFrame(
        [("q1", "a", 0.9), ("q1", "b", 0.9), ("q1", "c", 0.1), ("q2", "a", 0.3)],
        "query_id string, side_id string, score double",
    )
    truth = spark.createDataFrame(
        [("q1", "b"), ("q2", "z")], "query_id string, side_id string"
    )
    got = {r["query_id"]: r["rank"] for r in ranking.true_rank(best, truth).collect()}
    assert got == {"q1": 2, "q2": None}


def test_closed_set_hand_case(spark):
    places = [3, 1, 6, 1, 2, 8, 1, 5]
    row = metrics.closed_set_metrics(ranks_of(spark, places)).first()
    rates = (row["n"], row["top1_rate"], row["top3_rate"], row["top5_rate"])
    assert rates == (8, 3 / 8, 5 / 8, 6 / 8)
    assert row["mrr"] == pytest.approx((3 + 1 / 2 + 1 / 3 + 1 / 5 + 1 / 6 + 1 / 8) / 8)
    curve = metrics.cmc_curve(ranks_of(spark, places), 8)
    assert [r[1] * 8 for r in rows(curve)] == [3, 4, 5, 5, 6, 7, 7, 8]


def test_wilson_values(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int")
    got = [r[0] for r in df.select(wilson_interval("k", "n")).collect()]
    assert got[0]["lo"] == pytest.approx(0.4902, abs=1e-4)
    assert got[0]["hi"] == pytest.approx(0.9433, abs=1e-4)
    assert tuple(got[1]) == (0.0, 1.0)
    empty = df.select(rate("k", "n").alias("r")).collect()[1]["r"]
    assert math.isnan(empty["rate"])


# fifty scores, 0.02 apart, in no order
SCORES = [(7 * i % 50) / 50 for i in range(50)]


def test_calibration(spark):
    unknown = bests_of(spark, SCORES)
    row = metrics.calibrate_threshold(unknown, 0.06).first()
    assert row["n"] == 50 and row["boundary"] == 0.92
    assert row["threshold"] == math.nextafter(0.92, math.inf)
    assert sum(s >= row["threshold"] for s in SCORES) == 3
    assert metrics.calibrate_threshold(unknown, 0.0).first()["threshold"] > 0.98
    tied = [0.7] * 6 + [0.25, 0.3, 0.9]
    threshold = metrics.threshold_value(metrics.calibrate_threshold(bests_of(spark, tied), 0.5))
    assert sum(s >= threshold for s in tied) == 1


def test_calibration_refusals(spark):
    with pytest.raises(ValueError):
        metrics.calibrate_threshold(bests_of(spark, SCORES), 1.0)
    empty = metrics.calibrate_threshold(bests_of(spark, [0.1]).limit(0), 0.1)
    with pytest.raises(ValueError):
        metrics.threshold_value(empty)


def test_open_set_hand_case(spark):
    row = metrics.open_set_metrics(
        ranks_of(spark, [1, 1, 4, 2, 1]),
        bests_of(spark, [0.45, 0.31, 0.62, 0.77, 0.4]),
        bests_of(spark, [0.12, 0.4, 0.39, 0.05], "u"),
        0.4,
    ).first()
    assert row["known_acceptance_rate"] == pytest.approx(4 / 5)
    assert row["false_rejection_rate"] == pytest.approx(1 / 5)
    assert row["top1_after_rate"] == pytest.approx(2 / 5)
    assert row["top3_after_rate"] == pytest.approx(3 / 5)
    assert row["unknown_false_accept_rate"] == 1 / 4


def test_strata_flag_small_groups(spark):
    ranks = ranks_of(spark, [1, 9, 2, 1, 7]).withColumn(
        "light", F.element_at(F.array(*[F.lit(v) for v in ["sun", "sun", "shade", "shade", ""]]),
                              (F.substring("query_id", 2, 1).cast("int") + 1))
    )
    got = {r["value"]: (r["n"], r["top_k_rate"], r["reportable"])
           for r in metrics.stratify(ranks, "light", k=5, min_n=2).collect()}
    assert got == {"sun": (2, 0.5, True), "shade": (2, 1.0, True), "unrecorded": (1, 0.0, False)}


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0, 10.0, 4.0], list(range(41))])
def test_latency_summary(spark, values):
    import statistics

    df = spark.createDataFrame([(float(v),) for v in values], "ms double")
    row = metrics.latency_summary(df, "ms").first()
    ordered = sorted(map(float, values))
    if not ordered:
        assert tuple(row) == (0.0, 0.0, 0.0)
        return
    index = min(len(ordered) - 1, round(0.95 * (len(ordered) - 1)))
    assert tuple(row) == (statistics.median(ordered), ordered[index], ordered[-1])


def test_compare_records(spark):
    kind = "path string, kind string, text string, number double"
    a = spark.createDataFrame(
        [("x", "number", None, 1.0), ("y", "number", None, math.nan), ("z", "text", "k", None)], kind
    )
    b = spark.createDataFrame(
        [("x", "number", None, 1.0 + 1e-12), ("y", "number", None, math.nan), ("z", "text", "l", None),
         ("w", "number", None, 1.0)],
        kind,
    )
    found = metrics.compare_metric_tables(a, b)
    assert rows(found, "path", "problem") == [
        ("w", "present in only one run"),
        ("z", "value differs"),
    ]


def test_compare_lists_reports_uneven_length_once(spark):
    schema = "run string, cmc array<double>, tags array<string>"
    a = spark.createDataFrame([("r", [0.5, 1.0], ["x"])], schema)
    b = spark.createDataFrame([("r", [0.5, 0.9, 1.0], ["y"])], schema)
    flat = [metrics.flatten_record(d, "run", ["cmc", "tags"]) for d in (a, b)]
    assert rows(metrics.compare_metric_tables(*flat), "path", "problem") == [
        ("r.cmc.length", "length differs"),
        ("r.tags[0]", "value differs"),
    ]


def test_selection_with_ties_and_odd_values(spark):
    """Nine tenths tie; negative, zero, infinite and NaN values keep their order; every rank is right."""
    import math

    values = [0.25] * 900 + [0.25 + i * 1e-9 for i in range(1, 40)] + [-3.5, -0.0, 0.0, math.inf, -math.inf, math.nan, 1e-310]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "best double").repartition(7)
    order = sorted(values, key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
    for few in (4096, 2):
        before, metrics.FEW = metrics.FEW, few
        try:
            wanted = {f"r{i}": i for i in (1, 2, 3, 5, 6, 500, 906, 910, 930, len(values) - 1, len(values))}
            row = metrics.value_at_ranks(df, "best", lambda n: wanted).first().asDict()
        finally:
            metrics.FEW = before
        assert row.pop("n") == len(values)
        for name, value in row.items():
            expected = order[wanted[name] - 1]
            assert value == expected or (math.isnan(value) and math.isnan(expected))
    assert metrics.value_at_ranks(df.limit(0), "best", lambda n: {"x": 1}).first() == (0, None)
