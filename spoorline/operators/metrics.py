"""Closed- and open-set metrics, calibration, strata, examples and run comparison.

Every function aggregates a per-query table; the results are one row or one row per stratum.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.stats import rate, share, wilson_interval
from spoorline.operators.keys import with_keys
from spoorline.operators.skew import running_total
from spoorline.session import durable

DEFAULT_KS = (1, 3, 5)
EXAMPLES = 10


def _rate_columns(name: str, count: Column, n: Column) -> list[Column]:
    r = rate(count, n)
    return [
        r["count"].alias(f"{name}_count"),
        r["rate"].alias(f"{name}_rate"),
        r["lo"].alias(f"{name}_lo"),
        r["hi"].alias(f"{name}_hi"),
    ]


def closed_set_metrics(ranks: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """One row: n, mrr, and count, rate and interval of each top-k."""
    counted = ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(1 / F.col("rank")), F.lit(float("nan"))).alias("mrr"),
        *[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks],
    )
    columns = [c for k in ks for c in _rate_columns(f"top{k}", F.col(f"_{k}"), F.col("n"))]
    return counted.select("n", "mrr", *columns)


def cmc_curve(ranks: DataFrame, gallery_size: int) -> DataFrame:
    """(k, share) for k = 1..gallery_size: a histogram and a running sum over a tree of spans."""
    spark = ranks.sparkSession
    n = ranks.count()
    histogram = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("hits"))
    grid = spark.range(1, gallery_size + 1).withColumnRenamed("id", "k")
    filled = grid.join(histogram, F.col("k") == F.col("rank"), "left").select(
        "k", F.coalesce("hits", F.lit(0)).alias("hits")
    )
    return running_total(filled, "k", "hits", "within", gallery_size).select(
        "k", share("within", F.lit(n)).alias("share")
    )


DIGIT = 16
FEW = 1 << DIGIT


def _order_key(value: str) -> Column:
    """A long that orders as the double does; NaN is last."""
    bits = F.expr(f"cast(java_method('java.lang.Double', 'doubleToLongBits', {value}) as bigint)")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _key_value(key: int) -> float:
    bits = key ^ ((1 << 63) - 1) if key < 0 else key
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def selected(counts: DataFrame, ranks: Callable[[int], dict[str, int]]) -> tuple[int, dict[str, float]]:
    """(n, the values at 1-based ascending ranks), from (_key, _n): counts of distinct order keys.

    Selection by digits: each round counts the keys below each prefix still in question by their next
    ``DIGIT`` bits, and the digit that holds the rank joins the prefix. Nothing is sorted or moved;
    the driver sees at most 2**DIGIT counts a prefix, or the last ``FEW`` keys themselves.
    """

    def digits(prefix: int, bits: int) -> list[tuple[int, int, int]]:
        shift = 64 - bits - DIGIT
        rows = counts if not bits else counts.filter(F.shiftright("_key", 64 - bits) == F.lit(prefix))
        digit = F.shiftright("_key", shift) if shift else F.col("_key")
        grouped = rows.groupBy(digit.cast("bigint").alias("next")).agg(
            F.sum("_n").alias("n"), F.count(F.lit(1)).alias("keys")
        )
        return sorted(tuple(r) for r in grouped.collect())

    def keys(prefix: int, bits: int) -> list[tuple[int, int]]:
        at = F.shiftright("_key", 64 - bits) if bits < 64 else F.col("_key")
        return sorted(tuple(r) for r in counts.filter(at == F.lit(prefix)).select("_key", "_n").collect())

    seen = {(0, 0): digits(0, 0)}
    total = sum(n for _, n, _ in seen[0, 0])
    open_ = {name: (0, 0, rank) for name, rank in ranks(total).items()} if total else {}
    found: dict[str, float] = {}
    while open_:
        for prefix, bits in {x[:2] for x in open_.values()} - seen.keys():
            seen[prefix, bits] = digits(prefix, bits)
        short: dict[tuple[int, int], list[str]] = {}
        for name, (prefix, bits, rank) in list(open_.items()):
            for following, n, distinct in seen[prefix, bits]:
                if rank <= n:
                    open_[name] = (following, bits + DIGIT, rank)
                    if distinct <= FEW:
                        short.setdefault((following, bits + DIGIT), []).append(name)
                    break
                rank -= n
        for at, names in short.items():
            last = keys(*at)
            for name in names:
                rank = open_.pop(name)[2]
                for key, n in last:
                    if rank <= n:
                        found[name] = _key_value(key)
                        break
                    rank -= n
    return total, found


def value_at_ranks(
    df: DataFrame, value: str, ranks: Callable[[int], dict[str, int]]
) -> DataFrame:
    """One row: n and the values at 1-based ascending ranks, which ``ranks`` derives from n.

    Values are doubles. Equal ones are counted before the shuffle, so ties cost one row a task.
    """
    double = df.select((F.col(value).cast("double") + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull())
    counts = double.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = durable(counts.select(_order_key("_v").alias("_key"), "_n"))
    n, found = selected(counts, ranks)
    schema = ", ".join(["n bigint", *(f"{k} double" for k in ranks(n))])
    return df.sparkSession.createDataFrame([(n, *(found.get(k) for k in ranks(n)))], schema)


def calibrate_threshold(unknown_best: DataFrame, target_far: float = 0.05) -> DataFrame:
    """(n, boundary, threshold): accept a best score above boundary, i.e. >= threshold.

    Boundary is the (floor(target * n) + 1)-th highest unknown score, so ties stay below target.
    """
    if not 0 <= target_far < 1:
        raise ValueError("target_far must be in [0, 1)")
    picked = value_at_ranks(
        unknown_best, "best", lambda n: {"boundary": n - math.floor(target_far * n)}
    )
    return picked.select(
        "n",
        "boundary",
        F.when(
            F.col("boundary").isNotNull(),
            F.expr("java_method('java.lang.Math', 'nextUp', coalesce(boundary, 0D))").cast("double"),
        ).alias("threshold"),
    )


def threshold_value(calibration: DataFrame) -> float:
    """The calibrated scalar; refuses a calibration without unknown queries."""
    row = calibration.first()
    if row["boundary"] is None:
        raise ValueError("threshold calibration needs at least one unknown query")
    return row["threshold"]


def decisions(best: DataFrame, threshold: float) -> DataFrame:
    accepted = F.col("best") >= F.lit(float(threshold))
    return best.select(
        "query_id", F.when(accepted, "CANDIDATES").otherwise("UNKNOWN").alias("decision")
    )


def open_set_metrics(
    known_ranks: DataFrame,
    known_best: DataFrame,
    unknown_best: DataFrame,
    threshold: float,
    ks: Sequence[int] = DEFAULT_KS,
) -> DataFrame:
    """One row; every known rate uses all known queries as its denominator."""
    known = known_ranks.join(known_best, "query_id").select("best", "rank", F.lit(True).alias("_k"))
    unknown = unknown_best.select("best", F.lit(None).cast("bigint").alias("rank"), F.lit(False).alias("_k"))
    accepted = F.col("best") >= F.lit(float(threshold))
    is_known = F.col("_k")
    counted = known.unionByName(unknown).agg(
        F.count_if(is_known).alias("n_known"),
        F.count_if(~is_known).alias("n_unknown"),
        F.count_if(is_known & accepted).alias("_in"),
        F.count_if(~is_known & accepted).alias("_false"),
        *[F.count_if(is_known & accepted & (F.col("rank") <= k)).alias(f"_{k}") for k in ks],
    )
    n = F.col("n_known")
    columns = _rate_columns("known_acceptance", F.col("_in"), n)
    columns += _rate_columns("false_rejection", n - F.col("_in"), n)
    for k in ks:
        columns += _rate_columns(f"top{k}_after", F.col(f"_{k}"), n)
    columns += _rate_columns("unknown_false_accept", F.col("_false"), F.col("n_unknown"))
    return counted.select("n_known", "n_unknown", *columns)


def _strata(grouped: DataFrame, min_n: int) -> list[Column]:
    interval = wilson_interval("hits", "n")
    return [
        F.col("n"),
        share("hits", "n").alias("top_k_rate"),
        interval["lo"].alias("lo"),
        interval["hi"].alias("hi"),
        (F.col("n") >= min_n).alias("reportable"),
    ]


def stratify(ranks: DataFrame, value_col: str, k: int = 5, min_n: int = 10) -> DataFrame:
    """Top-k rate per value; blanks become "unrecorded"; small strata are flagged, not hidden."""
    value = F.coalesce(F.nullif(F.col(value_col), F.lit("")), F.lit("unrecorded"))
    grouped = ranks.groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= k).alias("hits")
    )
    return grouped.select("value", *_strata(grouped, min_n))


def stratify_all_attributes(
    ranks: DataFrame, attributed: DataFrame, k: int = 5, min_n: int = 10
) -> DataFrame:
    """Strata of every attribute but the head box: (attribute, value, ...).

    ``attributed``: query_id, attributes. Queries without an attribute are "unrecorded"; their
    count is the total less what was recorded, so no query is repeated per attribute.
    """
    rows = ranks.join(attributed, "query_id").select(
        (F.col("rank") <= k).cast("bigint").alias("hit"), "attributes"
    )
    entries = rows.select("hit", F.explode("attributes").alias("attribute", "value")).filter(
        F.col("attribute") != "head_bbox"
    )
    counted = entries.groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")
    )
    recorded = counted.filter(F.col("value") != "")
    seen = recorded.groupBy("attribute").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_hits"))
    names = counted.select("attribute").distinct()
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).first()
    rest = (
        names.join(seen, "attribute", "left")
        .select(
            "attribute",
            F.lit("unrecorded").alias("value"),
            (F.lit(total["n"]) - F.coalesce("_n", F.lit(0))).alias("n"),
            (F.lit(total["hits"]) - F.coalesce("_hits", F.lit(0))).alias("hits"),
        )
        .filter("n > 0")
    )
    together = recorded.unionByName(rest)
    grouped = together.groupBy("attribute", "value").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")
    )
    return grouped.select("attribute", "value", *_strata(grouped, min_n))


def dataset_stats(assignments: DataFrame, manifest: DataFrame, partition: str) -> DataFrame:
    """One row: known and unseen identities, fewest known images, identities with two sessions."""
    sessions = manifest.select("image_id", "capture_session_id")
    rows = assignments.filter(F.col("partition") == partition).join(sessions, "image_id")
    role = F.col("role")
    known = role.isin("gallery", "query_known")
    by_session = rows.groupBy("side_id", "capture_session_id").agg(
        F.count_if(known).alias("images"),
        F.bool_or(role == "gallery").alias("gallery"),
        F.bool_or(role == "query_unknown").alias("unseen"),
    )
    by_side = by_session.groupBy("side_id").agg(
        F.sum("images").alias("images"),
        F.count_if(F.col("images") > 0).alias("sessions"),
        F.bool_or("gallery").alias("gallery"),
        F.bool_or("unseen").alias("unseen"),
    )
    return by_side.agg(
        F.count_if("gallery").alias("known_side_ids"),
        F.coalesce(F.min(F.when(F.col("images") > 0, F.col("images"))), F.lit(0)).alias(
            "min_images_per_known_side_id"
        ),
        F.count_if(F.col("sessions") >= 2).alias("side_ids_with_two_sessions"),
        F.count_if("unseen").alias("unseen_side_ids"),
    )


def inventory(manifest: DataFrame) -> DataFrame:
    """Long counts (measure, key, n) of a manifest.

    Images are first reduced to one row per identity and session, so every later distinct count
    works on that much smaller table.
    """
    rows = with_keys(manifest).withColumn(
        "_known", (F.col("capture_timestamp_if_known") != "").cast("bigint")
    )
    sessions = rows.groupBy("individual", "side", "side_id", "capture_session_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("_known").alias("known")
    )
    sides = sessions.groupBy("individual", "side", "side_id").agg(
        F.sum("images").alias("images"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("known").alias("known"),
    )

    def one(measure: str, n: Column) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"), F.lit("").alias("key"), n.cast("bigint").alias("n")
        )

    totals = sides.agg(
        F.sum("images").alias("a"),
        F.count_distinct("individual").alias("b"),
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("images") >= 4).alias("d"),
        F.count_if(F.col("sessions") >= 2).alias("e"),
        F.sum("known").alias("f"),
    ).select(
        F.inline(
            F.array(
                one("image_count", F.col("a")),
                one("individual_count", F.col("b")),
                one("side_id_count", F.col("c")),
                one("side_ids_with_at_least_4_images", F.col("d")),
                one("side_ids_with_at_least_2_sessions", F.col("e")),
                one("timestamps_known", F.col("f")),
            )
        )
    )

    def histogram(measure: str, key: str, n: Column) -> DataFrame:
        return sides.groupBy(F.col(key).cast("string").alias("key")).agg(n.alias("n")).select(
            F.lit(measure).alias("measure"), "key", "n"
        )

    return (
        totals.unionByName(histogram("side_counts", "side", F.sum("images")))
        .unionByName(histogram("images_per_side_id", "images", F.count(F.lit(1))))
        .unionByName(histogram("sessions_per_side_id", "sessions", F.count(F.lit(1))))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: median, nearest-rank p95 (half-even index) and max; zeros when empty."""
    picked = value_at_ranks(
        df,
        column,
        lambda n: {
            "_low": (n + 1) // 2,
            "_high": n // 2 + 1,
            "_p95": min(n, round(0.95 * (n - 1)) + 1),
            "_max": n,
        },
    )
    zero = F.lit(0.0)
    return picked.select(
        F.coalesce((F.col("_low") + F.col("_high")) / 2, zero).alias("median"),
        F.coalesce(F.col("_p95").cast("double"), zero).alias("p95"),
        F.coalesce(F.col("_max").cast("double"), zero).alias("max"),
    )


def _examples(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def false_positive_examples(
    unknown_best: DataFrame, threshold: float, n: int = EXAMPLES
) -> DataFrame:
    """Unknown queries accepted with the highest scores (a top-n report)."""
    accepted = unknown_best.filter(F.col("best") >= F.lit(float(threshold)))
    return _examples(accepted, [F.col("best").desc(), F.col("query_id")], n)


def false_negative_examples(
    known_ranks: DataFrame, known_best: DataFrame, threshold: float, n: int = EXAMPLES
) -> DataFrame:
    """Known queries ranked below five or rejected, worst rank first (a top-n report)."""
    rejected = F.col("best") < F.lit(float(threshold))
    rows = known_ranks.join(known_best, "query_id").withColumn("rejected_as_unknown", rejected)
    missed = rows.filter((F.col("rank") > 5) | rejected).drop("best")
    return _examples(missed, [F.col("rank").desc(), F.col("query_id")], n)


def hardest_correct(
    known_ranks: DataFrame, known_best: DataFrame, n: int = EXAMPLES
) -> DataFrame:
    """Correct top-1 answers with the lowest scores (a top-n report)."""
    rows = known_ranks.filter(F.col("rank") == 1).join(known_best, "query_id")
    return _examples(rows.drop("rank"), [F.col("best"), F.col("query_id")], n)


def bounded_errors(errors: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """One row: the first n messages joined, then how many more there are."""
    line = F.concat_ws(": ", "entity_id", "message")
    total = errors.count()
    first = errors.select(line.alias("line")).orderBy("line").limit(n)
    shown = first.agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("shown"))
    tail = f"; ... (+{total - n} more)" if total > n else ""
    return shown.select(
        F.concat("shown", F.lit(tail)).alias("summary"), F.lit(total).cast("bigint").alias("total")
    )


def compare_metric_tables(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Differences of two flattened records (path, kind, text, number).

    ``kind`` is text, bool, number, null or length. NaN equals NaN; infinities differ, as their
    difference is not a number. Lists of different length are reported once, by their length.
    """
    left = a.select("path", *[F.col(c).alias(f"a_{c}") for c in ("kind", "text", "number")])
    right = b.select("path", *[F.col(c).alias(f"b_{c}") for c in ("kind", "text", "number")])
    joined = left.join(right, "path", "full_outer")
    numbers = (F.col("a_kind") == "number") & (F.col("b_kind") == "number")
    both_nan = F.isnan("a_number") & F.isnan("b_number")
    gap = F.abs(F.col("a_number") - F.col("b_number"))
    far = F.isnan(gap) | (gap > tolerance)
    problem = (
        F.when(F.col("a_kind").isNull() | F.col("b_kind").isNull(), "present in only one run")
        .when(numbers & both_nan, F.lit(None))
        .when(numbers & far, "number differs")
        .when(numbers, F.lit(None))
        .when(
            (F.col("a_kind") == "length") & (F.col("a_text") != F.col("b_text")), "length differs"
        )
        .when(
            (F.col("a_kind") != F.col("b_kind")) | ~F.col("a_text").eqNullSafe(F.col("b_text")),
            "value differs",
        )
    )
    found = joined.select(
        "path",
        F.coalesce("a_text", F.col("a_number").cast("string")).alias("a"),
        F.coalesce("b_text", F.col("b_number").cast("string")).alias("b"),
        problem.alias("problem"),
    ).filter(F.col("problem").isNotNull())
    uneven = found.filter("problem = 'length differs'").select(
        F.regexp_replace("path", r"\.length\z", "").alias("_list")
    )
    element_of = F.regexp_extract("path", r"(?s)^(.*)\[[0-9]+\]\z", 1)
    return found.join(uneven, element_of == F.col("_list"), "left_anti")


def flatten_record(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Long (path, kind, text, number) rows of a wide record table.

    Scalars are key.column; an array adds key.column.length and key.column[i] per element.
    """
    parts = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        if not kind.startswith("array<"):
            parts.append(F.array(_leaf(F.lit(c), F.col(c), kind)))
            continue
        length = F.struct(
            F.lit(f"{c}.length").alias("column"),
            F.lit("length").alias("kind"),
            F.size(c).cast("string").alias("text"),
            F.lit(None).cast("double").alias("number"),
        )
        parts.append(F.concat(F.array(length), _cells(c, kind[len("array<") : -1])))
    rows = df.select(F.col(key).cast("string").alias("_key"), F.explode(F.concat(*parts)).alias("e"))
    return rows.select(
        F.concat_ws(".", "_key", "e.column").alias("path"), "e.kind", "e.text", "e.number"
    )


def _cells(column: str, kind: str) -> Column:
    def cell(value: Column, i: Column) -> Column:
        return _leaf(F.concat(F.lit(f"{column}["), i.cast("string"), F.lit("]")), value, kind)

    return F.transform(column, cell)


def _leaf(name: Column, value: Column, kind: str) -> Column:
    word = {"string": "text", "boolean": "bool"}.get(kind, "number")
    none = F.lit(None)
    return F.struct(
        name.alias("column"),
        F.when(value.isNull(), "null").otherwise(word).alias("kind"),
        (none if word == "number" else value).cast("string").alias("text"),
        (value if word == "number" else none).cast("double").alias("number"),
    )
