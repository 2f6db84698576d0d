"""Rates and their 95 % Wilson intervals as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import col

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile


def wilson_interval(successes: Column | str, n: Column | str) -> Column:
    """struct(lo, hi); (0, 1) when nothing was observed."""
    total = col(n).cast("double")
    safe = F.when(total > 0, total).otherwise(F.lit(1.0))
    p = col(successes).cast("double") / safe
    z2 = F.lit(Z95 * Z95)
    spread = F.sqrt(p * (1 - p) / safe + z2 / (4 * safe * safe)) * F.lit(Z95)
    scale = 1 + z2 / safe
    middle = p + z2 / (2 * safe)
    lo = F.greatest(F.lit(0.0), (middle - spread) / scale)
    hi = F.least(F.lit(1.0), (middle + spread) / scale)
    return F.struct(
        F.when(total > 0, lo).otherwise(F.lit(0.0)).alias("lo"),
        F.when(total > 0, hi).otherwise(F.lit(1.0)).alias("hi"),
    )


def share(count: Column | str, n: Column | str) -> Column:
    """count / n, NaN when n is zero."""
    total = col(n).cast("double")
    return F.when(total > 0, col(count).cast("double") / F.nullif(total, F.lit(0.0))).otherwise(
        F.lit(float("nan"))
    )


def rate(count: Column | str, n: Column | str) -> Column:
    """struct(count, n, rate, lo, hi)."""
    interval = wilson_interval(count, n)
    return F.struct(
        col(count).cast("bigint").alias("count"),
        col(n).cast("bigint").alias("n"),
        share(count, n).alias("rate"),
        interval["lo"].alias("lo"),
        interval["hi"].alias("hi"),
    )
