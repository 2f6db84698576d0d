"""Registration of queries with the statement that checks them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import shared_dir
from spoorline.sources.adapters import check_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check_sql(check)
        return fn

    return add


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Every double to six places, so that two engines' last bits do not matter."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
