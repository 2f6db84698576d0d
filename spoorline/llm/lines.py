"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
LEAST_PAGES = 3


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line), F.length(F.trim(line)))


def site_line_shares(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, line_key, pages, host_pages) of every line on more than one page; blank lines are left out.

    Pages are distinct contents, so a host that repeats one page does not turn its lines into
    boilerplate. Both counts combine before the shuffle; a hot host or line is one row per task.
    """
    pages = docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64("text", F.length("text")).alias("page"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(
        F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key)
    )).alias("line_key"))
    held = lines.distinct().groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages"))
    return held.filter("pages > 1").join(totals, "host")


def _marked(docs: DataFrame, host: str, ratio: float, least_pages: int) -> DataFrame:
    """The documents with ``_goes``, the keys of their lines that are boilerplate (null: none)."""
    flagged = (
        site_line_shares(docs, host)
        .filter((F.col("pages") >= max(2, least_pages)) & (F.col("pages") > F.col("host_pages") * F.lit(ratio)))
        .select("host", "line_key")
    )
    # What goes follows from host and text, so ids may be null or repeated: rows equal in all three need no telling apart.
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    page = F.xxhash64(site, "text")
    keys = docs.select(
        F.col("doc_id").alias("_doc"),
        page.alias("_page"),
        site.alias("host"),
        F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line_key"),
    )
    # A document has few flagged lines: on average at most its host's lines per page over `ratio`.
    goes = (
        keys.join(flagged, ["host", "line_key"])
        .groupBy("_doc", "_page")
        .agg(F.collect_set("line_key").alias("_goes"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (page == F.col("_page"))
    return docs.join(goes, same, "left").drop("_doc", "_page")


def _staying() -> Column:
    return F.filter(
        F.split("text", "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains("_goes", _key(x))
    )


def _cut_text() -> Column:
    return F.when(F.col("_goes").isNull(), F.col("text")).otherwise(F.array_join(_staying(), "\n"))


def dedup_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without the lines that are boilerplate of their host.

    A line, compared without surrounding spaces, goes if it stands on more than ``ratio`` of the
    host's distinct pages and on ``least_pages`` of them at least (never fewer than two); blank lines
    always stay. Every occurrence goes. A null host is the host with the empty name; a null text
    stays null with zero lines; a text of boilerplate only becomes empty. Other columns are ignored.
    One row per input row; doc_id may be null or repeated.
    """
    marked = _marked(docs.select("doc_id", host, "text"), host, ratio, least_pages)
    lines = F.split("text", "\n")
    return marked.select(
        "doc_id",
        _cut_text().alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("_goes").isNull() | F.col("text").isNull(), F.lit(0))
        .otherwise(F.size(lines) - F.size(_staying()))
        .cast("bigint")
        .alias("n_dropped"),
    )


def without_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """The same rows and columns with the texts of ``dedup_lines``; ``n_chars`` follows a cut text."""
    marked = _marked(docs, host, ratio, least_pages)
    columns = {"text": _cut_text()}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_goes").isNull(), F.col("n_chars")).otherwise(
            F.length(_cut_text()).cast(docs.schema["n_chars"].dataType)
        )
    return marked.withColumns(columns).select(*docs.columns)


CHECK = """
with page as (select doc_id, coalesce(source, '') as host, text from documents),
total as (select host, count(distinct text) as host_pages from page group by host),
line as (select distinct host, text, trim(unnest(string_split(text, chr(10)))) as line from page),
share as (select host, line, count(*) as pages from line where line <> '' group by host, line),
flagged as (select host, list(line) as goes from share join total using (host)
  where pages >= 3 and pages > host_pages * 0.1::double group by host),
split as (select p.doc_id, p.text, string_split(p.text, chr(10)) as lines, coalesce(f.goes, []) as goes
  from page p left join flagged f using (host)),
kept as (select doc_id, text, lines,
  list_filter(lines, lambda x: trim(x) = '' or not list_contains(goes, trim(x))) as stay from split)
select doc_id, array_to_string(stay, chr(10)) as text, coalesce(len(lines), 0)::bigint as n_lines,
  coalesce(len(lines) - len(stay), 0)::bigint as n_dropped from kept
"""
