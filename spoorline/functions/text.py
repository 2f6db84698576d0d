"""Text expressions shared by projections and validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that stored records must match.
HEX64 = r"^[0-9a-f]{64}\z"
HEX40 = r"^[0-9a-f]{40}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
USERNAME = r"^[A-Za-z0-9_]{3,30}\z"
LOCALE = r"^[a-z]{2}(-[A-Z]{2})?\z"
COUNTRY = r"^[A-Z]{2}\z"
PUBLIC_CODE = r"^HIA-[0-9]{6,}\z"
STORAGE_KEY = (
    r"^photos/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.(jpg|png)\z"
)
SPACE = r"[\s\u0085   -     　]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+\\z", "")


def blank(c: Column | str) -> Column:
    """True for null, empty or all-space text."""
    return ~F.coalesce(col(c).rlike(f"[^{SPACE[1:]}"), F.lit(False))


def normalize_slug(c: Column | str) -> Column:
    return F.lower(strip(c))


def normalize_notes(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def public_code(c: Column | str) -> Column:
    """Zero-padded to six digits; longer numbers keep every digit."""
    number = col(c)
    digits = number.cast("string")
    return F.concat(
        F.lit("HIA-"), F.when(number < 1_000_000, F.lpad(digits, 6, "0")).otherwise(digits)
    )


def is_uuid(c: Column | str) -> Column:
    return col(c).rlike(UUID)


def canonical_row(columns: list[str], attributes: str | None = None) -> Column:
    """Compact key-sorted JSON text of one row, every value a string.

    ``to_json`` keeps schema order and drops nulls, so the entries are built and sorted here.
    """
    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("k"), F.coalesce(value, F.lit("")).alias("v"))

    entries = F.array(*[entry(F.lit(c), F.col(c).cast("string")) for c in columns])
    if attributes:
        extra = F.transform(
            F.map_entries(attributes),
            lambda e: entry(F.concat(F.lit("attr_"), e["key"]), e["value"]),
        )
        entries = F.concat(entries, extra)
    quoted = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(json_text(e["k"]), F.lit(":"), json_text(e["v"])),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def json_text(c: Column) -> Column:
    """A JSON string literal: the writer's own escaping, taken from a one-element array."""
    rendered = F.to_json(F.array(c))
    return F.regexp_extract(rendered, r"(?s)^\[(.*)\]\z", 1)
