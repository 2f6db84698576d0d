"""Validators: each returns error rows (entity_id, field, code, message).

A row rule is one boolean expression; all rules of a table run in a single narrow pass. Uniqueness
and reference rules add one partial aggregate or one anti-join each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.geo import valid_point
from spoorline.functions.text import (
    COUNTRY,
    HEX40,
    HEX64,
    LOCALE,
    PUBLIC_CODE,
    SLUG,
    STORAGE_KEY,
    USERNAME,
    blank,
    col,
    is_uuid,
    normalize_slug,
    public_code,
    strip,
)
from spoorline.operators.keys import ATTRIBUTE_PREFIX, MANIFEST_FIELDS
from spoorline.operators.skew import with_group_facts

Rule = tuple[Column, str, str, str]

# Closed vocabularies and limits that stored records must match.
SIDES = ["left", "right"]
SPLITS = ["unassigned", "train", "validation", "test"]
FORBIDDEN_TOKENS = ["gps", "latitude", "longitude", "user", "device", "owner"]
FAMILIES = ["A", "B", "C"]
PREPROCESSING = ["original", "head_crop"]
PIN_SOURCES = ["huggingface"]
USER_STATUSES = ["ACTIVE", "SUSPENDED", "DELETED"]
ROLES = ["USER", "CONTRIBUTOR", "VERIFIER", "MODERATOR", "RESEARCHER", "ADMIN"]
PLACE_STATUSES = ["ACTIVE", "INACTIVE", "ARCHIVED"]
HIA_STATUSES = ["PROVISIONAL", "CONFIRMED", "INACTIVE", "ARCHIVED", "MERGED"]
ENCOUNTER_STATUSES = ["DRAFT", "SUBMITTED", "PROCESSING", "NEEDS_REVIEW", "CONFIRMED", "REJECTED"]
BEHAVIORS = ["BASKING", "SWIMMING", "WALKING", "RESTING", "EATING", "CLIMBING", "OTHER"]
LOCATION_SOURCES = ["GPS", "MANUAL", "IMPORT", "UNKNOWN"]
CONTENT_TYPES = ["image/jpeg", "image/png"]
MEDIA_STATUSES = ["READY", "REJECTED"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png"]
PATCHABLE = ["capturedAt", "parkId", "zoneId", "behavior", "notes", "location"]
PLACEHOLDER_LICENCES = ["none", "n/a", "not applicable", "-"]
PLACEHOLDER_PREFIXES = "^(unknown|pending|tbd|to be determined|unverified)"
MAX_NOTES = 2000
MAX_BYTES = 15728640
MAX_EDGE = 12000
MAX_PIXELS = 50_000_000

REQUIRED_TEXT = [
    "dataset_id",
    "image_id",
    "source",
    "source_reference",
    "license_or_permission",
    "individual_label",
    "capture_session_id",
]


def errors(df: DataFrame, entity: Column | str, rules: Sequence[Rule]) -> DataFrame:
    """One pass over the rows; a rule whose condition is null does not fire.

    Every rule gives an entry and those that did not fire go afterwards: unlike a lambda over the
    entries, that is compiled.
    """
    found = F.array(
        *[
            F.when(
                F.coalesce(bad, F.lit(False)),
                F.struct(
                    F.lit(field).alias("field"),
                    F.lit(code).alias("code"),
                    F.lit(text).alias("message"),
                ),
            )
            for bad, field, code, text in rules
        ]
    )
    listed = df.select(col(entity).alias("entity_id"), F.explode(found).alias("e"))
    return listed.filter(F.col("e").isNotNull()).select("entity_id", "e.field", "e.code", "e.message")


def duplicates(
    df: DataFrame, keys: dict[str, Column], entity: str, field: str, code: str, message: str
) -> DataFrame:
    """One error per key that occurs more than once, on its smallest entity; null keys are ignored.

    A single partial aggregate: no join back, and copies of one key never gather. The smallest of
    texts is aggregated by sorting; a hash before the key spares comparing long equal beginnings.
    """
    keyed = df.select(F.col(entity).alias("entity_id"), *[c.alias(k) for k, c in keys.items()])
    counted = keyed.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(
        F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("_copies")
    )
    repeated = counted.filter(F.col("_copies") > 1)
    for k in keys:
        repeated = repeated.filter(F.col(k).isNotNull())
    held = F.concat(F.lit(f"{message} ("), F.col("_copies").cast("string"), F.lit(" rows)"))
    return repeated.select(
        "entity_id",
        F.lit(field).alias("field"),
        F.lit(code).alias("code"),
        held.alias("message"),
    )


def orphans(
    df: DataFrame,
    other: DataFrame,
    on: dict[str, str],
    entity: str,
    field: str,
    message: str,
    code: str = "reference",
) -> DataFrame:
    """Rows whose (non-null) reference has no target."""
    present = df
    for mine in on:
        present = present.filter(F.col(mine).isNotNull())
    refs = other.select(*[F.col(theirs).alias(f"_{mine}") for mine, theirs in on.items()])
    match = None
    for mine in on:
        term = F.col(mine) == F.col(f"_{mine}")
        match = term if match is None else match & term
    return present.join(refs, match, "left_anti").select(
        F.col(entity).alias("entity_id"),
        F.lit(field).alias("field"),
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
    )


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _not_in(c: str, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def _not_like(c: Column | str, pattern: str) -> Column:
    return ~F.coalesce(col(c).rlike(pattern), F.lit(False))


# --- manifests ------------------------------------------------------------------------------


def forbidden(column: str) -> bool:
    lowered = column.lower()
    return any(token in lowered for token in FORBIDDEN_TOKENS)


def check_header(
    columns: Sequence[str], required: Sequence[str], optional: Sequence[str] = ()
) -> list[str]:
    """Header problems, from column names alone."""
    found = [f"missing required column: {name}" for name in required if name not in columns]
    for column in columns:
        if forbidden(column):
            found.append(f"column {column}: location, user and device data is not identity evidence")
        elif column not in (*required, *optional) and not column.startswith(ATTRIBUTE_PREFIX):
            found.append(f"unexpected column: {column}")
    return found


def manifest_header(columns: Sequence[str]) -> list[str]:
    return check_header(columns, MANIFEST_FIELDS)


def _positive_int(c: str) -> Column:
    """Trimmed decimal digits with a value above zero."""
    text = strip(F.col(c).cast("string"))
    return F.coalesce(text.rlike(r"^\+?[0-9]+\z") & text.rlike("[1-9]"), F.lit(False))


def iso_instant(c: Column | str) -> Column:
    """Instant of ISO text (naive text read as UTC); null when it does not parse."""
    text = strip(c)
    shaped = text.rlike(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
    )
    return F.when(shaped, text.try_cast("timestamp"))


def known_instant(c: Column | str) -> Column:
    """Instant of text that already passed validation: no trimming and no shape check."""
    return F.when(col(c) != "", col(c).try_cast("timestamp"))


def is_aware(c: Column | str) -> Column:
    """Whether ISO text carries an offset; naive and aware stamps are never compared."""
    return col(c).endswith("Z") | col(c).rlike(r"[+-][0-9]{2}:[0-9]{2}\z")


def validate_manifest_rows(manifest: DataFrame) -> DataFrame:
    rules: list[Rule] = [
        (blank(c), c, "required", f"{c} is required") for c in REQUIRED_TEXT
    ]
    rules += [
        (F.col(c).contains(":"), c, "separator", f"{c} must not contain ':'")
        for c in ("dataset_id", "individual_label", "side")
    ]
    rules += [(_not_in("side", SIDES), "side", "enum", "side must be left or right")]
    rules += [
        (_not_like(c, HEX64), c, "hex64", f"{c} must be 64 lowercase hex characters")
        for c in ("file_sha256", "original_filename_hash")
    ]
    rules += [
        (~_positive_int(c), c, "positive", f"{c} must be a positive integer")
        for c in ("width", "height")
    ]
    stamp = "capture_timestamp_if_known"
    rules += [
        (_not_in("split", SPLITS), "split", "enum", "split is not a known partition"),
        (
            ~blank(stamp) & iso_instant(stamp).isNull(),
            stamp,
            "timestamp",
            f"{stamp} must be ISO 8601 or empty",
        ),
    ]
    return errors(manifest, "image_id", rules)


def validate_manifest_cross(manifest: DataFrame) -> DataFrame:
    """Repeated image ids and files held under several ids, one row per affected image.

    A long list is one row per member rather than one array, so copies of one file never gather.
    """
    ids = manifest.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = ids.select(
        F.col("image_id").alias("entity_id"),
        F.lit("image_id").alias("field"),
        F.lit("duplicate").alias("code"),
        F.concat(F.lit("image_id occurs "), F.col("n").cast("string"), F.lit(" times")).alias(
            "message"
        ),
    )
    shared = with_group_facts(
        manifest.select("image_id", "file_sha256"),
        ["file_sha256"],
        [F.min("image_id").alias("first"), F.count(F.lit(1)).alias("copies")],
        having=F.col("copies") > 1,
    )
    same_file = shared.select(
        F.col("image_id").alias("entity_id"),
        F.lit("file_sha256").alias("field"),
        F.lit("exact_duplicate").alias("code"),
        F.concat(
            F.lit("file "),
            F.substring("file_sha256", 1, 12),
            F.lit(" is held by "),
            F.col("copies").cast("string"),
            F.lit(" rows, first "),
            F.col("first"),
        ).alias("message"),
    )
    return repeated.unionByName(same_file)


def safe_relative(path: Column | str) -> Column:
    """The path with forward slashes, or null when it could leave its root."""
    text = F.replace(col(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    unsafe = (
        text.startswith("/")
        | text.contains(":")
        | F.array_contains(parts, "..")
        | (F.size(parts) == 0)
    )
    return F.when(~unsafe, F.array_join(parts, "/"))


def suffix(path: Column | str) -> Column:
    """Lower-case extension without its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)\z", 1))


def validate_label_paths(labels: DataFrame, files: DataFrame) -> DataFrame:
    """First failure per label row: outside the root, unsupported type, file not found."""
    rows = labels.select(
        F.col("relative_path").alias("entity_id"), safe_relative("relative_path").alias("safe")
    )
    supported = suffix("safe").isin(*IMAGE_SUFFIXES)
    local = errors(
        rows,
        "entity_id",
        [
            (F.col("safe").isNull(), "relative_path", "escape", "path is outside the image root"),
            (~supported, "relative_path", "type", "unsupported image type"),
        ],
    )
    missing = orphans(
        rows.filter(supported),
        files,
        {"safe": "relative_path"},
        "entity_id",
        "relative_path",
        "file not found",
        code="missing",
    )
    return local.unionByName(missing)


def bbox_parts(box: Column | str) -> Column:
    """Four integers, or null."""
    parts = F.transform(F.split(col(box), ","), lambda p: strip(p).try_cast("int"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)


def validate_bbox(manifest: DataFrame) -> DataFrame:
    """Head boxes: four integers inside the image; rows without a box pass."""
    box = F.col("attributes")["head_bbox"]
    b = F.col("_b")
    rows = manifest.filter(~blank(box)).withColumn("_b", bbox_parts(box))
    width, height = F.col("width").try_cast("int"), F.col("height").try_cast("int")
    inside = (
        (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= width) & (b[1] >= 0) & (b[1] < b[3])
        & (b[3] <= height)
    )
    return errors(
        rows,
        "image_id",
        [
            (b.isNull(), "head_bbox", "format", "head_bbox must be four integers"),
            (~inside, "head_bbox", "range", "head_bbox is outside the image"),
        ],
    )


# --- dataset records, configurations, pins -----------------------------------------------------


def strict_date(c: Column | str) -> Column:
    return F.when(
        col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), col(c).try_cast("date")
    )


def validate_provenance(provenance: DataFrame) -> DataFrame:
    text = [
        "dataset_id",
        "species",
        "source",
        "source_reference",
        "license_or_permission",
        "license_verified_on",
    ]
    licence = F.lower(strip("license_or_permission"))
    rules: list[Rule] = [(blank(c), c, "required", f"{c} is required") for c in text]
    rules += [
        (
            licence.isin(*PLACEHOLDER_LICENCES) | licence.rlike(PLACEHOLDER_PREFIXES),
            "license_or_permission",
            "unverified",
            "license_or_permission is not verified",
        ),
        (
            ~blank("license_verified_on") & strict_date("license_verified_on").isNull(),
            "license_verified_on",
            "date",
            "license_verified_on must be YYYY-MM-DD",
        ),
        (_not_in("tier", ["A", "B"]), "tier", "enum", "tier must be A or B"),
        (F.col("proxy").isNull(), "proxy", "boolean", "proxy must be a boolean"),
        (
            F.col("proxy") & (F.col("tier") == "B"),
            "proxy",
            "proxy_tier",
            "a proxy dataset cannot be tier B",
        ),
    ]
    return errors(provenance, "dataset_id", rules)


def _pin_rules(prefix: str, guard: Column) -> list[Rule]:
    def c(name: str) -> str:
        return f"{prefix}{name}"

    files = F.col(c("files"))
    rules: list[Rule] = [
        (guard & _not_in(c("source"), PIN_SOURCES), "source", "enum", "source is not supported")
    ]
    rules += [
        (guard & blank(c(name)), name, "required", f"{name} is required")
        for name in ("repo_id", "config_file", "weights_file", "license", "licence_scope")
    ]
    rules += [
        (
            guard & _not_like(c("revision"), HEX40),
            "revision",
            "revision",
            "revision must be an immutable 40-hex commit",
        ),
        (
            guard & F.coalesce(F.cardinality(files) == 0, F.lit(True)),
            "files",
            "files",
            "files must map each file to its sha256",
        ),
        (
            guard & (F.cardinality(F.map_filter(files, lambda _, v: ~v.rlike(HEX64))) > 0),
            "files",
            "digest",
            "every file digest must be a lowercase hex sha256",
        ),
    ]
    rules += [
        (
            guard
            & F.col(c(name)).isNotNull()
            & ~F.coalesce(F.map_contains_key(files, F.col(c(name))), F.lit(False)),
            name,
            "unlisted",
            f"{name} is not listed in files",
        )
        for name in ("config_file", "weights_file")
    ]
    return rules


def validate_model_pin(pins: DataFrame, entity: str = "pin_id") -> DataFrame:
    return errors(pins, entity, _pin_rules("", F.lit(True)))


def validate_config(configs: DataFrame) -> DataFrame:
    """``training_config`` and ``model_artifact`` are structs (null when absent)."""
    family, pin = F.col("algorithm_family"), F.col("model_artifact")
    rules: list[Rule] = [
        (blank(c), c, "required", f"{c} is required")
        for c in ("config_id", "model_identifier", "model_version")
    ]
    rules += [
        (_not_in("algorithm_family", FAMILIES), "algorithm_family", "enum", "unknown family"),
        (_not_in("preprocessing", PREPROCESSING), "preprocessing", "enum", "unknown preprocessing"),
        (
            F.coalesce(F.col("max_side") < 32, F.lit(True)),
            "max_side",
            "range",
            "max_side must be an integer >= 32",
        ),
        (F.col("seed").isNull(), "seed", "integer", "seed must be an integer"),
        (
            (family == "C") & F.col("training_config").isNull(),
            "training_config",
            "training",
            "family C requires training_config",
        ),
        (
            family.isin("B", "C") & pin.isNull(),
            "model_artifact",
            "pin",
            "families B and C require a model_artifact pin",
        ),
    ]
    bad_pin = _any([r[0] for r in _pin_rules("model_artifact.", pin.isNotNull())])
    rules += _pin_rules("model_artifact.", pin.isNotNull())
    rules += [
        (
            pin.isNotNull()
            & ~bad_pin
            & ~F.col("model_identifier").eqNullSafe(
                F.concat(F.lit("hf-hub:"), F.col("model_artifact.repo_id"))
            ),
            "model_identifier",
            "pin_mismatch",
            "model_identifier must match model_artifact",
        )
    ]
    return errors(configs, "config_id", rules)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


# --- observation tables --------------------------------------------------------------------------


def validate_users(users: DataFrame) -> DataFrame:
    local = errors(
        users,
        "id",
        [
            (~F.col("username").rlike(USERNAME), "username", "format", "username format"),
            (_not_in("status", USER_STATUSES), "status", "enum", "status is not known"),
        ],
    )
    taken = duplicates(
        users, {"_k": F.lower("username")}, "id", "username", "unique", "username is taken"
    )
    return local.unionByName(taken)


def validate_identities(identities: DataFrame, roles: DataFrame, users: DataFrame) -> DataFrame:
    return _all(
        errors(
            identities,
            "id",
            [
                (
                    blank("provider") | blank("provider_subject"),
                    "provider",
                    "required",
                    "invalid external identity",
                )
            ],
        ),
        duplicates(
            identities,
            {"_p": F.col("provider"), "_s": F.col("provider_subject")},
            "id",
            "provider_subject",
            "unique",
            "identity is already linked",
        ),
        orphans(identities, users, {"user_id": "id"}, "id", "user_id", "user does not exist"),
        errors(roles, "user_id", [(_not_in("role", ROLES), "role", "enum", "role is not known")]),
        duplicates(
            roles,
            {"_u": F.col("user_id"), "_r": F.col("role")},
            "user_id",
            "role",
            "unique",
            "role is granted twice",
        ),
        orphans(roles, users, {"user_id": "id"}, "user_id", "role", "user does not exist"),
    )


def _slug_bad(slug: Column) -> Column:
    return (F.char_length(slug) > 64) | ~slug.rlike(SLUG)


def _length_bad(c: str, low: int, high: int) -> Column:
    return ~F.char_length(strip(c)).between(low, high)


def validate_parks(parks: DataFrame, timezones: DataFrame) -> DataFrame:
    """``timezones`` holds one IANA name per row (column ``name``)."""
    slug = normalize_slug("slug")
    local = errors(
        parks,
        "id",
        [
            (_slug_bad(slug), "slug", "format", "slug format"),
            (_length_bad("name", 1, 120), "name", "length", "name length"),
            (_length_bad("city", 1, 120), "city", "length", "city length"),
            (_not_like("country_code", COUNTRY), "country_code", "format", "country code format"),
            (_not_in("status", PLACE_STATUSES), "status", "enum", "status is not known"),
        ],
    )
    zones = timezones.select(F.col("name").alias("timezone")).filter(
        ~F.col("timezone").isin("", "Local", "localtime")
    )
    unknown_zone = parks.join(zones, "timezone", "left_anti").select(
        F.col("id").alias("entity_id"),
        F.lit("timezone").alias("field"),
        F.lit("timezone").alias("code"),
        F.lit("timezone must be an IANA name").alias("message"),
    )
    taken = duplicates(parks, {"_k": slug}, "id", "slug", "unique", "slug is taken")
    return _all(local, unknown_zone, taken)


BOUNDARY = "array<array<array<struct<x:double,y:double>>>>"


def boundary_errors(zones: DataFrame) -> DataFrame:
    """Zones whose boundary (polygons of rings of points) is not valid, with the first reason.

    A ring is closed, has at least four points, encloses an area and never touches itself. Rows
    are independent; one polygon is one small NumPy check.
    """
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                rings = [ring for polygon in row.boundary for ring in polygon]
                reasons = [r for r in (_ring_problem(ring) for ring in rings) if r]
                if reasons or not rings:
                    found.append((row.id, (reasons or ["empty"])[0]))
            yield pd.DataFrame(found, columns=["entity_id", "code"])

    drawn = zones.filter(F.col("boundary").isNotNull()).select("id", "boundary")
    return drawn.mapInPandas(check, "entity_id string, code string").select(
        "entity_id",
        F.lit("boundary").alias("field"),
        "code",
        F.lit("boundary is not a valid multipolygon").alias("message"),
    )


def _ring_problem(ring: Sequence) -> str | None:
    points = np.array([[p["x"], p["y"]] for p in ring], dtype=np.float64).reshape(-1, 2)
    if len(points) < 4:
        return "too_few_points"
    if not np.isfinite(points).all():
        return "not_finite"
    if (points[0] != points[-1]).any():
        return "not_closed"
    start, end = points[:-1], points[1:]
    area = np.sum(start[:, 0] * end[:, 1] - end[:, 0] * start[:, 1])
    if area == 0:
        return "no_area"
    n = len(start)
    i, j = np.triu_indices(n, 2)
    apart = ~((i == 0) & (j == n - 1))  # first and last segment share their end point
    i, j = i[apart], j[apart]

    def side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sign(
            (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        )

    def boxes_meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        low, high = np.maximum(np.minimum(a, b), np.minimum(c, d)), np.minimum(
            np.maximum(a, b), np.maximum(c, d)
        )
        return (low <= high).all(axis=1)

    a, b, c, d = start[i], end[i], start[j], end[j]
    meets = (
        (side(a, b, c) * side(a, b, d) <= 0)
        & (side(c, d, a) * side(c, d, b) <= 0)
        & boxes_meet(a, b, c, d)
    )
    return "self_crossing" if meets.any() else None


def validate_zones(zones: DataFrame, parks: DataFrame) -> DataFrame:
    """Row, reference and uniqueness rules; a ``boundary`` column is checked when present."""
    slug = normalize_slug("slug")
    drawn = [boundary_errors(zones)] if "boundary" in zones.columns else []
    return _all(
        *drawn,
        errors(
            zones,
            "id",
            [
                (~F.coalesce(is_uuid("park_id"), F.lit(False)), "park_id", "uuid", "park_id form"),
                (_slug_bad(slug), "slug", "format", "slug format"),
                (_length_bad("name", 1, 120), "name", "length", "name length"),
                (_not_in("status", PLACE_STATUSES), "status", "enum", "status is not known"),
            ],
        ),
        orphans(zones, parks, {"park_id": "id"}, "id", "park_id", "park does not exist"),
        duplicates(
            zones,
            {"_p": F.col("park_id"), "_k": slug},
            "id",
            "slug",
            "unique",
            "slug is taken in this park",
        ),
    )


def validate_hias(hias: DataFrame, parks: DataFrame) -> DataFrame:
    target = F.col("merged_into_hia_id")
    code = F.col("_code")
    rows = hias.withColumn(
        "_code", F.col("public_code") if "public_code" in hias.columns else public_code("public_number")
    )
    return _all(
        errors(
            rows,
            "id",
            [
                (~F.coalesce(is_uuid("id"), F.lit(False)), "id", "uuid", "id form"),
                (_not_in("status", HIA_STATUSES), "status", "enum", "status is not known"),
                (
                    ~F.char_length("nickname").between(1, 60),
                    "nickname",
                    "length",
                    "nickname length",
                ),
                (
                    F.lower(target) == F.lower("id"),
                    "merged_into_hia_id",
                    "self_merge",
                    "cannot be merged into itself",
                ),
                (
                    (F.col("status") == "MERGED") != target.isNotNull(),
                    "merged_into_hia_id",
                    "merge_status",
                    "MERGED and a merge target go together",
                ),
                (~code.rlike(PUBLIC_CODE), "public_code", "format", "public code format"),
            ],
        ),
        orphans(rows, hias, {"merged_into_hia_id": "id"}, "id", "merged_into_hia_id", "no target"),
        orphans(rows, parks, {"home_park_id": "id"}, "id", "home_park_id", "park does not exist"),
        duplicates(
            rows, {"_n": F.col("public_number")}, "id", "public_number", "unique", "number is taken"
        ),
        duplicates(rows, {"_c": code}, "id", "public_code", "unique", "code is taken"),
    )


def encounter_detail_failure() -> Column:
    """First failing rule of the editable details, in checking order; null when all hold."""
    park, zone = F.col("park_id"), F.col("zone_id")
    bad_ref = (park.isNotNull() & ~is_uuid(park)) | (zone.isNotNull() & ~is_uuid(zone))
    return F.coalesce(
        F.when(F.col("captured_at").isNull(), "captured_at_required"),
        F.when(F.coalesce(bad_ref, F.lit(False)), "invalid_reference"),
        F.when(zone.isNotNull() & park.isNull(), "zone_requires_park"),
        F.when(F.col("behavior").isNotNull() & ~F.col("behavior").isin(*BEHAVIORS), "behavior"),
        F.when(F.char_length("notes") > MAX_NOTES, "notes_too_long"),
    )


def validate_encounters(
    encounters: DataFrame, users: DataFrame, parks: DataFrame, zones: DataFrame
) -> DataFrame:
    """Row rules, the first detail failure, and the four references."""
    rows = encounters.withColumn("_first", encounter_detail_failure())
    detail = rows.filter(F.col("_first").isNotNull()).select(
        F.col("id").alias("entity_id"),
        F.lit("details").alias("field"),
        F.col("_first").alias("code"),
        F.lit("first failing detail rule").alias("message"),
    )
    return _all(
        detail,
        errors(
            rows,
            "id",
            [
                (_not_in("status", ENCOUNTER_STATUSES), "status", "enum", "status is not known"),
                (
                    (F.col("status") == "DRAFT") != F.col("submitted_at").isNull(),
                    "submitted_at",
                    "submitted_status",
                    "only DRAFT has no submission time",
                ),
            ],
        ),
        orphans(rows, users, {"observer_user_id": "id"}, "id", "observer_user_id", "no such user"),
        orphans(rows, parks, {"park_id": "id"}, "id", "park_id", "park does not exist"),
        orphans(
            rows,
            zones,
            {"zone_id": "id", "park_id": "park_id"},
            "id",
            "zone_id",
            "zone is not in the park",
        ),
    )


def check_place(encounters: DataFrame, parks: DataFrame, zones: DataFrame) -> DataFrame:
    """Park exists, then zone exists, then the zone is in that park; any status is allowed."""
    known_parks = parks.select(F.col("id").alias("_park"))
    known_zones = zones.select(F.col("id").alias("_zone"), F.col("park_id").alias("_zone_park"))
    joined = encounters.join(known_parks, F.col("park_id") == F.col("_park"), "left").join(
        known_zones, F.col("zone_id") == F.col("_zone"), "left"
    )
    verdict = (
        F.when(F.col("park_id").isNull(), "ok")
        .when(F.col("_park").isNull(), "park_not_found")
        .when(F.col("zone_id").isNull(), "ok")
        .when(F.col("_zone").isNull(), "zone_not_found")
        .when(F.col("_zone_park") != F.col("park_id"), "zone_not_in_park")
        .otherwise("ok")
    )
    return joined.select(F.col("id").alias("encounter_id"), verdict.alias("verdict"))


def location_bad() -> list[Rule]:
    accuracy = F.col("accuracy_meters")
    return [
        (
            ~F.coalesce(valid_point("lat", F.lit(0.0)), F.lit(False)),
            "lat",
            "range",
            "latitude must be between -90 and 90",
        ),
        (
            ~F.coalesce(valid_point(F.lit(0.0), "lon"), F.lit(False)),
            "lon",
            "range",
            "longitude must be between -180 and 180",
        ),
        (
            F.isnan(accuracy) | (accuracy < 0) | (accuracy == float("inf")),
            "accuracy_meters",
            "range",
            "accuracy must be finite and >= 0",
        ),
        (_not_in("source", LOCATION_SOURCES), "source", "enum", "source is not known"),
    ]


def validate_locations(locations: DataFrame, encounters: DataFrame) -> DataFrame:
    return _all(
        errors(locations, "encounter_id", location_bad()),
        duplicates(
            locations,
            {"_k": F.col("encounter_id")},
            "encounter_id",
            "encounter_id",
            "unique",
            "an encounter has one location",
        ),
        orphans(
            locations,
            encounters,
            {"encounter_id": "id"},
            "encounter_id",
            "encounter_id",
            "encounter does not exist",
        ),
    )


def validate_media(media: DataFrame, encounters: DataFrame) -> DataFrame:
    width, height = F.col("width"), F.col("height")
    return _all(
        errors(
            media,
            "id",
            [
                (F.col("kind") != "PHOTO", "kind", "enum", "kind must be PHOTO"),
                (_not_in("status", MEDIA_STATUSES), "status", "enum", "status is not known"),
                (
                    _not_in("content_type", CONTENT_TYPES),
                    "content_type",
                    "enum",
                    "content type is not supported",
                ),
                (
                    ~F.col("byte_size").between(1, MAX_BYTES),
                    "byte_size",
                    "range",
                    "byte size is out of range",
                ),
                (
                    ~width.between(1, MAX_EDGE)
                    | ~height.between(1, MAX_EDGE)
                    | (width.cast("bigint") * height.cast("bigint") > MAX_PIXELS),
                    "width",
                    "dimensions",
                    "dimensions are out of range",
                ),
                (_not_like("sha256", HEX64), "sha256", "hex64", "sha256 format"),
                (_not_like("storage_key", STORAGE_KEY), "storage_key", "format", "key format"),
            ],
        ),
        duplicates(
            media, {"_k": F.col("storage_key")}, "id", "storage_key", "unique", "key is taken"
        ),
        duplicates(
            media,
            {"_e": F.col("encounter_id"), "_s": F.col("sha256")},
            "id",
            "sha256",
            "unique",
            "photo is already attached",
        ),
        orphans(
            media, encounters, {"encounter_id": "id"}, "id", "encounter_id", "no such encounter"
        ),
    )


def sniff(head_hex: Column | str) -> Column:
    """Format by leading magic bytes (hex text), or null."""
    head = F.upper(col(head_hex))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(
        head.startswith("89504E470D0A1A0A"), "image/png"
    )


def declared_media_type(header: Column | str) -> Column:
    media_type = F.lower(strip(F.split(col(header), ";")[0]))
    return F.when(media_type.isin(*CONTENT_TYPES), media_type)


def upload_verdict(
    uploads: DataFrame, encounters: DataFrame, users: DataFrame, quota: int = 5
) -> DataFrame:
    """Ordered verdict per upload; the quota step belongs to ``attach_quota``.

    ``uploads``: upload_id, encounter_id, user_id, declared_type, declared_size, byte_size,
    head_hex, width, height.
    """
    e = encounters.select(
        F.col("id").alias("_enc"),
        F.col("observer_user_id").alias("_observer"),
        F.col("status").alias("_status"),
    )
    u = users.select(F.col("id").alias("_user"), F.col("status").alias("_user_status"))
    rows = uploads.join(e, F.col("encounter_id") == F.col("_enc"), "left").join(
        u, F.col("user_id") == F.col("_user"), "left"
    )
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    real, declared = sniff("head_hex"), declared_media_type("declared_type")
    verdict = (
        F.when(F.col("declared_size") > MAX_BYTES, "too_large")
        .when(F.col("_user").isNull(), "user_not_bootstrapped")
        .when(F.col("_user_status") != "ACTIVE", "user_not_active")
        .when(F.col("_enc").isNull(), "not_found")
        .when(F.col("_observer") != F.col("user_id"), "not_found")
        .when(F.col("_status") != "DRAFT", "not_editable")
        .when(declared.isNull(), "unsupported_type")
        .when(F.col("byte_size") > MAX_BYTES, "too_large")
        .when(F.col("byte_size") == 0, "invalid_image")
        .when(real.isNull(), "invalid_image")
        .when((width <= 0) | (height <= 0), "invalid_image")
        .when(
            (width > MAX_EDGE) | (height > MAX_EDGE) | (width * height > MAX_PIXELS), "dimensions"
        )
        .when(real != declared, "type_mismatch")
        .otherwise("accepted")
    )
    return rows.select("upload_id", verdict.alias("verdict"))


def immutable_audit(old: DataFrame, new: DataFrame, key: str, guarded: Sequence[str]) -> DataFrame:
    """Guarded fields that differ between two snapshots of a table."""
    before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in guarded])
    rules = [
        (
            ~F.col(c).eqNullSafe(F.col(f"_old_{c}")),
            c,
            "immutable",
            f"{c} is immutable",
        )
        for c in guarded
    ]
    return errors(new.join(before, key), key, rules)


_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def validate_patch_fields(patches: DataFrame) -> DataFrame:
    """``patches``: patch_id, body (JSON text of one edit request).

    Fields are typed: texts or null, a time that is never null, and a location that is null or a
    whole point with its source, in range. Of a repeated key the last value counts.
    """
    fields = F.from_json("body", ", ".join(f"{k} variant" for k in PATCHABLE))
    parts = ("latitude", "longitude", "accuracyMeters", "source")
    rows = patches.select("patch_id", "body", F.json_object_keys("body").alias("keys"), fields.alias("f"))

    def kind(column: str) -> Column:
        """Type of a JSON value; VOID for null, and null where the field is absent."""
        return F.coalesce(F.schema_of_variant(column), F.when(F.col(column).isNotNull(), "OBJECT<>"))

    rows = rows.select(
        "patch_id",
        "keys",
        *[kind(f"f.{k}").alias(f"k_{k}") for k in PATCHABLE],
        F.try_variant_get("f.capturedAt", "$", "string").alias("captured"),
        F.json_object_keys(F.to_json("f.location")).alias("location_keys"),
        *[F.try_variant_get("f.location", f"$.{c}", "variant").alias(c) for c in parts],
    )
    rows = rows.select(
        "patch_id", "keys", "captured", "location_keys",
        *[f"k_{k}" for k in PATCHABLE],
        *[F.schema_of_variant(c).alias(f"k_{c}") for c in parts],
        *[F.try_variant_get(c, "$", "string" if c == "source" else "double").alias(c) for c in parts],
    )
    known = F.array(*[F.lit(k) for k in PATCHABLE])
    place = F.col("k_location").startswith("OBJECT")
    lacking = place & ~F.coalesce(
        F.forall(F.array("k_latitude", "k_longitude", "k_source"), lambda t: t != "VOID"), F.lit(False)
    )
    mistyped = place & (
        F.exists(F.array("k_latitude", "k_longitude", "k_accuracyMeters"), lambda t: ~t.rlike(_NUMBER) & (t != "VOID"))
        | ((F.col("k_source") != "STRING") & (F.col("k_source") != "VOID"))
    )
    wrong_place = F.coalesce(mistyped, F.lit(False)) | ((F.col("k_location") != "VOID") & ~place)
    alien = place & (F.size(F.array_except("location_keys", F.array(*[F.lit(c) for c in parts]))) > 0)
    whole = F.coalesce(place & ~lacking & ~F.coalesce(mistyped, F.lit(False)), F.lit(False))
    checked = rows.withColumns(
        {
            "lat": F.when(whole, F.col("latitude")).otherwise(0.0),
            "lon": F.when(whole, F.col("longitude")).otherwise(0.0),
            "accuracy_meters": F.when(whole, F.col("accuracyMeters")),
            "source": F.when(whole, F.col("source")).otherwise(LOCATION_SOURCES[0]),
        }
    )
    time = F.col("k_capturedAt")
    no_time = (time == "STRING") & (
        ~F.col("captured").rlike(_RFC3339) | F.try_to_timestamp(F.substring("captured", 1, 19)).isNull()
    )
    texts = [k for k in PATCHABLE if k not in ("capturedAt", "location")]
    return errors(
        checked,
        "patch_id",
        [
            (F.col("keys").isNull(), "body", "object", "body must be a JSON object"),
            (F.size(F.array_except("keys", known)) > 0, "body", "unknown_field", "body has a field that cannot be changed"),
            (time == "VOID", "capturedAt", "null", "capturedAt cannot be null"),
            (((time != "VOID") & (time != "STRING")) | no_time, "capturedAt", "type", "capturedAt must be a time"),
            *[
                (~F.col(f"k_{k}").isin("STRING", "VOID"), k, "type", f"{k} must be text or null")
                for k in texts
            ],
            (wrong_place, "location", "type", "location has a value of the wrong type"),
            (lacking & ~F.coalesce(mistyped, F.lit(False)), "location", "incomplete", "location fields cannot be null"),
            (alien, "location", "unknown_field", "location has an unknown field"),
            *location_bad(),
        ],
    )


def validate_profile_patches(patches: DataFrame, entity: str = "seq") -> DataFrame:
    return errors(
        patches,
        entity,
        [
            (~F.col("username").rlike(USERNAME), "username", "format", "username format"),
            (
                ~F.char_length(strip("display_name")).between(1, 80),
                "display_name",
                "length",
                "display name length",
            ),
            (~F.col("locale").rlike(LOCALE), "locale", "format", "locale format"),
        ],
    )
