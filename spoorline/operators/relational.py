"""Lookups, place joins and privacy-safe views over the observation tables.

Dimension tables are joined without hints: the planner broadcasts them when their measured size is
below its threshold and shuffles them otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.geo import haversine, latitude_band
from spoorline.functions.text import blank, normalize_slug, public_code
from spoorline.operators.skew import lookup

COORDINATE_COLUMNS = ("lat", "lon", "latitude", "longitude", "point", "accuracy_meters")


def filter_active(df: DataFrame) -> DataFrame:
    """Public parks and zones, by name then id."""
    return df.filter(F.col("status") == "ACTIVE").orderBy("name", "id")


def filter_by_optional_park(hias: DataFrame, park_id: str | None = None) -> DataFrame:
    rows = hias if park_id is None else hias.filter(F.col("home_park_id") == park_id)
    return rows.orderBy("public_number")


def can_write(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events whose user is ACTIVE; everyone else may only read."""
    active = users.filter(F.col("status") == "ACTIVE").select(F.col("id").alias("user_id"))
    return events.join(active, "user_id", "left_semi")


def owner_only(df: DataFrame, encounters: DataFrame, user_id: str) -> DataFrame:
    """Rows of the caller's encounters; other people's look as if they did not exist."""
    mine = encounters.filter(F.col("observer_user_id") == user_id)
    return df.join(mine.select(F.col("id").alias("encounter_id")), "encounter_id", "left_semi")


def user_by_identity(users: DataFrame, identities: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their external identity and sorted roles."""
    granted = roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    linked = identities.select("provider", "provider_subject", "user_id")
    return (
        users.join(linked, users["id"] == linked["user_id"])
        .drop("user_id")
        .join(granted.withColumnRenamed("user_id", "id"), "id", "left")
        .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    )


def encounters_with_place(encounters: DataFrame, parks: DataFrame, zones: DataFrame) -> DataFrame:
    """Encounters with park and zone structs (null when absent), newest first."""
    return _place(encounters, parks, zones).orderBy(F.col("captured_at").desc(), "id")


def _place(encounters: DataFrame, parks: DataFrame, zones: DataFrame) -> DataFrame:
    park = parks.select(F.col("id").alias("park_id"), F.struct("id", "name").alias("park"))
    zone = zones.select(F.col("id").alias("zone_id"), F.struct("id", "name").alias("zone"))
    return encounters.join(park, "park_id", "left").join(zone, "zone_id", "left")


def lookup_by_ids(df: DataFrame, ids: DataFrame | Sequence[str], key: str) -> DataFrame:
    """Rows whose key is listed; unknown ids are simply absent."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return df.filter(F.col(key).isin(*ids))


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value)


def resolve_merge_target(hias: DataFrame) -> DataFrame:
    """Adds the public code of the merge target, one hop only."""
    targets = hias.select(
        F.col("id").alias("merged_into_hia_id"),
        public_code("public_number").alias("merged_into_public_code"),
    )
    present = hias.filter(F.col("merged_into_hia_id").isNotNull())
    absent = hias.filter(F.col("merged_into_hia_id").isNull())
    return lookup(present, "merged_into_hia_id", targets, "merged_into_hia_id", "left").unionByName(
        absent.withColumn("merged_into_public_code", F.lit(None).cast("string"))
    )


def owned_media(media: DataFrame, encounters: DataFrame, user_id: str) -> DataFrame:
    """The caller's ready photos, oldest first."""
    ready = media.filter(F.col("status") == "READY")
    return owner_only(ready, encounters, user_id).orderBy("created_at", "id")


def zones_of_active_park(
    zones: DataFrame, parks: DataFrame, park_id: str | None = None
) -> DataFrame:
    """Active zones of active parks (of one park when given), by name then id."""
    open_parks = parks.filter(F.col("status") == "ACTIVE").select(F.col("id").alias("park_id"))
    rows = zones if park_id is None else zones.filter(F.col("park_id") == park_id)
    return filter_active(rows.join(open_parks, "park_id", "left_semi"))


def spatial_within(locations: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Locations within a distance: a pushed latitude range, then the great-circle distance."""
    near = locations.filter(latitude_band("lat", lat, metres))
    return near.filter(haversine("lat", "lon", lat, lon) <= metres)


# --- views ---------------------------------------------------------------------------------------


def public_parks(parks: DataFrame) -> DataFrame:
    return guard_private(
        parks.select("id", "slug", "name", "city", "country_code", "timezone")
    )


def public_zones(zones: DataFrame) -> DataFrame:
    return guard_private(zones.select("id", "park_id", "slug", "name"))


def public_hias(hias: DataFrame) -> DataFrame:
    """No internal ids: the merge target appears as its public code."""
    dates = [c for c in ("first_seen_at", "confirmed_at") if c in hias.columns]
    return guard_private(
        resolve_merge_target(hias).select(
            public_code("public_number").alias("public_code"),
            "nickname",
            "status",
            "home_park_id",
            *dates,
            "merged_into_public_code",
        )
    )


def encounter_view(encounters: DataFrame, parks: DataFrame, zones: DataFrame) -> DataFrame:
    """Coarse place only; no observer and no coordinates."""
    stamps = [c for c in ("created_at", "updated_at") if c in encounters.columns]
    return guard_private(
        _place(encounters, parks, zones).select(
            "id",
            "status",
            "captured_at",
            "submitted_at",
            "park",
            "zone",
            "behavior",
            "notes",
            *stamps,
        )
    )


def public_media(media: DataFrame) -> DataFrame:
    kept = [
        c
        for c in media.columns
        if c in ("id", "encounter_id", "kind", "status", "content_type", "byte_size", "width",
                 "height", "sha256", "created_at")
    ]
    return guard_private(media.select(*kept, F.lit("PRIVATE").alias("visibility")))


def guard_private(view: DataFrame) -> DataFrame:
    """Refuse a public view that carries a coordinate, an observer or a storage key."""
    leaked = [c for c in view.columns if c in (*COORDINATE_COLUMNS, "observer_user_id", "storage_key")]
    if leaked:
        raise ValueError(f"public view exposes {leaked}")
    return view


def redact_location(df: DataFrame) -> DataFrame:
    return df.drop(*COORDINATE_COLUMNS)


def profile_complete(users: DataFrame) -> DataFrame:
    return users.withColumn(
        "profile_complete", ~blank("username") & ~blank("display_name")
    )


def photo_count(media: DataFrame) -> DataFrame:
    return media.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("photos"))


def insert_absent(
    new: DataFrame, existing: DataFrame, slug: str = "slug", within: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table, counts): rows of ``new`` whose case-insensitive slug is absent are added.

    Existing rows are never modified; repeated slugs inside ``new`` keep the smallest id.
    """
    def key(c: Column) -> Column:
        return F.concat_ws("/", F.col(within), c) if within else c

    known = existing.select(key(normalize_slug(slug)).alias("_key"))
    keyed = new.withColumn("_key", key(normalize_slug(slug)))
    firsts = keyed.groupBy("_key").agg(F.min("id").alias("_id"))
    fresh = keyed.join(known, "_key", "left_anti").join(
        firsts.select(F.col("_key").alias("_k2"), F.col("_id")),
        (F.col("_key") == F.col("_k2")) & (F.col("id") == F.col("_id")),
        "left_semi",
    ).drop("_key")
    marked = keyed.select("id").join(
        fresh.select("id", F.lit(1).alias("_new")), "id", "left"
    )
    counts = marked.agg(
        F.count("_new").alias("created"),
        (F.count(F.lit(1)) - F.count("_new")).alias("existing"),
    )
    return existing.unionByName(fresh.select(*existing.columns)), counts
