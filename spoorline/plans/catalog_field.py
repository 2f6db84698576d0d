"""Registered queries over the observation tables: validators, joins, views, ordered logs."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions import text as tx
from spoorline.operators import lifecycle, relational, validate
from spoorline.plans.catalog_sets import ACCEPTED, coded, rules, seal_requests
from spoorline.operators.skew import ordered_numbers
from spoorline.plans.registry import query, scratch, stamp
from spoorline.sources import files as src
from spoorline.sources import sinks
from spoorline.sources.adapters import micros_to_time, table, view

OBSERVER = "a0000000-0000-4000-8000-000000000007"
PARK = "b0000000-0000-4000-8000-000000000001"
UUID_SQL = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
ISO = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.%f')"


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    return micros_to_time(view(spark, sf, "encounters_v"))


def media(spark: SparkSession, sf: str) -> DataFrame:
    return micros_to_time(view(spark, sf, "media_v"))


# --- tables and seeding --------------------------------------------------------------------------------


@query(
    "scan_tables",
    """select 'users' as name, cast(count(*) as bigint) as n, count(username) as named from users_v
  union all select 'parks', count(*), count(name) from parks_v
  union all select 'encounters', count(*), count(notes) from encounters_v
  union all select 'encounter_media', count(*), count(sha256) from media_v""",
)
def scan_tables(spark, sf):
    root = scratch(spark, "tables")
    made = {
        "users": view(spark, sf, "users_v"),
        "parks": view(spark, sf, "parks_v"),
        "encounters": encounters(spark, sf),
        "encounter_media": media(spark, sf),
    }
    for name, df in made.items():
        for c in src.TABLE_COLUMNS[name].split():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        sinks.write_once(df, f"{root}/{name}.parquet")
    tables = src.load_tables(spark, root)
    shown = {"users": "username", "parks": "name", "encounters": "notes", "encounter_media": "sha256"}
    out = None
    for name, df in tables.items():
        part = df.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n"),
            F.count(shown[name]).alias("named"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "seed_if_absent",
    """with keyed as (select id, lower(trim(slug)) as s, status from park_rows_v),
  held as (select * from keyed where status = 'OPEN'),
  fresh as (select s, min(id) as id from keyed where s not in (select s from held) group by 1)
  select id, 'existing' as origin from held union all select id, 'created' from fresh""",
)
def seed_if_absent(spark, sf):
    rows = view(spark, sf, "park_rows_v").select("id", "slug", "status")
    existing = rows.filter("status = 'OPEN'")
    merged, _ = relational.insert_absent(rows, existing)
    origin = F.when(F.col("status") == "OPEN", "existing").otherwise("created")
    return merged.select("id", origin.alias("origin"))


# --- text projections --------------------------------------------------------------------------------------


@query(
    "public_code",
    """select id, 'HIA-' || case when public_number < 1000000
  then lpad(cast(public_number as string), 6, '0') else cast(public_number as string) end
  as public_code from hias_v""",
)
def public_code(spark, sf):
    return view(spark, sf, "hias_v").select("id", tx.public_code("public_number").alias("public_code"))


@query("normalize_slug", "select id, lower(trim(slug)) as slug from park_rows_v")
def normalize_slug(spark, sf):
    return view(spark, sf, "park_rows_v").select("id", tx.normalize_slug("slug").alias("slug"))


@query("normalize_notes", "select id, nullif(trim(notes), '') as notes from encounters_v")
def normalize_notes(spark, sf):
    return view(spark, sf, "encounters_v").select("id", tx.normalize_notes("notes").alias("notes"))


@query(
    "profile_complete",
    """select id, coalesce(trim(username), '') <> '' and coalesce(trim(display_name), '') <> ''
  as profile_complete from users_v""",
)
def profile_complete(spark, sf):
    return relational.profile_complete(view(spark, sf, "users_v")).select("id", "profile_complete")


# --- views ------------------------------------------------------------------------------------------------------


@query(
    "public_park_view", "select id, slug, name, city, country_code, timezone from parks_v"
)
def public_park_view(spark, sf):
    return relational.public_parks(view(spark, sf, "parks_v"))


@query("public_zone_view", "select id, park_id, slug, name from zones_v")
def public_zone_view(spark, sf):
    return relational.public_zones(view(spark, sf, "zones_v"))


CODED = """select id, 'HIA-' || case when public_number < 1000000
  then lpad(cast(public_number as string), 6, '0') else cast(public_number as string) end as code
  from hias_v"""


@query(
    "public_hia_view",
    f"""select m.code as public_code, h.nickname, h.status, h.home_park_id,
  t.code as merged_into_public_code from hias_v h join ({CODED}) m on m.id = h.id
  left join ({CODED}) t on t.id = h.merged_into_hia_id""",
)
def public_hia_view(spark, sf):
    return relational.public_hias(view(spark, sf, "hias_v"))


@query(
    "resolve_merge_target",
    f"""select h.id, t.code as merged_into_public_code from hias_v h
  left join ({CODED}) t on t.id = h.merged_into_hia_id""",
)
def resolve_merge_target(spark, sf):
    return relational.resolve_merge_target(view(spark, sf, "hias_v")).select(
        "id", "merged_into_public_code"
    )


PLACED = "encounters_v e left join parks_v p on p.id = e.park_id left join zones_v z on z.id = e.zone_id"


@query(
    "encounter_view",
    f"""select e.id, e.status, {ISO.format('captured_us')} as captured_at,
  {ISO.format('submitted_us')} as submitted_at, p.id as park_id, p.name as park_name,
  z.id as zone_id, z.name as zone_name, e.behavior, e.notes from {PLACED}""",
)
def encounter_view(spark, sf):
    shown = relational.encounter_view(
        encounters(spark, sf), view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    )
    return shown.select(
        "id",
        "status",
        stamp("captured_at").alias("captured_at"),
        stamp("submitted_at").alias("submitted_at"),
        F.col("park.id").alias("park_id"),
        F.col("park.name").alias("park_name"),
        F.col("zone.id").alias("zone_id"),
        F.col("zone.name").alias("zone_name"),
        "behavior",
        "notes",
    )


@query(
    "encounters_with_place",
    f"""select e.id, {ISO.format('captured_us')} as captured_at, p.name as park_name,
  z.name as zone_name from {PLACED}""",
)
def encounters_with_place(spark, sf):
    placed = relational.encounters_with_place(
        encounters(spark, sf), view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    )
    return placed.select(
        "id",
        stamp("captured_at").alias("captured_at"),
        F.col("park.name").alias("park_name"),
        F.col("zone.name").alias("zone_name"),
    )


@query(
    "public_media_view",
    f"""select id, encounter_id, kind, status, content_type, byte_size, width, height, sha256,
  {ISO.format('created_us')} as created_at, 'PRIVATE' as visibility from media_v""",
)
def public_media_view(spark, sf):
    shown = relational.public_media(media(spark, sf))
    return shown.withColumn("created_at", stamp("created_at"))


@query("redact_location", "select encounter_id, source from locations_v")
def redact_location(spark, sf):
    return relational.guard_private(relational.redact_location(view(spark, sf, "locations_v")))


# --- validators ---------------------------------------------------------------------------------------------------


def dup_sql(source: str, entity: str, key: str, field: str) -> str:
    present = " and ".join(f"{k.strip()} is not null" for k in key.split(", "))
    return f"""select min({entity}) as entity_id, '{field}' as field, 'unique' as code from {source}
    where {present} group by {key} having count(*) > 1"""


def orphan_sql(source: str, entity: str, ref: str, target: str, field: str) -> str:
    return f"""select {entity} as entity_id, '{field}' as field, 'reference' as code from {source}
    where {ref} is not null and {ref} not in (select id from {target})"""


@query(
    "validate_users",
    rules(
        "users_v",
        "id",
        [
            ("not regexp_matches(username, '^[A-Za-z0-9_]{3,30}$')", "username", "format"),
            ("status not in ('ACTIVE', 'SUSPENDED', 'DELETED')", "status", "enum"),
        ],
    )
    + " union all "
    + dup_sql("users_v", "id", "lower(username)", "username"),
)
def validate_users(spark, sf):
    return coded(validate.validate_users(view(spark, sf, "users_v")))


@query(
    "validate_identities",
    rules(
        "identities_v",
        "id",
        [("trim(provider) = '' or trim(provider_subject) = ''", "provider", "required")],
    )
    + " union all "
    + dup_sql("identities_v", "id", "provider, provider_subject", "provider_subject")
    + " union all "
    + orphan_sql("identities_v", "id", "user_id", "users_v", "user_id")
    + " union all "
    + rules(
        "roles_v",
        "user_id",
        [
            (
                "role not in ('USER','CONTRIBUTOR','VERIFIER','MODERATOR','RESEARCHER','ADMIN')",
                "role",
                "enum",
            )
        ],
    )
    + " union all "
    + dup_sql("roles_v", "user_id", "user_id, role", "role")
    + " union all "
    + orphan_sql("roles_v", "user_id", "user_id", "users_v", "role"),
)
def validate_identities(spark, sf):
    return coded(
        validate.validate_identities(
            view(spark, sf, "identities_v"), view(spark, sf, "roles_v"), view(spark, sf, "users_v")
        )
    )


SLUG_BAD = "length({s}) > 64 or not regexp_matches({s}, '^[a-z0-9]+(-[a-z0-9]+)*$')"


@query(
    "validate_parks",
    rules(
        "park_rows_v",
        "id",
        [
            (SLUG_BAD.format(s="lower(trim(slug))"), "slug", "format"),
            ("length(trim(name)) not between 1 and 120", "name", "length"),
            ("length(trim(city)) not between 1 and 120", "city", "length"),
            ("not regexp_matches(country_code, '^[A-Z]{2}$')", "country_code", "format"),
            ("status not in ('ACTIVE', 'INACTIVE', 'ARCHIVED')", "status", "enum"),
            ("timezone not in ('Europe/Rome', 'Asia/Bangkok')", "timezone", "timezone"),
        ],
    )
    + " union all "
    + dup_sql("park_rows_v", "id", "lower(trim(slug))", "slug"),
)
def validate_parks(spark, sf):
    names = spark.createDataFrame(
        [(n,) for n in sorted(zoneinfo.available_timezones())], "name string"
    )
    return coded(validate.validate_parks(view(spark, sf, "park_rows_v"), names))


@query(
    "validate_zones",
    rules(
        "zone_rows_v",
        "id",
        [
            (f"not regexp_matches(park_id, {UUID_SQL})", "park_id", "uuid"),
            (SLUG_BAD.format(s="lower(trim(slug))"), "slug", "format"),
            ("length(trim(name)) not between 1 and 120", "name", "length"),
            ("status not in ('ACTIVE', 'INACTIVE', 'ARCHIVED')", "status", "enum"),
        ],
    )
    + " union all "
    + orphan_sql("zone_rows_v", "id", "park_id", "parks_v", "park_id")
    + " union all "
    + dup_sql("zone_rows_v", "id", "park_id, lower(trim(slug))", "slug"),
)
def validate_zones(spark, sf):
    return coded(
        validate.validate_zones(view(spark, sf, "zone_rows_v"), view(spark, sf, "parks_v"))
    )


@query(
    "validate_hias",
    rules(
        "hias_v",
        "id",
        [
            (
                "status not in ('PROVISIONAL','CONFIRMED','INACTIVE','ARCHIVED','MERGED')",
                "status",
                "enum",
            ),
            ("length(nickname) not between 1 and 60", "nickname", "length"),
            ("lower(merged_into_hia_id) = lower(id)", "merged_into_hia_id", "self_merge"),
            (
                "(status = 'MERGED') <> (merged_into_hia_id is not null)",
                "merged_into_hia_id",
                "merge_status",
            ),
        ],
    )
    + " union all "
    + orphan_sql("hias_v", "id", "merged_into_hia_id", "hias_v", "merged_into_hia_id")
    + " union all "
    + orphan_sql("hias_v", "id", "home_park_id", "parks_v", "home_park_id")
    + " union all "
    + dup_sql("hias_v", "id", "public_number", "public_number"),
)
def validate_hias(spark, sf):
    return coded(validate.validate_hias(view(spark, sf, "hias_v"), view(spark, sf, "parks_v")))


DETAIL = f"""case when coalesce(not regexp_matches(park_id, {UUID_SQL}), false)
    or coalesce(not regexp_matches(zone_id, {UUID_SQL}), false) then 'invalid_reference'
  when zone_id is not null and park_id is null then 'zone_requires_park'
  when behavior not in ('BASKING','SWIMMING','WALKING','RESTING','EATING','CLIMBING','OTHER')
    then 'behavior' when length(notes) > 2000 then 'notes_too_long' end"""


@query(
    "validate_encounters",
    f"""select id as entity_id, 'details' as field, {DETAIL} as code from encounters_v
  where {DETAIL} is not null union all """
    + rules(
        "encounters_v",
        "id",
        [
            (
                "status not in ('DRAFT','SUBMITTED','PROCESSING','NEEDS_REVIEW','CONFIRMED','REJECTED')",
                "status",
                "enum",
            ),
            ("(status = 'DRAFT') <> (submitted_us is null)", "submitted_at", "submitted_status"),
        ],
    )
    + " union all "
    + orphan_sql("encounters_v", "id", "observer_user_id", "users_v", "observer_user_id")
    + " union all "
    + orphan_sql("encounters_v", "id", "park_id", "parks_v", "park_id")
    + """ union all select id, 'zone_id', 'reference' from encounters_v e where zone_id is not null
    and park_id is not null and not exists
    (select 1 from zones_v z where z.id = e.zone_id and z.park_id = e.park_id)""",
)
def validate_encounters(spark, sf):
    return coded(
        validate.validate_encounters(
            encounters(spark, sf),
            view(spark, sf, "users_v"),
            view(spark, sf, "parks_v"),
            view(spark, sf, "zones_v"),
        )
    )


@query(
    "check_place",
    """select e.id as encounter_id, case when e.park_id is null then 'ok'
    when p.id is null then 'park_not_found' when e.zone_id is null then 'ok'
    when z.id is null then 'zone_not_found' when z.park_id <> e.park_id then 'zone_not_in_park'
    else 'ok' end as verdict from """
    + PLACED,
)
def check_place(spark, sf):
    return validate.check_place(
        encounters(spark, sf), view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    )


@query(
    "validate_locations",
    rules(
        "locations_v",
        "encounter_id",
        [
            ("isnan(lat) or lat not between -90 and 90", "lat", "range"),
            ("isnan(lon) or lon not between -180 and 180", "lon", "range"),
            (
                "isnan(accuracy_meters) or accuracy_meters < 0 or isinf(accuracy_meters)",
                "accuracy_meters",
                "range",
            ),
            ("source not in ('GPS', 'MANUAL', 'IMPORT', 'UNKNOWN')", "source", "enum"),
        ],
    )
    + " union all "
    + dup_sql("locations_v", "encounter_id", "encounter_id", "encounter_id")
    + " union all "
    + orphan_sql("locations_v", "encounter_id", "encounter_id", "encounters_v", "encounter_id"),
)
def validate_locations(spark, sf):
    return coded(
        validate.validate_locations(
            view(spark, sf, "locations_v"), view(spark, sf, "encounters_v")
        )
    )


KEY_SQL = (
    "'^photos/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\.(jpg|png)$'"
)


@query(
    "validate_media",
    rules(
        "media_v",
        "id",
        [
            ("kind <> 'PHOTO'", "kind", "enum"),
            ("content_type not in ('image/jpeg', 'image/png')", "content_type", "enum"),
            ("byte_size not between 1 and 15728640", "byte_size", "range"),
            (
                "width not between 1 and 12000 or height not between 1 and 12000 or "
                "cast(width as bigint) * height > 50000000",
                "width",
                "dimensions",
            ),
            ("not regexp_matches(sha256, '^[0-9a-f]{64}$')", "sha256", "hex64"),
            (f"not regexp_matches(storage_key, {KEY_SQL})", "storage_key", "format"),
        ],
    )
    + " union all "
    + dup_sql("media_v", "id", "storage_key", "storage_key")
    + " union all "
    + dup_sql("media_v", "id", "encounter_id, sha256", "sha256")
    + " union all "
    + orphan_sql("media_v", "id", "encounter_id", "encounters_v", "encounter_id"),
)
def validate_media(spark, sf):
    return coded(
        validate.validate_media(view(spark, sf, "media_v"), view(spark, sf, "encounters_v"))
    )


VERDICT = """with sniffed as (select u.*, e.id as eid, e.observer_user_id, e.status, w.id as wid,
    w.status as user_status,
    case when starts_with(head_hex, 'FFD8FF') then 'image/jpeg'
      when starts_with(head_hex, '89504E470D0A1A0A') then 'image/png' end as real,
    case lower(trim(split_part(declared_type, ';', 1))) when 'image/jpeg' then 'image/jpeg'
      when 'image/png' then 'image/png' end as declared
    from uploads_v u left join encounters_v e on e.id = u.encounter_id
    left join users_v w on w.id = u.user_id)
  select upload_id, case when declared_size > 15728640 then 'too_large'
    when wid is null then 'user_not_bootstrapped' when user_status <> 'ACTIVE' then 'user_not_active'
    when eid is null or observer_user_id <> user_id then 'not_found'
    when status <> 'DRAFT' then 'not_editable' when declared is null then 'unsupported_type'
    when byte_size > 15728640 then 'too_large' when byte_size = 0 or real is null then 'invalid_image'
    when width <= 0 or height <= 0 then 'invalid_image'
    when width > 12000 or height > 12000 or cast(width as bigint) * height > 50000000
      then 'dimensions' when real <> declared then 'type_mismatch' else 'accepted' end as verdict
  from sniffed"""


@query("upload_verdict", VERDICT)
def upload_verdict(spark, sf):
    return validate.upload_verdict(
        view(spark, sf, "uploads_v"), view(spark, sf, "encounters_v"), view(spark, sf, "users_v")
    )


@query(
    "immutable_audit",
    """select id as entity_id, 'public_number' as field from hias_v where public_number % 5 = 0
  union all select id, 'nickname' from hias_v where nickname is not null and status = 'MERGED'""",
)
def immutable_audit(spark, sf):
    old = view(spark, sf, "hias_v")
    new = old.withColumns(
        {
            "public_number": F.when(F.col("public_number") % 5 == 0, F.col("public_number") + 1)
            .otherwise(F.col("public_number")),
            "nickname": F.when(F.col("status") != "MERGED", F.col("nickname")),
        }
    )
    found = validate.immutable_audit(old, new, "id", ["public_number", "nickname"])
    return found.select("entity_id", "field")


BODIES = {
    0: '{"parkId": null}',
    1: '{"status": "DRAFT"}',
    2: '{"capturedAt": null}',
    3: "[1]",
    4: '{"location": {"latitude": 1, "longitude": 2, "source": "GPS"}}',
    5: '{"location": {"latitude": 1}}',
    6: '{"location": null, "notes": "x"}',
    7: '{"location": {"latitude": 1, "longitude": 2, "source": "GPS", "alt": 3}}',
    8: '{"notes": "n", "zoneId": "z"}',
    9: '{"location": {"latitude": null, "longitude": 1, "source": "GPS"}}',
    10: '{"notes": 5}',
    11: '{"capturedAt": "not a time"}',
    12: '{"location": {"latitude": 999, "longitude": 1, "source": "WIFI"}}',
    13: '{"notes": {"capturedAt": null}}',
    14: '{"notes": 5, "notes": "last"}',
    15: '{"location": [1, 2]}',
    16: '{"capturedAt": "2024-02-29T10:00:00.5+02:00", "behavior": null}',
    17: '{"location": {"latitude": "1", "longitude": 2, "source": "GPS"}, "capturedAt": 7}',
    18: '{"location": {"latitude": 1, "longitude": 181, "accuracyMeters": -1, "source": "GPS"}}',
    19: "not json",
}
# what each body is refused for
REFUSED = {
    1: ["body:unknown_field"], 2: ["capturedAt:null"], 3: ["body:object"], 5: ["location:incomplete"],
    7: ["location:unknown_field"], 9: ["location:incomplete"], 10: ["notes:type"], 11: ["capturedAt:type"],
    12: ["lat:range", "source:enum"], 13: ["notes:type"], 15: ["location:type"],
    17: ["capturedAt:type", "location:type"], 18: ["accuracy_meters:range", "lon:range"], 19: ["body:object"],
}
_REFUSALS = ", ".join(
    f"({k}, '{x.partition(':')[0]}', '{x.partition(':')[2]}')" for k, xs in REFUSED.items() for x in xs
)


@query(
    "validate_patch_fields",
    f"""select patch_id as entity_id, r.field, r.code from patches_v
  join (values {_REFUSALS}) r(k, field, code) on r.k = n % {len(BODIES)}""",
)
def validate_patch_fields(spark, sf):
    listed = F.array(*[F.lit(BODIES[k]) for k in sorted(BODIES)])
    body = F.get(listed, (F.col("n") % len(BODIES)).cast("int")).alias("body")
    bodies = view(spark, sf, "patches_v").select("patch_id", body)
    return validate.validate_patch_fields(bodies).select("entity_id", "field", "code")


# --- filters and lookups ------------------------------------------------------------------------------------------


@query("filter_active", "select id, name from zones_v where status = 'ACTIVE'")
def filter_active(spark, sf):
    return relational.filter_active(view(spark, sf, "zones_v")).select("id", "name")


@query(
    "filter_by_optional_park",
    f"""select id, public_number, 'all' as asked from hias_v
  union all select id, public_number, 'one' from hias_v where home_park_id = '{PARK}'""",
)
def filter_by_optional_park(spark, sf):
    rows = view(spark, sf, "hias_v").select("id", "public_number", "home_park_id")
    every = relational.filter_by_optional_park(rows).withColumn("asked", F.lit("all"))
    one = relational.filter_by_optional_park(rows, PARK).withColumn("asked", F.lit("one"))
    return every.unionByName(one).drop("home_park_id")


@query(
    "can_write",
    """select l.seq, l.user_id from profile_log_v l join users_v u on u.id = l.user_id
  where u.status = 'ACTIVE'""",
)
def can_write(spark, sf):
    log = view(spark, sf, "profile_log_v").select("seq", "user_id")
    return relational.can_write(log, view(spark, sf, "users_v"))


@query(
    "owner_only",
    f"""select m.id, m.encounter_id from media_v m join encounters_v e on e.id = m.encounter_id
  where e.observer_user_id = '{OBSERVER}'""",
)
def owner_only(spark, sf):
    rows = view(spark, sf, "media_v").select("id", "encounter_id")
    return relational.owner_only(rows, view(spark, sf, "encounters_v"), OBSERVER).select(
        "id", "encounter_id"
    )


@query(
    "user_by_identity",
    """select i.provider, i.provider_subject, u.id, u.status,
  coalesce(r.roles, '') as roles from users_v u join identities_v i on i.user_id = u.id
  left join (select user_id, string_agg(distinct role, ',' order by role) as roles
    from roles_v group by 1) r on r.user_id = u.id""",
)
def user_by_identity(spark, sf):
    found = relational.user_by_identity(
        view(spark, sf, "users_v"), view(spark, sf, "identities_v"), view(spark, sf, "roles_v")
    )
    return found.select(
        "provider", "provider_subject", "id", "status", F.array_join("roles", ",").alias("roles")
    )


@query(
    "lookup_by_ids",
    "select id, name from zones_v where id in (select zone_id from encounters_v where status = 'LOST')",
)
def lookup_by_ids(spark, sf):
    wanted = view(spark, sf, "encounters_v").filter("status = 'LOST'").select("zone_id")
    return relational.lookup_by_ids(view(spark, sf, "zones_v"), wanted, "id").select("id", "name")


@query(
    "point_lookup",
    f"select id, status from encounters_v where observer_user_id = '{OBSERVER}'",
)
def point_lookup(spark, sf):
    rows = view(spark, sf, "encounters_v")
    return relational.point_lookup(rows, "observer_user_id", OBSERVER).select("id", "status")


@query(
    "owned_media",
    f"""select m.id, {ISO.format('m.created_us')} as created_at from media_v m
  join encounters_v e on e.id = m.encounter_id
  where e.observer_user_id = '{OBSERVER}' and m.status = 'READY'""",
)
def owned_media(spark, sf):
    mine = relational.owned_media(media(spark, sf), view(spark, sf, "encounters_v"), OBSERVER)
    return mine.select("id", stamp("created_at").alias("created_at"))


@query(
    "zones_of_active_park",
    """select z.id, z.name, z.park_id from zones_v z join parks_v p on p.id = z.park_id
  where p.status = 'ACTIVE' and z.status = 'ACTIVE'""",
)
def zones_of_active_park(spark, sf):
    return relational.zones_of_active_park(
        view(spark, sf, "zones_v"), view(spark, sf, "parks_v")
    ).select("id", "name", "park_id")


LAT, LON, METRES = 13.7308, 100.5418, 600.0


@query(
    "spatial_within",
    f"""select encounter_id, source from locations_v where not isnan(lat) and
  2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - {LAT}) / 2), 2) +
    cos(radians(lat)) * cos(radians({LAT})) * pow(sin(radians(lon - {LON}) / 2), 2)))) <= {METRES}""",
)
def spatial_within(spark, sf):
    near = relational.spatial_within(view(spark, sf, "locations_v"), LAT, LON, METRES)
    return near.select("encounter_id", "source")


@query(
    "photo_count",
    "select encounter_id, cast(count(*) as bigint) as photos from media_v group by 1",
)
def photo_count(spark, sf):
    return relational.photo_count(view(spark, sf, "media_v"))


@query(
    "list_orders",
    """select 'park' as list, id, row_number() over (order by name, id) as place
    from parks_v where status = 'ACTIVE'
  union all select 'zone', id, row_number() over (partition by park_id order by name, id)
    from zones_v where status = 'ACTIVE'
  union all select 'encounter', id, row_number() over (partition by observer_user_id
    order by captured_us desc, id) from encounters_v""",
)
def list_orders(spark, sf):
    """The place of each row in its public list, per owner where the list is a person's own."""
    def placed(name: str, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
        numbered = ordered_numbers(rows, keys, order, "place")
        return numbered.select(F.lit(name).alias("list"), "id", "place")

    by_name = [F.col("name"), F.col("id")]
    newest = [F.col("captured_us").desc(), F.col("id")]
    return (
        placed("park", relational.filter_active(view(spark, sf, "parks_v")), [], by_name)
        .unionByName(
            placed("zone", relational.filter_active(view(spark, sf, "zones_v")), ["park_id"], by_name)
        )
        .unionByName(
            placed("encounter", view(spark, sf, "encounters_v"), ["observer_user_id"], newest)
        )
    )


# --- ordered logs -------------------------------------------------------------------------------------------------------


@query("seal_registrations", ACCEPTED + " select seq, accepted, registered from judged")
def seal_registrations(spark, sf):
    judged = lifecycle.seal_registrations(seal_requests(spark, sf))
    return judged.withColumn("registered", F.array_join("registered", ","))


@query(
    "registered_union",
    """select seq, case when config_sha256 = also_registered then config_sha256
  else least(config_sha256, also_registered) || ',' || greatest(config_sha256, also_registered) end
  as registered from seal_log_v""",
)
def registered_union(spark, sf):
    both = lifecycle.registered_union(F.array("also_registered"), F.array("config_sha256"))
    return view(spark, sf, "seal_log_v").select(
        "seq", F.array_join(both, ",").alias("registered")
    )


QUOTA = """with firsts as (select encounter_id, sha256, min(seq) as first_seq from media_v
    where status = 'READY' group by 1, 2),
  placed as (select *, row_number() over (partition by encounter_id order by first_seq, sha256)
    as place from firsts)
  select m.id, m.encounter_id, m.seq, case when place > 5 then 'refused' when m.seq = first_seq
    then 'created' else 'existing' end as outcome,
    coalesce(case when place <= 5 then cast(first_seq as string) end, '') as stored_seq
  from media_v m join placed using (encounter_id, sha256) where m.status = 'READY'"""


def ready(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "media_v").filter("status = 'READY'")


@query("attach_quota", QUOTA.replace("m.id, ", ""))
def attach_quota(spark, sf):
    stored = F.coalesce(F.col("stored_seq").cast("string"), F.lit(""))
    return lifecycle.attach_quota(ready(spark, sf)).select(
        "encounter_id", "seq", "outcome", stored.alias("stored_seq")
    )


@query(
    "attach_quota_existing",
    """with held as (select distinct encounter_id, sha256 from media_v where status = 'REJECTED'),
  counts as (select encounter_id, count(*) as c from held group by 1),
  firsts as (select encounter_id, sha256, min(seq) as first_seq from media_v where status = 'READY'
    and (encounter_id, sha256) not in (select encounter_id, sha256 from held) group by 1, 2),
  placed as (select *, row_number() over (partition by encounter_id order by first_seq, sha256)
    + coalesce(c, 0) as place from firsts left join counts using (encounter_id))
  select m.encounter_id, m.seq, case when h.sha256 is not null then 'existing'
    when place > 5 then 'refused' when m.seq = first_seq then 'created' else 'existing' end as outcome
  from media_v m left join held h using (encounter_id, sha256)
    left join placed p on p.encounter_id = m.encounter_id and p.sha256 = m.sha256
  where m.status = 'READY'""",
)
def attach_quota_existing(spark, sf):
    held = view(spark, sf, "media_v").filter("status = 'REJECTED'")
    return lifecycle.attach_quota(ready(spark, sf), held).select("encounter_id", "seq", "outcome")


@query(
    "assign_public_numbers",
    """select c_custkey, 1000 + row_number() over (order by c_name, c_custkey) as public_number
  from customer""",
)
def assign_public_numbers(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return lifecycle.assign_public_numbers(rows, [F.col("c_name"), F.col("c_custkey")], 1001).select(
        "c_custkey", "public_number"
    )


@query(
    "bootstrap_users",
    f"""with seen as (select provider, provider_subject, min(at_us) as lo, max(at_us) as hi
    from login_log_v where trim(provider) <> '' group by 1, 2)
  select s.provider, s.provider_subject, i.provider is null as created,
    case when i.provider is null then {ISO.format('lo')} end as created_at,
    {ISO.format('hi')} as last_login_at, case when i.provider is null then 'USER' end as role
  from seen s left join (select distinct provider, provider_subject from identities_v) i
    on i.provider = s.provider and i.provider_subject = s.provider_subject""",
)
def bootstrap_users(spark, sf):
    log = view(spark, sf, "login_log_v").withColumn("at", F.timestamp_micros("at_us"))
    found = lifecycle.bootstrap_users(log, view(spark, sf, "identities_v"))
    return found.select(
        "provider",
        "provider_subject",
        "created",
        stamp("created_at").alias("created_at"),
        stamp("last_login_at").alias("last_login_at"),
        "role",
    )


@query(
    "profile_updates",
    """with valid as (select * from profile_log_v where
    coalesce(regexp_matches(username, '^[A-Za-z0-9_]{3,30}$'), true)
    and coalesce(length(trim(display_name)) between 1 and 80, true)
    and coalesce(regexp_matches(locale, '^[a-z]{2}(-[A-Z]{2})?$'), true)),
  last as (select user_id, arg_max(username, seq) filter (where username is not null) as u,
    arg_max(display_name, seq) filter (where display_name is not null) as d,
    arg_max(locale, seq) filter (where locale is not null) as l from valid group by 1),
  merged as (select id, coalesce(u, username) as username, coalesce(d, display_name) as display_name,
    coalesce(l, locale) as locale from users_v left join last on user_id = id)
  select *, username is not null and count(*) over (partition by lower(username)) > 1
    as username_taken from merged""",
)
def profile_updates(spark, sf):
    merged = lifecycle.profile_updates(
        view(spark, sf, "users_v"), view(spark, sf, "profile_log_v")
    )
    return merged.select("id", "username", "display_name", "locale", "username_taken")


@query(
    "upsert_location",
    f"""with last as (select *, row_number() over (partition by encounter_id order by seq desc) as r
    from location_log_v)
  select encounter_id, round(lat, 6) as lat, round(lon, 6) as lon, accuracy_meters, source,
    {ISO.format('at_us')} as created_at from last where r = 1 and not cleared""",
)
def upsert_location(spark, sf):
    log = view(spark, sf, "location_log_v").withColumn("at", F.timestamp_micros("at_us"))
    held = lifecycle.upsert_location(log)
    return held.withColumns(
        {
            "lat": F.round("lat", 6),
            "lon": F.round("lon", 6),
            "created_at": stamp("created_at"),
        }
    )


def edit_log(spark: SparkSession, sf: str) -> DataFrame:
    return micros_to_time(view(spark, sf, "edit_log_v"))


# one event per step and encounter, each judged on the row the steps before it left behind
REPLAY = f"""with recursive log as (select *, row_number() over (partition by encounter_id order by seq)
    as step from edit_log_v where op <> 'note'),
  facts as (select l.*, p.id is not null as park_known, z.park_id as zone_park,
      coalesce(park_set and not regexp_matches(l.park_id, {UUID_SQL}), false) or
        coalesce(zone_set and not regexp_matches(l.zone_id, {UUID_SQL}), false) as bad_ref,
      case when behavior_set and behavior not in
        ('BASKING','SWIMMING','WALKING','RESTING','EATING','CLIMBING','OTHER') then 'behavior'
        when notes_set and length(notes) > 2000 then 'notes_too_long' end as bad_detail
    from log l left join parks_v p on p.id = l.park_id left join zones_v z on z.id = l.zone_id),
  fold(encounter_id, step, seq, outcome, status, park, zone) as (
    select encounter_id, cast(0 as bigint), cast(-1 as bigint), cast(null as string), 'NONE',
      cast(null as string), cast(null as string) from (select distinct encounter_id from log)
    union all
    select encounter_id, step, seq, outcome,
      case outcome when 'created' then 'DRAFT' when 'submitted' then 'SUBMITTED' else status end,
      case when outcome in ('created', 'edited') then new_park else park end,
      case when outcome in ('created', 'edited') then new_zone else zone end
    from (select *, case
        when op = 'create' and refusal is not null then refusal
        when op = 'create' then case when status = 'NONE' then 'created' else 'exists' end
        when status = 'NONE' then 'not_found'
        when op = 'submit' then case when status = 'DRAFT' then 'submitted' else 'unchanged' end
        when status <> 'DRAFT' then 'not_editable'
        else coalesce(refusal, 'edited') end as outcome
      from (select *, case when bad_ref then 'invalid_reference'
          when new_zone is not null and new_park is null then 'zone_requires_park'
          when bad_detail is not null then bad_detail
          when new_park is null then null
          when park_set and not park_known then 'park_not_found'
          when new_zone is null then null
          when new_zone_park is null then 'zone_not_found'
          when new_zone_park <> new_park then 'zone_not_in_park' end as refusal
        from (select f.encounter_id, f.status, f.park, f.zone, x.step, x.seq, x.op, x.park_set,
            x.park_known, x.bad_ref, x.bad_detail,
            case when x.park_set then x.park_id when x.op = 'create' then null else f.park end
              as new_park,
            case when x.zone_set then x.zone_id when x.op = 'create' then null else f.zone end
              as new_zone,
            case when x.zone_set then x.zone_park else f.park end as new_zone_park
          from fold f join facts x on x.encounter_id = f.encounter_id and x.step = f.step + 1))))"""


@query(
    "replay_outcomes",
    REPLAY + " select encounter_id, seq, outcome from fold where step > 0",
)
def replay_outcomes(spark, sf):
    return lifecycle.replay_outcomes(
        edit_log(spark, sf), view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    ).select("encounter_id", "seq", "outcome")


@query(
    "replay_encounters",
    REPLAY
    + f""", done as (select l.*, o.outcome from fold o join log l on l.encounter_id = o.encounter_id
    and l.step = o.step where o.outcome in ('created', 'edited', 'submitted'))
  select encounter_id,
    {ISO.format("arg_max(captured_us, seq) filter (where outcome = 'created' or (outcome = 'edited' and captured_set))")}
      as captured_at,
    {ISO.format("max(at_us) filter (where outcome = 'submitted')")} as submitted_at,
    arg_max_null(park_id, seq) filter (where outcome <> 'submitted' and park_set) as park_id,
    arg_max_null(zone_id, seq) filter (where outcome <> 'submitted' and zone_set) as zone_id,
    case when bool_or(outcome = 'submitted') then 'SUBMITTED' else 'DRAFT' end as status,
    arg_max_null(behavior, seq) filter (where outcome <> 'submitted' and behavior_set) as behavior,
    nullif(trim(arg_max_null(notes, seq) filter (where outcome <> 'submitted' and notes_set)), '')
      as notes
  from done group by 1""",
)
def replay_encounters(spark, sf):
    held = lifecycle.replay_encounters(
        edit_log(spark, sf), view(spark, sf, "parks_v"), view(spark, sf, "zones_v")
    )
    return held.select(
        "encounter_id",
        stamp("captured_at").alias("captured_at"),
        stamp("submitted_at").alias("submitted_at"),
        "park_id",
        "zone_id",
        "status",
        "behavior",
        "notes",
    )
