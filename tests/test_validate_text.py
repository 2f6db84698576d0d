import pytest
from support import image, manifest_of, rows
from pyspark.sql import functions as F

from spoorline.functions import text as tx
from spoorline.functions.geo import haversine, valid_point
from spoorline.operators import keys, relational, validate


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "number,code",
    [(1, "HIA-000001"), (999999, "HIA-999999"), (1000000, "HIA-1000000"), (12345678, "HIA-12345678")],
)
def test_public_code_keeps_every_digit(spark, number, code):
    assert one(spark, tx.public_code(F.lit(number))) == code


@pytest.mark.parametrize(
    "text,kept", [("  a b  ", "a b"), (" \t a　\n", "a"), ("", ""), ("a", "a"), ("   ", "")]
)
def test_strip_knows_unicode_spaces(spark, text, kept):
    assert one(spark, tx.strip(F.lit(text))) == kept
    assert one(spark, tx.blank(F.lit(text))) == (kept == "")
    assert one(spark, tx.normalize_notes(F.lit(text))) == (kept or None)


def test_patterns_refuse_a_trailing_newline(spark):
    assert not one(spark, F.lit("a" * 64 + "\n").rlike(tx.HEX64))
    assert one(spark, F.lit("a" * 64).rlike(tx.HEX64))


def test_canonical_row_is_sorted_and_escaped(spark):
    made = keys.canonical_json(
        manifest_of(spark, [image("a", notes='say "hi"\n', attributes={"z": "1", "b": "é"})])
    ).first()["canonical"]
    import json

    parsed = json.loads(made)
    assert list(parsed) == sorted(parsed)
    assert parsed["notes"] == 'say "hi"\n' and parsed["attr_b"] == "é" and parsed["width"] == "64"


def test_header_check():
    found = validate.manifest_header([*keys.MANIFEST_FIELDS[1:], "attr_light", "gps_lat", "extra"])
    assert [f.split(":")[0] for f in found] == [
        "missing required column", "column gps_lat", "unexpected column"
    ]


BAD = [
    ({"dataset_id": " "}, ("dataset_id", "required")),
    ({"individual_label": "a:b"}, ("individual_label", "separator")),
    ({"side": "up"}, ("side", "enum")),
    ({"file_sha256": "AB"}, ("file_sha256", "hex64")),
    ({"width": 0}, ("width", "positive")),
    ({"split": "dev"}, ("split", "enum")),
    ({"stamp": "yesterday"}, ("capture_timestamp_if_known", "timestamp")),
    ({"stamp": "2026-02-30"}, ("capture_timestamp_if_known", "timestamp")),
]


def test_manifest_rows(spark):
    images = [image(f"i{n}", **change) for n, (change, _) in enumerate(BAD)]
    images += [image("ok1", stamp="2026-01-01"), image("ok2", stamp="2026-01-01T10:00:00+07:00")]
    found = validate.validate_manifest_rows(manifest_of(spark, images))
    assert rows(found, "entity_id", "field", "code") == sorted(
        (f"i{n}", *want) for n, (_, want) in enumerate(BAD)
    )


@pytest.mark.parametrize(
    "path,safe",
    [("a/b.jpg", "a/b.jpg"), ("a\\b.jpg", "a/b.jpg"), ("../a.jpg", None), ("a/../b.jpg", None),
     ("/a.jpg", None), ("c:a.jpg", None), ("", None), ("./a.jpg", "a.jpg")],
)
def test_safe_relative(spark, path, safe):
    assert one(spark, validate.safe_relative(F.lit(path))) == safe


@pytest.mark.parametrize(
    "box,code", [("0,0,64,64", None), ("1,2,3", "format"), ("a,0,1,1", "format"),
                 ("5,5,5,9", "range"), ("0,0,65,9", "range"), (" 1, 2 ,3,4", None)]
)
def test_head_boxes(spark, box, code):
    found = validate.validate_bbox(manifest_of(spark, [image("a", attributes={"head_bbox": box})]))
    assert [r["code"] for r in found.collect()] == ([code] if code else [])


def test_duplicates_name_one_row_per_key(spark):
    df = spark.createDataFrame([("1", "A"), ("2", "a"), ("3", None), ("4", None)], "id string, u string")
    found = validate.duplicates(df, {"k": F.lower("u")}, "id", "u", "unique", "taken")
    assert rows(found, "entity_id", "message") == [("1", "taken (2 rows)")]


@pytest.mark.parametrize(
    "lat,lon,good",
    [(90.0, 180.0, True), (-90.0, -180.0, True), (90.1, 0.0, False), (0.0, -180.1, False),
     (float("nan"), 0.0, False)],
)
def test_points_are_never_clamped(spark, lat, lon, good):
    assert one(spark, valid_point(F.lit(lat), F.lit(lon))) == good


def test_spatial_within(spark):
    df = spark.createDataFrame([(13.7307, 100.5418), (13.74, 100.5418)], "lat double, lon double")
    assert relational.spatial_within(df, 13.7308, 100.5418, 50).count() == 1
    far = one(spark, haversine(F.lit(0.0), F.lit(0.0), 0.0, 180.0))
    assert far == pytest.approx(20_015_115, rel=1e-4)


def test_views_refuse_private_columns(spark):
    df = spark.createDataFrame([("e", 1.0)], "id string, lat double")
    with pytest.raises(ValueError):
        relational.guard_private(df)
    assert relational.redact_location(df).columns == ["id"]


def test_merge_view_follows_one_hop(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("b", 2, "a"), ("c", 3, "b"), ("d", 4, "gone")],
        "id string, public_number bigint, merged_into_hia_id string",
    )
    got = dict(rows(relational.resolve_merge_target(df), "id", "merged_into_public_code"))
    assert got == {"a": None, "b": "HIA-000001", "c": "HIA-000002", "d": None}


def test_insert_absent_never_modifies(spark):
    held = spark.createDataFrame([("1", "lumpini", "old")], "id string, slug string, name string")
    new = spark.createDataFrame(
        [("2", " LUMPINI ", "new"), ("3", "east", "x"), ("4", "EAST", "y")],
        "id string, slug string, name string",
    )
    merged, counts = relational.insert_absent(new, held)
    assert rows(merged, "id", "name") == [("1", "old"), ("3", "x")]
    assert tuple(counts.first()) == (1, 2)


def ring(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in points]]


@pytest.mark.parametrize("rings,code", [
    (ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), None),
    (ring((0, 0), (2, 0), (2, 2), (0, 2)), "not_closed"),
    (ring((0, 0), (2, 0), (0, 0)), "too_few_points"),
    (ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), "no_area"),
    (ring((0, 0), (4, 4), (4, 0), (0, 3), (0, 0)), "self_crossing"),
    (ring((0, 0), (1, 1), (2, 2), (0, 0)), "no_area"),
])
def test_boundaries(spark, rings, code):
    df = spark.createDataFrame(
        [("z", [rings]), ("none", None)], f"id string, boundary {validate.BOUNDARY}"
    )
    assert [r["code"] for r in validate.boundary_errors(df).collect()] == ([code] if code else [])


def test_rules_are_compiled_and_keys_are_sorted_by_a_hash_first(spark):
    rows = [("a", "x" * 40 + "1"), ("b", "x" * 40 + "1"), ("c", None), ("d", None), ("e", "x" * 40 + "2")]
    df = spark.createDataFrame(rows, "id string, name string")
    found = validate.errors(df, "id", [(F.col("name").endswith("1"), "name", "end", "m"), (F.col("id") < "c", "id", "low", "m")])
    assert sorted((r.entity_id, r.code) for r in found.collect()) == [("a", "end"), ("a", "low"), ("b", "end"), ("b", "low")]
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    taken = validate.duplicates(df, {"_k": F.col("name")}, "id", "name", "unique", "taken")
    assert [tuple(r) for r in taken.collect()] == [("a", "name", "unique", "taken (2 rows)")]
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert all("_hash" in line or "_groupingexpression" in line for line in plan.splitlines() if "Sort [" in line)
