"""Registered image jobs over small rasters cut from the vectors, and over header bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators import images
from spoorline.plans.registry import query, rounded
from spoorline.sources.adapters import table, view

# gray cells of an image: each vector component scaled to 0..255
CELLS = """cells as (select vec_id, 'img-' || lpad(cast(vec_id as string), 10, '0') as image_id,
    list_transform(embedding, lambda e: cast(floor(least(greatest(
      (cast(e as double) + 0.5) * 255, 0), 255)) as int)) as px from embeddings)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform(
        "embedding",
        lambda e: F.floor(
            F.least(F.greatest((e.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))
        ).cast("int"),
    )
    image_id = F.concat(F.lit("img-"), F.lpad(F.col("vec_id").cast("string"), 10, "0"))
    return table(spark, sf, "embeddings").select(
        "vec_id", image_id.alias("image_id"), scaled.alias("px")
    )


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select(*images.raster_from_grid("image_id", "px", 8, 8))


def nine_by_eight() -> Column:
    return F.concat("px", F.slice("px", 1, 8))


@query(
    "dhash_table",
    f"""with {CELLS}, wide as (select image_id, list_concat(px, px[1:8]) as g from cells),
  bits as (select image_id, list_sum(list_transform(range(64), lambda i:
    case when g[(i // 8) * 9 + i % 8 + 2] > g[(i // 8) * 9 + i % 8 + 1]
      then cast(1 as hugeint) << (63 - i) else cast(0 as hugeint) end)) as b from wide)
  select image_id, cast(case when b >= 9223372036854775808 then b - 18446744073709551616 else b end
    as bigint) as dhash from bits""",
)
def dhash_table(spark, sf):
    grids = cells(spark, sf).withColumn("grid", nine_by_eight())
    return images.dhash_table(grids.select(*images.raster_from_grid("image_id", "grid", 9, 8)))


LIMITS = images.QualityThresholds(
    min_head_pixels=8, min_sharpness=15000.0, dark_mean=125.0, bright_mean=130.0
)


@query(
    "raster_quality",
    f"""with {CELLS}, spread as (select image_id, px, unnest(range(64)) as i from cells),
  placed as (select image_id, px, i, i % 8 as x, i // 8 as y from spread),
  response as (select image_id, px[i + 1] as v,
    px[y * 8 + (case when x = 0 then 1 else x - 1 end) + 1]
    + px[y * 8 + (case when x = 7 then 6 else x + 1 end) + 1]
    + px[(case when y = 0 then 1 else y - 1 end) * 8 + x + 1]
    + px[(case when y = 7 then 6 else y + 1 end) * 8 + x + 1] - 4 * px[i + 1] as r from placed),
  measured as (select image_id, var_pop(r) as s, avg(v) as m from response group by 1)
  select image_id, cast(8 as int) as head_pixels, round(s, 6) as sharpness,
    round(m, 6) as mean_intensity, concat_ws(',', case when s < 15000 then 'blur' end,
      case when m < 125 then 'underexposed' end, case when m > 130 then 'overexposed' end)
      as reasons,
    case when s < 15000 or m < 125 or m > 130 then 'RETRY PHOTO' else 'ACCEPT' end
      as recommendation from measured""",
)
def raster_quality(spark, sf):
    found = images.raster_quality(rasters(spark, sf), LIMITS)
    return rounded(found.withColumn("reasons", F.array_join("reasons", ",")))


BOX = "case vec_id % 4 when 0 then '' when 1 then '1,2,6,7' when 2 then '0,0,8,8' else '5,5,9,9' end"


@query(
    "head_crop",
    f"""with {CELLS}, boxed as (select *, vec_id % 4 as k from cells),
  corners as (select *, case k when 1 then 1 else 0 end as x0, case k when 1 then 2 else 0 end as y0,
    case k when 1 then 6 else 8 end as x1, case k when 1 then 7 else 8 end as y1 from boxed)
  select image_id, cast(case when k in (1, 2) then x1 - x0 end as string) as width, case when k = 0
    then 'missing_box' when k = 3 then 'range' else 'ok' end as outcome,
    case when k in (1, 2) then array_to_string(list_transform(range(y0, y1), lambda y:
      array_to_string(list_transform(px[y * 8 + x0 + 1 : y * 8 + x1],
        lambda v: printf('%02X', v)), '')), '') end as px from corners""",
)
def head_crop(spark, sf):
    boxes = table(spark, sf, "embeddings").select(
        F.concat(F.lit("img-"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("image_id"),
        F.create_map(F.lit("head_bbox"), F.expr(BOX)).alias("attributes"),
    )
    crops, problems = images.head_crop(rasters(spark, sf), boxes)
    none = F.lit(None).cast("string")
    return crops.select(
        "image_id", F.col("width").cast("string").alias("width"), F.lit("ok").alias("outcome"),
        F.hex("px").alias("px"),
    ).unionByName(
        problems.select(
            F.col("entity_id").alias("image_id"), none.alias("width"),
            F.col("code").alias("outcome"), none.alias("px"),
        )
    )


@query(
    "media_inspect",
    """select upload_id as path, case when head_hex like 'FFD8FF%' then 'image/jpeg'
    when head_hex like '8950%' then 'image/png' end as content_type,
  case when head_hex not like 'FFD8FF%' and head_hex not like '8950%' then 'invalid_image'
    when width <= 0 or height <= 0 then 'invalid_image'
    when width > 12000 or height > 12000 or cast(width as bigint) * height > 50000000
      then 'dimensions' else 'ok' end as verdict from uploads_v""",
)
def media_inspect(spark, sf):
    def hexed(name: str, digits: int) -> Column:
        return F.lpad(F.hex(name), digits, "0")

    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), hexed("width", 8), hexed("height", 8)
    )
    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"),
        hexed("height", 4),
        hexed("width", 4),
        F.lit("0301220002110103110100"),
    )
    head = F.col("head_hex")
    content = F.when(head.startswith("8950"), png).when(head.startswith("FFD8FF"), jpeg).otherwise(head)
    files = view(spark, sf, "uploads_v").select(
        F.col("upload_id").alias("path"), F.unhex(content).alias("content")
    )
    return images.media_inspect(files).select("path", "content_type", "verdict")
