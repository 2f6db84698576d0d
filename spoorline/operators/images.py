"""Image tables: decode, crop, quality, difference hashes, and upload inspection.

Rasters travel as (image_id, width, height, px) with px the row-major 8-bit gray pixels, one image
per row, so all work is narrow and Arrow-batched.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.text import col
from spoorline.operators.validate import MAX_EDGE, MAX_PIXELS, bbox_parts, sniff

RASTER = "image_id string, width int, height int, px binary"


@dataclass(frozen=True)
class QualityThresholds:
    """The reviewed limits of the quality verdict."""

    min_head_pixels: int = 96
    min_sharpness: float = 20.0
    dark_mean: float = 35.0
    bright_mean: float = 220.0


def image_table(spark: SparkSession, root: str, max_side: int | None = None) -> DataFrame:
    """Gray rasters of every decodable image below ``root``, longest side bounded by max_side.

    Decoding is Spark's image source; rotation tags are not applied, so inputs must be upright.
    Downscaling averages boxes.
    """
    decoded = spark.read.format("image").option("dropInvalid", True).load(root)
    rows = decoded.select(
        F.col("image.origin").alias("image_id"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )

    def gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pixels = _luma(row.data, row.height, row.width, row.channels)
                if max_side and max(pixels.shape) > max_side:
                    scale = max_side / max(pixels.shape)
                    size = [max(1, round(n * scale)) for n in pixels.shape]
                    pixels = box_resize(pixels, *size)
                h, w = pixels.shape
                out.append((row.image_id, w, h, pixels.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "px"])

    return rows.mapInPandas(gray, RASTER)


def _luma(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """ITU-R 601 luma of blue-green-red bytes, rounded in fixed point."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    blue, green, red = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((red * 19595 + green * 38470 + blue * 7471 + 0x8000) >> 16).astype(np.uint8)


def box_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average onto a smaller (or equal) grid."""
    def shrink(a: np.ndarray, n: int) -> np.ndarray:
        size = a.shape[0]
        total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
        edges = np.arange(n + 1) * size / n
        low = np.minimum(edges.astype(int), size - 1)
        at = total[low] + (edges - low)[:, None] * a[low]
        return np.diff(at, axis=0) * n / size

    small = shrink(shrink(pixels.astype(np.float64), height).T, width).T
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def raster_from_grid(image_id: Column | str, grid: Column | str, width: int, height: int) -> list[Column]:
    """Raster columns of a small ARRAY<INT> grid."""
    cells = F.transform(col(grid), lambda v: F.lpad(F.hex(v), 2, "0"))
    return [
        col(image_id).alias("image_id"),
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.unhex(F.array_join(cells, "")).alias("px"),
    ]


def head_crop(images: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crops, errors): rasters cut to their head box; a missing or bad box is an error row.

    Rows of the raster are cut with SQL: one slice per pixel row, joined back into bytes.
    """
    boxes = manifest.select("image_id", F.col("attributes")["head_bbox"].alias("box"))
    b = F.col("_b")
    rows = images.join(boxes, "image_id", "left").withColumn("_b", bbox_parts("box"))
    inside = (
        (b[0] >= 0)
        & (b[0] < b[2])
        & (b[2] <= F.col("width"))
        & (b[1] >= 0)
        & (b[1] < b[3])
        & (b[3] <= F.col("height"))
    )
    good = F.coalesce(inside, F.lit(False))
    lines = F.transform(
        F.sequence(b[1], b[3] - 1),
        lambda y: F.hex(F.substring(F.col("px"), y * F.col("width") + b[0] + 1, b[2] - b[0])),
    )
    # the cut is computed before width is renamed: a lambda would see the new name
    cut = rows.filter(good).withColumn("_cut", F.unhex(F.array_join(lines, "")))
    crops = cut.select(
        "image_id",
        (b[2] - b[0]).alias("width"),
        (b[3] - b[1]).alias("height"),
        F.col("_cut").alias("px"),
    )
    code = (
        F.when(F.coalesce("box", F.lit("")) == "", "missing_box")
        .when(b.isNull(), "format")
        .otherwise("range")
    )
    problems = rows.filter(~good).select(
        F.col("image_id").alias("entity_id"),
        F.lit("head_bbox").alias("field"),
        code.alias("code"),
        F.lit("head_crop needs a head box inside the image").alias("message"),
    )
    return crops, problems


_QUALITY = "image_id string, head_pixels int, sharpness double, mean_intensity double"


def raster_quality(
    images: DataFrame, thresholds: QualityThresholds = QualityThresholds()
) -> DataFrame:
    """Smallest side, Laplacian variance, mean, reasons and a recommendation per raster."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                gray = np.frombuffer(row.px, dtype=np.uint8).reshape(row.height, row.width)
                out.append(
                    (row.image_id, min(gray.shape), _laplacian_variance(gray), float(gray.mean()))
                )
            yield pd.DataFrame(
                out, columns=["image_id", "head_pixels", "sharpness", "mean_intensity"]
            )

    measured = images.select("image_id", "width", "height", "px").mapInPandas(measure, _QUALITY)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("head_pixels") < thresholds.min_head_pixels, F.lit("head_too_small")),
            F.when(F.col("sharpness") < thresholds.min_sharpness, F.lit("blur")),
            F.when(F.col("mean_intensity") < thresholds.dark_mean, F.lit("underexposed")),
            F.when(F.col("mean_intensity") > thresholds.bright_mean, F.lit("overexposed")),
        )
    )
    verdict = (
        F.when(F.array_contains("reasons", "head_too_small"), "INSUFFICIENT HEAD VIEW")
        .when(F.size("reasons") > 0, "RETRY PHOTO")
        .otherwise("ACCEPT")
    )
    return measured.withColumn("reasons", reasons).withColumn("recommendation", verdict)


def _laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges mirrored without repeating the border."""
    mode = "reflect" if min(gray.shape) > 1 else "edge"
    wide = np.pad(gray.astype(np.float64), 1, mode=mode)
    response = (
        wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]
    )
    return float(response.var())


def dhash_of_grid(grid: Column | str) -> Column:
    """64-bit difference hash of a 9 x 8 gray grid (72 ints, row-major), as a signed BIGINT."""
    cells = col(grid)

    def add(bits: Column, i: Column) -> Column:
        at = F.floor(i / 8).cast("int") * 9 + i % 8
        brighter = F.get(cells, at + 1) > F.get(cells, at)
        return F.shiftleft(bits, 1).bitwiseOR(F.when(brighter, 1).otherwise(0).cast("bigint"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), add
    )


def dhash_table(images: DataFrame) -> DataFrame:
    """(image_id, dhash): rasters averaged to 9 x 8, then hashed with the grid expression."""
    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grids = [
                box_resize(
                    np.frombuffer(r.px, dtype=np.uint8).reshape(r.height, r.width), 8, 9
                ).ravel().astype(np.int32)
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame({"image_id": batch["image_id"], "grid": grids})

    grids = images.select("image_id", "width", "height", "px").mapInPandas(
        shrink, "image_id string, grid array<int>"
    )
    return grids.select("image_id", dhash_of_grid("grid").alias("dhash"))


def media_inspect(files: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """(path, content_type, width, height, verdict) from the bytes themselves.

    Magic bytes and header size are read first, and the size limits apply before anything is
    decoded. ``decoded`` (paths that Spark's image source could decode) turns files that are
    truncated behind a sound header into invalid images.
    """
    head = files.select(
        "path",
        "content",
        sniff(F.hex(F.substring("content", 1, 8))).alias("content_type"),
        F.length("content").alias("byte_size"),
    )

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                _header_size(r.content, r.content_type) for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "content_type": batch["content_type"],
                    "width": pd.array([f[0] for f in found], dtype="Int32"),
                    "height": pd.array([f[1] for f in found], dtype="Int32"),
                }
            )

    rows = head.mapInPandas(sizes, "path string, content_type string, width int, height int")
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    sound = F.lit(True)
    if decoded is not None:
        rows = rows.join(
            decoded.select("path", F.lit(True).alias("_decoded")).distinct(), "path", "left"
        )
        sound = F.col("_decoded").isNotNull()
    verdict = (
        F.when(F.col("content_type").isNull(), "invalid_image")
        .when(width.isNull() | (width <= 0) | (height <= 0), "invalid_image")
        .when(
            (width > MAX_EDGE) | (height > MAX_EDGE) | (width * height > MAX_PIXELS), "dimensions"
        )
        .when(~sound, "invalid_image")
        .otherwise("ok")
    )
    return rows.select("path", "content_type", "width", "height", verdict.alias("verdict"))


def _header_size(data: bytes, content_type: str | None) -> tuple[int | None, int | None]:
    if content_type == "image/png" and len(data) >= 24 and data[12:16] == b"IHDR":
        return struct.unpack(">ii", data[16:24])
    if content_type == "image/jpeg":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            # frame headers carry the size; C4, C8 and CC in that range are other tables
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            if kind == 0xFF:
                at += 1
                continue
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None
