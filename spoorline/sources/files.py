"""Readers: manifests, labels, dataset records, configurations, hash sidecars, files, logs, tables.

Readers that enforce rules raise on the first action-free check they can (headers) and report row
errors as data; ``checked`` raises with a bounded message where a caller wants refusal.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.text import SPACE
from spoorline.operators.keys import ATTRIBUTE_PREFIX, MANIFEST_FIELDS, fold_attributes
from spoorline.operators.metrics import bounded_errors
from spoorline.operators.validate import (
    IMAGE_SUFFIXES,
    check_header,
    manifest_header,
    suffix,
    validate_manifest_cross,
    validate_manifest_rows,
)

LABEL_REQUIRED = ["relative_path", "individual_label", "side", "capture_session_id"]
LABEL_OPTIONAL = ["capture_timestamp_if_known", "notes"]

# The relational tables and their column lists.
TABLE_COLUMNS = {
    "users": "id username display_name avatar_url locale status created_at updated_at deleted_at",
    "auth_identities": "id user_id provider provider_subject created_at last_login_at",
    "user_roles": "user_id role",
    "parks": "id slug name city country_code timezone status created_at updated_at",
    "zones": "id park_id slug name status created_at updated_at",
    "hias": (
        "id public_number public_code nickname status home_park_id first_seen_at confirmed_at "
        "merged_into_hia_id created_at updated_at"
    ),
    "encounters": (
        "id observer_user_id captured_at submitted_at park_id zone_id status behavior notes "
        "created_at updated_at"
    ),
    "encounter_locations": "encounter_id lat lon accuracy_meters source created_at",
    "encounter_media": (
        "id encounter_id kind status content_type byte_size width height sha256 storage_key "
        "created_at"
    ),
}

CONFIG_SCHEMA = (
    "config_id string, algorithm_family string, model_identifier string, model_version string, "
    "preprocessing string, max_side int, seed int, training_config map<string,string>, "
    "parameters map<string,string>, model_artifact struct<source:string,repo_id:string,"
    "revision:string,config_file:string,weights_file:string,files:map<string,string>,"
    "license:string,licence_scope:string>"
)
PROVENANCE_SCHEMA = (
    "dataset_id string, tier string, species string, source string, source_reference string, "
    "license_or_permission string, license_verified_on string, proxy boolean, notes string"
)
SEAL_LOG_SCHEMA = (
    "split_sha256 string, config_sha256 string, calibration_sha256 string, experiment_id string, "
    "registered_configs array<string>, registered_at string"
)


class RefusedError(ValueError):
    """Input that failed validation; the message lists the first problems and counts the rest."""


def checked(df: DataFrame, errors: DataFrame) -> DataFrame:
    """``df`` if it has no error rows, else a bounded refusal."""
    if not errors.isEmpty():
        raise RefusedError(bounded_errors(errors).first()["summary"])
    return df


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, null read as empty; quoted fields may span lines."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="").csv(path)
    return rows.na.fill("")


def read_manifest(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A manifest CSV: header, row and cross-row rules, attributes folded, sorted by image id."""
    raw = _text_csv(spark, path)
    problems = manifest_header(raw.columns)
    if problems:
        raise RefusedError("; ".join(problems))
    manifest = fold_attributes(raw, keep_blank=True)
    if check:
        checked(manifest, validate_manifest_rows(manifest))
        checked(manifest, validate_manifest_cross(manifest))
        if manifest.isEmpty():
            raise RefusedError("manifest has no records")
    trimmed = F.regexp_replace(
        "capture_timestamp_if_known", f"^{SPACE}+|{SPACE}+\\z", ""
    )
    typed = manifest.withColumns(
        {
            "width": F.trim("width").try_cast("int"),
            "height": F.trim("height").try_cast("int"),
            "capture_timestamp_if_known": trimmed,
        }
    )
    return typed.select(*MANIFEST_FIELDS, "attributes").orderBy("image_id")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV: required and optional columns, ``attr_`` columns folded without blanks."""
    raw = _text_csv(spark, path)
    problems = check_header(raw.columns, LABEL_REQUIRED, LABEL_OPTIONAL)
    if problems:
        raise RefusedError("; ".join(problems))
    for c in LABEL_OPTIONAL:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(""))
    return fold_attributes(raw)


def read_provenance(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Dataset records, one JSON object per file (or per line); not validated here."""
    return spark.read.schema(PROVENANCE_SCHEMA).option("multiLine", not lines).json(path)


def read_configs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Experiment configurations, one JSON object per file below ``path`` (or per line)."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", not lines).json(path)


def read_phash(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image_id, dhash) from sidecars {"hashes": {image_id: 16 hex}}; bits as signed BIGINT.

    A sidecar is one JSON object and so one task; large sets are one small sidecar per line.
    """
    sidecars = (
        spark.read.schema("hashes map<string,string>").option("multiLine", not lines).json(path)
    )
    entries = sidecars.select(F.explode("hashes").alias("image_id", "hex"))
    return entries.select("image_id", F.conv("hex", 16, -10).cast("bigint").alias("dhash"))


#: Longer files are read in pieces. Pieces of a task are joined up to PIECE_BYTES, so that a batch of them is small.
WHOLE_BYTES = 32 << 20
PIECE_BYTES = 8 << 10

#: Spark's line reader would unpack files of these names.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|lzo)$"


def _kind(file: Column) -> Column:
    """The suffix of a file by its metadata, so that a scan need not open files of other kinds."""
    return suffix(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))))


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring lines of one part of a file as one piece, numbered in order."""
    at = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("_file").dictionary_encode().indices.to_numpy(), batch.column("_block").to_numpy()
        lines = batch.column("line")
        filled = np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64) + 1) // PIECE_BYTES
        cuts = (np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(filled) != 0)
        starts = np.concatenate([[0], np.flatnonzero(cuts) + 1])
        edges = pa.array(np.append(starts, len(file)).astype(np.int64))
        pieces = pc.binary_join(pa.LargeListArray.from_arrays(edges, lines), b"\n")
        first = batch.select(["_file", "_block", "_size"]).take(pa.array(starts))
        order = pa.array(np.arange(at, at + len(starts)))
        at += len(starts)
        yield pa.RecordBatch.from_arrays([*first.columns, order, pieces], ["_file", "_block", "_size", "_at", "piece"])


def _sha256_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each file from its pieces in order, a line break between two."""
    mark = b"\xef\xbb\xbf"  # the line reader drops it from the start of a file

    def closed(file: str, size: int, held: int, plain, marked) -> pa.RecordBatch:
        for start, found in ((0, plain), (len(mark), marked)):
            for end in (b"", b"\n"):
                if held + start + len(end) == size:
                    found.update(end)
                    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([found.hexdigest()])], ["_file", "_sha"])
        raise ValueError(f"{file} has {size} bytes, of which {held} were read")

    now, size, held, plain, marked = None, 0, 0, None, None
    for batch in batches:
        for file, bytes_, piece in zip(*(batch.column(c) for c in ("_file", "_size", "piece")), strict=True):
            if file.as_py() != now:
                if now is not None:
                    yield closed(now, size, held, plain, marked)
                now, size, held = file.as_py(), bytes_.as_py(), 0
                plain, marked = hashlib.sha256(), hashlib.sha256(mark)
            else:
                held += 1
                plain.update(b"\n")
                marked.update(b"\n")
            view = piece.as_buffer()
            held += view.size
            plain.update(view)
            marked.update(view)
    if now is not None:
        yield closed(now, size, held, plain, marked)


def _long_checksums(spark: SparkSession, root: str, wanted: list[str]) -> DataFrame:
    """(_file, _sha) of the files longer than ``WHOLE_BYTES``; a task holds a batch of pieces of one file.

    A checksum is one chain, so one task goes through a file in order, but never holds it: pieces end
    at line break bytes and are brought into order by a sort that spills.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
    long = (meta["file_size"] > WHOLE_BYTES) & ~meta["file_path"].rlike(PACKED)
    if wanted:
        long &= _kind(meta["file_path"]).isin(*wanted)
    rows = lines.filter(long).select(
        meta["file_path"].alias("_file"),
        meta["file_block_start"].alias("_block"),
        meta["file_size"].alias("_size"),
        F.col("value").cast("binary").alias("line"),
    )
    parts = "_file string, _block bigint, _size bigint"
    pieces = rows.mapInArrow(_joined_lines, f"{parts}, _at bigint, piece binary")
    ordered = pieces.repartition("_file").sortWithinPartitions("_file", "_block", "_at")
    return ordered.mapInArrow(_sha256_of_pieces, "_file string, _sha string")


def read_files(
    spark: SparkSession, root: str, suffixes: list[str] | None = None, content: bool = False
) -> DataFrame:
    """(relative_path, file_sha256, byte_size[, content]) of every supported file below ``root``.

    Without ``content``, no file longer than ``WHOLE_BYTES`` is held whole, unless its name is of a packed one.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    wanted = suffixes if suffixes is not None else IMAGE_SUFFIXES
    # The root as the file system itself writes it, so that any scheme and authority compare alike.
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(place).toString().rstrip("/") + "/"
    own = F.col("path").startswith(base)
    rows = files.withColumns(
        {
            "relative_path": F.when(own, F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path")),
            "_file": F.col("_metadata.file_path"),
        }
    )
    if wanted:
        rows = rows.filter(_kind(F.col("_file")).isin(*wanted))
    size = F.col("length").alias("byte_size")
    whole = F.sha2("content", 256).alias("file_sha256")
    if content:
        return rows.select("relative_path", whole, size, "content")
    # each condition stands alone, as the scan then leaves out files before it reads them
    short, long = rows.filter(F.col("length") <= WHOLE_BYTES), rows.filter(F.col("length") > WHOLE_BYTES)
    packed = F.col("_file").rlike(PACKED)
    held = short.unionByName(long.filter(packed)).select("relative_path", whole, size)
    chained = F.coalesce("_sha", F.raise_error(F.concat("_file", F.lit(" was not read")))).alias("file_sha256")
    named = long.filter(~packed).select("relative_path", "length", "_file")
    return held.unionByName(
        named.join(_long_checksums(spark, root, wanted), "_file", "left").select("relative_path", chained, size)
    )


def read_seal_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; blank lines are skipped and a missing log is empty."""
    try:
        return spark.read.schema(SEAL_LOG_SCHEMA).json(path)
    except Exception as problem:  # analysis error for a path that does not exist
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], SEAL_LOG_SCHEMA)
        raise


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relational tables present below ``root``, explicit columns only."""
    out = {}
    for name, columns in TABLE_COLUMNS.items():
        path = os.path.join(root, f"{name}.parquet")
        try:
            df = spark.read.parquet(path)
        except Exception as problem:  # analysis error for a path that does not exist
            if "PATH_NOT_FOUND" in str(problem):
                continue
            raise
        extra = ["boundary"] if name == "zones" and "boundary" in df.columns else []
        out[name] = df.select(*columns.split(), *extra)
    return out


def load_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """One relational table over JDBC, explicit columns only."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.load().select(*TABLE_COLUMNS[table].split())


def unfold_attributes(manifest: DataFrame, names: list[str]) -> DataFrame:
    """The map back to ``attr_`` columns, blank where a row lacks one."""
    columns = {
        ATTRIBUTE_PREFIX + n: F.coalesce(F.col("attributes")[n], F.lit("")) for n in names
    }
    return manifest.withColumns(columns).drop("attributes")


def attribute_names(manifest: DataFrame) -> list[str]:
    """Distinct attribute names: column metadata, as few as a header can hold."""
    rows = manifest.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().collect()
    return sorted(r["k"] for r in rows)


