"""Identity keys and derived columns of manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import canonical_row, col

ATTRIBUTE_PREFIX = "attr_"
# The columns of a manifest row, and the evidence labels.
MANIFEST_FIELDS = [
    "dataset_id",
    "image_id",
    "source",
    "source_reference",
    "license_or_permission",
    "individual_label",
    "side",
    "capture_session_id",
    "capture_timestamp_if_known",
    "original_filename_hash",
    "file_sha256",
    "width",
    "height",
    "split",
    "notes",
]
PROXY_LABEL = "PROXY — PIPELINE VALIDATION ONLY"
TIER_LABELS = {
    "A": "TIER A — CONTROLLED REAL DATA",
    "B": "TIER B — MOBILE-LIKE REAL DATA",
}


def side_id() -> Column:
    """Left and right views of one animal are separate identities."""
    return F.concat_ws(":", "dataset_id", "individual_label", "side")


def session_key() -> Column:
    return F.concat_ws(":", "dataset_id", "capture_session_id")


def individual() -> Column:
    return F.concat_ws(":", "dataset_id", "individual_label")


def with_keys(manifest: DataFrame) -> DataFrame:
    return manifest.withColumns(
        {"side_id": side_id(), "session_key": session_key(), "individual": individual()}
    )


def fold_attributes(df: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Fold every ``attr_`` column into one map; blank entries are dropped unless kept."""
    names = [c for c in df.columns if c.startswith(ATTRIBUTE_PREFIX)]
    entries = [
        F.struct(
            F.lit(c[len(ATTRIBUTE_PREFIX) :]).alias("key"),
            F.coalesce(F.col(c), F.lit("")).alias("value"),
        )
        for c in names
    ]
    if entries:
        folded = F.map_from_entries(F.array(*entries))
    else:
        folded = F.create_map().cast("map<string,string>")
    if not keep_blank:
        folded = F.map_filter(folded, lambda _, v: v != "")
    return df.withColumn("attributes", folded).drop(*names)


def build_manifest(labels: DataFrame, files: DataFrame, provenance: DataFrame) -> DataFrame:
    """Labels joined with file facts and the dataset record (one row).

    ``labels``: relative_path, individual_label, side, capture_session_id,
    capture_timestamp_if_known, notes, attributes. ``files``: relative_path, file_sha256, width,
    height. The dataset record is one row per dataset; labels may name theirs in dataset_id.
    """
    record = provenance.select("dataset_id", "source", "source_reference", "license_or_permission")
    rows = labels.join(files, "relative_path")
    if "dataset_id" in labels.columns:
        rows = rows.join(record, "dataset_id")
    else:
        found = record.take(2)  # the dataset record: one row of metadata
        if len(found) != 1:
            raise ValueError("labels without dataset_id need exactly one dataset record")
        rows = rows.withColumns({c: F.lit(found[0][c]) for c in record.columns})
    rows = rows.withColumns(
        {
            "image_id": F.concat_ws("-", "dataset_id", F.substring("file_sha256", 1, 16)),
            "original_filename_hash": F.sha2("relative_path", 256),
            "split": F.lit("unassigned"),
            "notes": F.coalesce(F.col("notes"), F.lit("")),
            "capture_timestamp_if_known": F.coalesce("capture_timestamp_if_known", F.lit("")),
        }
    )
    return rows.select(*MANIFEST_FIELDS, "attributes")


def canonical_json(manifest: DataFrame) -> DataFrame:
    attributes = "attributes" if "attributes" in manifest.columns else None
    fields = [c for c in MANIFEST_FIELDS if c in manifest.columns]
    return manifest.select("image_id", canonical_row(fields, attributes).alias("canonical"))


def with_evidence(provenance: DataFrame) -> DataFrame:
    label = F.when(F.col("proxy"), F.lit(PROXY_LABEL))
    for tier, text in TIER_LABELS.items():
        label = label.when(F.col("tier") == tier, F.lit(text))
    return provenance.withColumns(
        {
            "evidence_label": label,
            "counts_toward_product_gates": (F.col("tier") == "B") & ~F.col("proxy"),
        }
    )


def store_path(dataset_id: Column | str, sha256: Column | str, suffix: Column | str) -> Column:
    """Content-addressed place of a stored copy."""
    sha = col(sha256)
    return F.concat_ws("/", col(dataset_id), F.substring(sha, 1, 2), F.concat(sha, col(suffix)))


def experiment_id(
    config_id: Column | str, partition: Column | str, split: Column | str, config: Column | str
) -> Column:
    return F.concat_ws(
        "-",
        col(config_id),
        col(partition),
        F.substring(col(split), 1, 8),
        F.substring(col(config), 1, 8),
    )


def pixel_bucket(width: Column | str, height: Column | str, preprocessing: Column | str) -> Column:
    """Size stratum; after a crop the original size says nothing."""
    small = F.least(col(width), col(height)) < 128
    return (
        F.when(col(preprocessing) != "original", "head-crop")
        .when(small, "<128")
        .otherwise(">=128")
    )
