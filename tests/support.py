"""Small helpers of the tests: sorted rows, and manifests of made images."""


def rows(df, *columns):
    """Sorted tuples of a small result."""
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())


MANIFEST = (
    "dataset_id string, image_id string, source string, source_reference string, "
    "license_or_permission string, individual_label string, side string, "
    "capture_session_id string, capture_timestamp_if_known string, "
    "original_filename_hash string, file_sha256 string, width int, height int, split string, "
    "notes string, attributes map<string,string>"
)


def image(image_id, label="x1", side="left", session="s1", stamp="", attributes=None, **other):
    row = {
        "dataset_id": "synthetic",
        "image_id": image_id,
        "source": "made",
        "source_reference": "none",
        "license_or_permission": "CC0",
        "individual_label": label,
        "side": side,
        "capture_session_id": session,
        "capture_timestamp_if_known": stamp,
        "original_filename_hash": "0" * 64,
        "file_sha256": (image_id.encode().hex() + "0" * 64)[:64],
        "width": 64,
        "height": 64,
        "split": "unassigned",
        "notes": "",
        "attributes": attributes or {},
    }
    return {**row, **other}


def manifest_of(spark, images):
    return spark.createDataFrame(images, MANIFEST)
