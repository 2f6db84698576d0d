"""Registered queries over manifests: sources, projections, validators, links, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators import dedup, digest, graph, keys, split, validate
from spoorline.operators import metrics as mt
from spoorline.plans.registry import query, scratch
from spoorline.session import durable
from spoorline.sources import files as src
from spoorline.sources import sinks
from spoorline.sources.adapters import manifest, view

PARAMS = split.SplitParameters(
    seed=7, train_fraction=0.2, validation_fraction=0.4, unknown_fraction=0.3, query_fraction=0.5
)
SIDE = "dataset_id || ':' || individual_label || ':' || side"
FLAT = """dataset_id, image_id, individual_label, side, capture_session_id,
  capture_timestamp_if_known, file_sha256, width, height, attr_lighting, attr_head_bbox"""


def flat(df: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return df.select(
        "dataset_id",
        "image_id",
        "individual_label",
        "side",
        "capture_session_id",
        "capture_timestamp_if_known",
        "file_sha256",
        "width",
        "height",
        F.coalesce(a["lighting"], F.lit("")).alias("attr_lighting"),
        F.coalesce(a["head_bbox"], F.lit("")).alias("attr_head_bbox"),
    )


def rough(spark: SparkSession, sf: str) -> DataFrame:
    return keys.fold_attributes(view(spark, sf, "rough_manifest_v"))


# --- sources and sinks -----------------------------------------------------------------------------


@query("scan_manifest", f"select {FLAT} from manifest_v")
def scan_manifest(spark, sf):
    path = scratch(spark, "manifest")
    sinks.write_manifest(manifest(spark, sf), path)
    return flat(src.read_manifest(spark, path))


@query(
    "scan_labels",
    "select relative_path, individual_label, side, capture_session_id, capture_timestamp_if_known,"
    " attr_lang from files_v",
)
def scan_labels(spark, sf):
    path = scratch(spark, "labels")
    columns = [*src.LABEL_REQUIRED, "capture_timestamp_if_known", "attr_lang"]
    sinks.write_once(
        view(spark, sf, "files_v").select(*columns), path, "csv", header=True, emptyValue=""
    )
    labels = src.read_labels(spark, path)
    return labels.withColumn("attr_lang", F.col("attributes")["lang"]).select(*columns)


@query(
    "scan_provenance",
    "select dataset_id, tier, source_reference, license_or_permission, license_verified_on, proxy"
    " from provenance_v",
)
def scan_provenance(spark, sf):
    path = scratch(spark, "provenance")
    sinks.write_once(view(spark, sf, "provenance_v"), path, "json")
    found = src.read_provenance(spark, path, lines=True)
    return found.select(
        "dataset_id", "tier", "source_reference", "license_or_permission", "license_verified_on",
        "proxy",
    )


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations with nested training and pin structs."""
    rows = view(spark, sf, "configs_v")
    digest_text = F.sha2(F.coalesce("pin_repo", F.lit("")), 256)
    pin = F.struct(
        F.lit("huggingface").alias("source"),
        F.col("pin_repo").alias("repo_id"),
        F.substring(digest_text, 1, 40).alias("revision"),
        F.lit("config.json").alias("config_file"),
        F.lit("model.bin").alias("weights_file"),
        F.create_map(
            F.lit("config.json"), digest_text, F.lit("model.bin"), digest_text
        ).alias("files"),
        F.lit("mit").alias("license"),
        F.lit("research").alias("licence_scope"),
    )
    return rows.withColumns(
        {
            "training_config": F.when(
                F.col("has_training"), F.create_map(F.lit("epochs"), F.lit("3"))
            ),
            "model_artifact": F.when(F.col("pin_repo").isNotNull(), pin),
        }
    )


@query(
    "scan_configs",
    """select config_id, algorithm_family, model_identifier, model_version, preprocessing, max_side,
  seed, has_training, pin_repo from configs_v""",
)
def scan_configs(spark, sf):
    path = scratch(spark, "configs")
    made = configs(spark, sf).drop("has_training", "pin_repo", "config_sha256")
    sinks.write_once(made, path, "json")
    return src.read_configs(spark, path, lines=True).select(
        "config_id",
        "algorithm_family",
        "model_identifier",
        "model_version",
        "preprocessing",
        "max_side",
        "seed",
        F.col("training_config").isNotNull().alias("has_training"),
        F.col("model_artifact.repo_id").alias("pin_repo"),
    )


SIGNED = """case when bits >= cast('9223372036854775808' as ubigint)
  then cast(cast(bits as hugeint) - 18446744073709551616 as bigint) else cast(bits as bigint) end"""


@query("scan_phash", f"select image_id, {SIGNED} as dhash from phash_v")
def scan_phash(spark, sf):
    path = scratch(spark, "phash")
    hashes = view(spark, sf, "phash_v")
    hexed = F.lower(F.lpad(F.hex("dhash"), 16, "0"))
    sinks.write_once(
        hashes.select(F.create_map("image_id", hexed).alias("hashes")), path, "json"
    )
    return src.read_phash(spark, path, lines=True)


@query("scan_image_files")
def scan_image_files(spark, sf):
    """Checksums of whole files: the given table files stand for photos."""
    return src.read_files(spark, sf, suffixes=["parquet"])


SEAL_LOG = "split_sha256, config_sha256, calibration_sha256, registered from"


@query(
    "scan_log_jsonl",
    f"""select {SEAL_LOG} (select *, case when config_sha256 < also_registered
  then config_sha256 || ',' || also_registered else also_registered || ',' || config_sha256 end
  as registered from seal_log_v)""",
)
def scan_log_jsonl(spark, sf):
    path = scratch(spark, "seal-log")
    sinks.append_log(seal_requests(spark, sf).drop("seq"), path)
    log = src.read_seal_log(spark, path)
    return log.select(
        "split_sha256",
        "config_sha256",
        "calibration_sha256",
        F.array_join(F.array_sort("registered_configs"), ",").alias("registered"),
    )


def seal_requests(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "seal_log_v").select(
        "seq",
        "split_sha256",
        "config_sha256",
        "calibration_sha256",
        F.concat(F.lit("exp-"), F.col("seq").cast("string")).alias("experiment_id"),
        F.array("config_sha256", "also_registered").alias("registered_configs"),
    )


@query(
    "sink_write_once",
    "select image_id, file_sha256, true as second_write_refused from manifest_v",
)
def sink_write_once(spark, sf):
    path = scratch(spark, "once")
    rows = manifest(spark, sf).select("image_id", "file_sha256")
    sinks.write_once(rows, path)
    try:
        sinks.write_once(rows, path)
        refused = False
    except Exception as problem:
        refused = "PATH_ALREADY_EXISTS" in str(problem)
    return spark.read.parquet(path).withColumn("second_write_refused", F.lit(refused))


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as file bytes under the labelled paths."""
    from spoorline.sources.adapters import table

    docs = table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("file_sha256"), F.encode("text", "UTF-8").alias("content")
    )
    content = docs.groupBy("file_sha256").agg(F.first("content").alias("content"))
    named = view(spark, sf, "files_v").select(
        F.lit("docs").alias("dataset_id"), "relative_path", "file_sha256", "n_chars"
    )
    return named.join(content, "file_sha256")


@query(
    "sink_content_store",
    """select 'docs/' || substr(sha, 1, 2) || '/' || sha || '.jpg' as target, sha as file_sha256,
  cast(max(n) as bigint) as byte_size
  from (select #[text]# as sha, strlen(text) as n from documents) group by sha""",
)
def sink_content_store(spark, sf):
    path = scratch(spark, "store")
    sinks.write_store(stored_files(spark, sf), path)
    held = spark.read.parquet(path)
    return held.select(
        "target", "file_sha256", F.octet_length("content").cast("bigint").alias("byte_size")
    )


@query(
    "locate_stored_image",
    """select relative_path as image_id, case when n_chars % 5 = 0 then 'missing'
  when n_chars % 7 = 0 then 'mismatch' else 'ok' end as status from files_v""",
)
def locate_stored_image(spark, sf):
    found = stored_files(spark, sf)
    # plant missing copies and altered bytes
    altered = F.when(F.col("n_chars") % 7 == 0, F.encode(F.lit("altered"), "UTF-8"))
    store = found.filter(F.col("n_chars") % 5 != 0).withColumn(
        "content", F.coalesce(altered, "content")
    )
    rows = found.withColumn("image_id", F.col("relative_path"))
    return sinks.verify_store(rows, store)


ACCEPTED = """with firsts as (
  select split_sha256, min_by(config_sha256, seq) as c0, min_by(also_registered, seq) as c1
  from seal_log_v group by 1),
calibrations as (select split_sha256, config_sha256, min_by(calibration_sha256, seq) as cal
  from seal_log_v group by 1, 2),
judged as (select l.seq, l.split_sha256, l.config_sha256, l.calibration_sha256,
  l.config_sha256 in (f.c0, f.c1) and l.calibration_sha256 = c.cal as accepted,
  least(f.c0, f.c1) || ',' || greatest(f.c0, f.c1) as registered
  from seal_log_v l join firsts f using (split_sha256)
  join calibrations c using (split_sha256, config_sha256))
"""


@query(
    "sink_append_log",
    ACCEPTED
    + """select 'log-' || split_sha256 as log, cast(count(*) as bigint) as entries from judged
  where accepted group by 1""",
)
def sink_append_log(spark, sf):
    from spoorline.operators.lifecycle import seal_registrations

    path = scratch(spark, "accepted-log")
    requests = durable(seal_requests(spark, sf))
    verdicts = durable(seal_registrations(requests).filter("accepted").select("seq", "registered"))
    accepted = requests.join(verdicts, "seq").withColumn(
        "registered_configs", F.col("registered")
    ).drop("registered")
    # two appends: the log only ever grows
    half = F.col("seq") % 2 == 0
    sinks.append_log(accepted.filter(half), path)
    sinks.append_log(accepted.filter(~half), path)
    log = src.read_seal_log(spark, path)
    return log.groupBy(F.concat(F.lit("log-"), "split_sha256").alias("log")).agg(
        F.count(F.lit(1)).alias("entries")
    )


@query(
    "sink_record",
    """select algorithm_family, cast(count(*) as bigint) as configs,
  cast(min(max_side) as int) as smallest_side from configs_v group by 1""",
)
def sink_record(spark, sf):
    path = scratch(spark, "record")
    rows = view(spark, sf, "configs_v").groupBy("algorithm_family").agg(
        F.struct(
            F.count(F.lit(1)).alias("configs"), F.min("max_side").alias("smallest_side")
        ).alias("metrics")
    )
    sinks.write_record(rows, path)
    back = spark.read.schema(
        "algorithm_family string, metrics struct<configs:bigint,smallest_side:int>"
    ).json(path)
    return back.select("algorithm_family", "metrics.configs", "metrics.smallest_side")


# --- projections -----------------------------------------------------------------------------------


@query(
    "derive_identity_keys",
    f"""select image_id, {SIDE} as side_id, dataset_id || ':' || capture_session_id as session_key,
  dataset_id || ':' || individual_label as individual from manifest_v""",
)
def derive_identity_keys(spark, sf):
    return keys.with_keys(manifest(spark, sf)).select(
        "image_id", "side_id", "session_key", "individual"
    )


@query(
    "build_manifest_rows",
    """select 'docs' as dataset_id, 'docs-' || substr(file_sha256, 1, 16) as image_id,
  individual_label, side, capture_session_id, capture_timestamp_if_known,
  #[relative_path]# as original_filename_hash, file_sha256, width, height, 'unassigned' as split,
  attr_lang as lang, 'herbarium' as source from files_v""",
)
def build_manifest_rows(spark, sf):
    rows = view(spark, sf, "files_v")
    labels = keys.fold_attributes(
        rows.select(
            "relative_path",
            "individual_label",
            "side",
            "capture_session_id",
            "capture_timestamp_if_known",
            F.lit("").alias("notes"),
            "attr_lang",
        )
    )
    record = spark.createDataFrame(
        [("docs", "herbarium", "ref", "CC0")],
        "dataset_id string, source string, source_reference string, license_or_permission string",
    )
    facts = rows.select("relative_path", "file_sha256", "width", "height")
    built = keys.build_manifest(labels, facts, record)
    return built.withColumn("lang", F.col("attributes")["lang"]).select(
        "dataset_id", "image_id", "individual_label", "side", "capture_session_id",
        "capture_timestamp_if_known", "original_filename_hash", "file_sha256", "width", "height",
        "split", "lang", "source",
    )


def _pair(name: str) -> str:
    return f"""'"{name}":"' || {name} || '"'"""


_CANONICAL = " || ',' || ".join(
    _pair(c) if c not in ("height", "width") else f"""'"{c}":"' || cast({c} as string) || '"'"""
    for c in sorted(keys.MANIFEST_FIELDS)
)
CANONICAL = (
    "'{' || "
    + "".join(
        f"""case when attr_{a} = '' then '' else '"attr_{a}":"' || attr_{a} || '",' end || """
        for a in ("head_bbox", "lighting", "source_frame")
    )
    + f"{_CANONICAL} || '}}'"
)


@query("canonical_row", f"select image_id, {CANONICAL} as canonical from manifest_v")
def canonical_row(spark, sf):
    return keys.canonical_json(manifest(spark, sf))


@query(
    "evidence_label",
    """select dataset_id, case when proxy then 'PROXY — PIPELINE VALIDATION ONLY'
  when tier = 'A' then 'TIER A — CONTROLLED REAL DATA'
  when tier = 'B' then 'TIER B — MOBILE-LIKE REAL DATA' end as evidence_label,
  tier = 'B' and not proxy as counts_toward_product_gates from provenance_v""",
)
def evidence_label(spark, sf):
    return keys.with_evidence(view(spark, sf, "provenance_v")).select(
        "dataset_id", "evidence_label", "counts_toward_product_gates"
    )


@query(
    "store_path",
    """select relative_path, 'docs/' || substr(file_sha256, 1, 2) || '/' || file_sha256 || '.jpg'
  as target from files_v""",
)
def store_path(spark, sf):
    rows = view(spark, sf, "files_v").withColumn("dataset_id", F.lit("docs"))
    return sinks.plan_store(rows).select("relative_path", "target")


@query(
    "experiment_id",
    """select config_id, config_id || '-test-' || substr(#['s' || algorithm_family]#, 1, 8) || '-' ||
  substr(config_sha256, 1, 8) as experiment_id from configs_v""",
)
def experiment_id(spark, sf):
    sealed = F.sha2(F.concat(F.lit("s"), "algorithm_family"), 256)
    made = keys.experiment_id("config_id", F.lit("test"), sealed, "config_sha256")
    return view(spark, sf, "configs_v").select("config_id", made.alias("experiment_id"))


@query(
    "pixel_bucket",
    """select image_id, case when attr_head_bbox <> '' then 'head-crop'
  when least(width, height) < 128 then '<128' else '>=128' end as bucket from manifest_v""",
)
def pixel_bucket(spark, sf):
    boxed = F.when(F.col("attributes")["head_bbox"].isNotNull(), "head_crop").otherwise("original")
    return manifest(spark, sf).select(
        "image_id", keys.pixel_bucket("width", "height", boxed).alias("bucket")
    )


# --- validators --------------------------------------------------------------------------------------


def rules(source: str, entity: str, cases: list[tuple[str, str, str]]) -> str:
    """A checking statement listing (entity_id, field, code) of every rule that fires."""
    return " union all ".join(
        f"select {entity} as entity_id, '{field}' as field, '{code}' as code from {source}"
        f" where {condition}"
        for condition, field, code in cases
    )


def coded(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "field", "code")


HEX = "^[0-9a-f]{64}$"


@query(
    "validate_manifest_rows",
    rules(
        "rough_manifest_v",
        "image_id",
        [
            (f"trim({c}) = ''", c, "required")
            for c in validate.REQUIRED_TEXT
        ]
        + [
            (f"contains({c}, ':')", c, "separator")
            for c in ("dataset_id", "individual_label", "side")
        ]
        + [("side not in ('left', 'right')", "side", "enum")]
        + [
            (f"not regexp_matches({c}, '{HEX}')", c, "hex64")
            for c in ("file_sha256", "original_filename_hash")
        ]
        + [
            (f"coalesce(try_cast({c} as int), 0) <= 0", c, "positive")
            for c in ("width", "height")
        ]
        + [
            ("split not in ('unassigned', 'train', 'validation', 'test')", "split", "enum"),
            (
                "capture_timestamp_if_known <> '' and "
                "try_cast(capture_timestamp_if_known as timestamptz) is null",
                "capture_timestamp_if_known",
                "timestamp",
            ),
        ],
    ),
)
def validate_manifest_rows(spark, sf):
    return coded(validate.validate_manifest_rows(rough(spark, sf)))


@query(
    "validate_manifest_cross",
    """select image_id as entity_id, 'image_id' as field, 'duplicate' as code,
    'image_id occurs ' || cast(count(*) as string) || ' times' as message
  from rough_manifest_v group by image_id having count(*) > 1
  union all
  select image_id, 'file_sha256', 'exact_duplicate', 'file ' || substr(file_sha256, 1, 12) ||
    ' is held by ' || cast(copies as string) || ' rows, first ' || first
  from rough_manifest_v join (select file_sha256, count(*) as copies, min(image_id) as first
    from rough_manifest_v group by 1 having count(*) > 1) using (file_sha256)""",
)
def validate_manifest_cross(spark, sf):
    return validate.validate_manifest_cross(rough(spark, sf))


@query(
    "validate_label_paths",
    """with safe as (select relative_path, replace(relative_path, chr(92), '/') as p from label_rows_v),
  kept as (select *, not (starts_with(p, '/') or contains(p, ':') or
    list_contains(string_split(p, '/'), '..')) as ok from safe)
  select relative_path as entity_id, case when not ok then 'escape'
    when not (ends_with(p, '.jpg') or ends_with(p, '.png')) then 'type' else 'missing' end as code
  from kept where not ok or not (ends_with(p, '.jpg') or ends_with(p, '.png'))
    or p not in (select relative_path from files_v)""",
)
def validate_label_paths(spark, sf):
    found = validate.validate_label_paths(
        view(spark, sf, "label_rows_v"), view(spark, sf, "files_v")
    )
    return found.select("entity_id", "code")


@query(
    "validate_provenance",
    rules(
        "provenance_v",
        "dataset_id",
        [
            (f"trim({c}) = ''", c, "required")
            for c in ("license_or_permission", "license_verified_on")
        ]
        + [
            (
                "lower(trim(license_or_permission)) in ('none', 'n/a', 'not applicable', '-') or "
                "regexp_matches(lower(trim(license_or_permission)), "
                "'^(unknown|pending|tbd|to be determined|unverified)')",
                "license_or_permission",
                "unverified",
            ),
            (
                "license_verified_on <> '' and (not regexp_matches(license_verified_on, "
                "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') or try_cast(license_verified_on as date) is null)",
                "license_verified_on",
                "date",
            ),
            ("tier not in ('A', 'B')", "tier", "enum"),
            ("proxy and tier = 'B'", "proxy", "proxy_tier"),
        ],
    ),
)
def validate_provenance(spark, sf):
    return coded(validate.validate_provenance(view(spark, sf, "provenance_v")))


@query(
    "validate_config",
    rules(
        "configs_v",
        "config_id",
        [
            ("model_identifier = ''", "model_identifier", "required"),
            ("algorithm_family not in ('A', 'B', 'C')", "algorithm_family", "enum"),
            ("preprocessing not in ('original', 'head_crop')", "preprocessing", "enum"),
            ("max_side < 32", "max_side", "range"),
            ("algorithm_family = 'C' and not has_training", "training_config", "training"),
            (
                "algorithm_family in ('B', 'C') and pin_repo is null",
                "model_artifact",
                "pin",
            ),
            (
                "pin_repo is not null and model_identifier <> 'hf-hub:' || pin_repo",
                "model_identifier",
                "pin_mismatch",
            ),
        ],
    ),
)
def validate_config(spark, sf):
    return coded(validate.validate_config(configs(spark, sf)))


def pins(spark: SparkSession, sf: str) -> DataFrame:
    files = F.create_map(
        F.lit("config.json"), "config_digest", F.lit("model.bin"), "weights_digest"
    )
    return view(spark, sf, "pins_v").withColumn("files", files)


@query(
    "validate_model_pin",
    rules(
        "pins_v",
        "pin_id",
        [
            ("source <> 'huggingface'", "source", "enum"),
            ("trim(repo_id) = ''", "repo_id", "required"),
            ("not regexp_matches(revision, '^[0-9a-f]{40}$')", "revision", "revision"),
            (f"not regexp_matches(weights_digest, '{HEX}')", "files", "digest"),
            ("weights_file <> 'model.bin'", "weights_file", "unlisted"),
        ],
    ),
)
def validate_model_pin(spark, sf):
    return coded(validate.validate_model_pin(pins(spark, sf)))


@query(
    "artifact_verify",
    """with wanted as (select pin_id, 'c' || substr(pin_id, 5) as file, config_digest as expected
      from pins_v union all
    select pin_id, 'w' || substr(pin_id, 5), weights_digest from pins_v),
  found as (select 'c' || cast(p_partkey as string) as file,
      #['c' || cast(p_partkey as string)]# as sha from part
    union all select 'w' || cast(p_partkey as string), #['w' || cast(p_partkey as string)]# from part
      where p_size < 45)
  select pin_id, file, case when sha is null then 'missing' when sha <> expected then 'mismatch'
    else 'ok' end as status from wanted left join found using (file)""",
)
def artifact_verify(spark, sf):
    from spoorline.sources.adapters import table

    number = F.expr("substr(pin_id, 5)")
    wanted = view(spark, sf, "pins_v").select(
        "pin_id",
        F.create_map(
            F.concat(F.lit("c"), number),
            F.col("config_digest"),
            F.concat(F.lit("w"), number),
            F.col("weights_digest"),
        ).alias("files"),
    )
    part = table(spark, sf, "part").select("p_size", F.col("p_partkey").cast("string").alias("k"))

    def named(letter: str) -> DataFrame:
        name = F.concat(F.lit(letter), "k")
        return part.select("p_size", name.alias("file"), F.sha2(name, 256).alias("file_sha256"))

    held = named("c").unionByName(named("w").filter("p_size < 45"))
    return sinks.artifact_verify(held, wanted)


@query(
    "validate_bbox",
    """with boxed as (select image_id, string_split(attr_head_bbox, ',') as p,
      try_cast(width as int) as w, try_cast(height as int) as h
    from rough_manifest_v where attr_head_bbox <> ''),
  parts as (select *, len(p) = 4 as four, try_cast(p[1] as int) as x0, try_cast(p[2] as int) as y0,
    try_cast(p[3] as int) as x1, try_cast(p[4] as int) as y1 from boxed)
  select image_id as entity_id, 'head_bbox' as field, case when four then 'range' else 'format' end
    as code from parts where not four or
    not (0 <= x0 and x0 < x1 and x1 <= w and 0 <= y0 and y0 < y1 and y1 <= h)""",
)
def validate_bbox(spark, sf):
    return coded(validate.validate_bbox(rough(spark, sf)))


# --- duplicates and links ------------------------------------------------------------------------------

NEAR = """select p.image_id as a, q.image_id as b, cast(bit_count(xor(p.bits, q.bits)) as int)
    as distance from phash_v p join phash_v q
  on p.image_id < q.image_id and bit_count(xor(p.bits, q.bits)) <= 4"""


# the compact form: a star per hash, and the first images of near hashes
COMPACT = """select f.first as a, p.image_id as b, 0 as distance from phash_v p
    join (select bits, min(image_id) as first from phash_v group by bits) f on f.bits = p.bits
    where p.image_id <> f.first
  union all select least(x.first, y.first), greatest(x.first, y.first),
      cast(bit_count(xor(x.bits, y.bits)) as int)
    from (select bits, min(image_id) as first from phash_v group by bits) x
    join (select bits, min(image_id) as first from phash_v group by bits) y
      on x.bits < y.bits and bit_count(xor(x.bits, y.bits)) <= 4"""


def near(spark: SparkSession, sf: str) -> DataFrame:
    return durable(dedup.near_duplicate_pairs(view(spark, sf, "phash_v")))


@query("near_duplicate_pairs", COMPACT)
def near_duplicate_pairs(spark, sf):
    return dedup.near_duplicate_pairs(view(spark, sf, "phash_v"))


@query("expand_near_pairs", NEAR)
def expand_near_pairs(spark, sf):
    return dedup.expand_near_pairs(near(spark, sf), view(spark, sf, "phash_v"))


@query(
    "exact_dedup",
    """with groups as (select file_sha256, min(relative_path) as kept,
      count(distinct individual_label || '|' || side || '|' || capture_session_id) as labels
    from files_v group by 1)
  select case when labels > 1 then 'conflict' when relative_path = kept then 'kept'
    else 'dropped' end as outcome, relative_path,
    case when labels = 1 then kept end as kept from files_v join groups using (file_sha256)""",
)
def exact_dedup(spark, sf):
    marked = dedup.exact_outcomes(view(spark, sf, "files_v"))
    kept = F.when(F.col("outcome") != "conflict", F.col("kept"))
    return marked.select("outcome", "relative_path", kept.alias("kept"))


@query(
    "session_links",
    f"""select m.first as a, x.image_id as b from manifest_v x join (
    select {SIDE} as side_id, capture_session_id as s, min(image_id) as first
    from manifest_v group by 1, 2) m
  on {SIDE} = m.side_id and x.capture_session_id = m.s where x.image_id <> m.first""",
)
def session_links(spark, sf):
    return dedup.session_links(manifest(spark, sf))


FRAMES = """select f.first as a, x.image_id as b from clash_v x join (
    select dataset_id as d, attr_source_frame as s, min(image_id) as first
    from clash_v where attr_source_frame <> '' group by 1, 2) f
  on x.dataset_id = f.d and x.attr_source_frame = f.s where x.image_id <> f.first"""


@query("frame_links", FRAMES)
def frame_links(spark, sf):
    return dedup.frame_links(manifest(spark, sf, "clash_v"))


# excluded: the first image of most hashes
LEFT_OUT = """(v % 10 in (0, 1, 6) or (v // 10) % 2 = 1 and v % 10 = 5)"""


def left_out(rows: DataFrame) -> DataFrame:
    v = F.substring("image_id", 5, 10).cast("bigint")
    first = (v % 10).isin(0, 1, 6) | ((F.floor(v / 10) % 2 == 1) & (v % 10 == 5))
    return rows.filter(first).select("image_id", F.lit("unusable").alias("reason"))


CLASHES = f"""with sides as (select image_id, v, {SIDE} as side_id from clash_v where not {LEFT_OUT}),
  near_ as ({NEAR}),
  met as (select a, b, x.side_id as side_a, y.side_id as side_b from near_
    join sides x on x.image_id = a join sides y on y.image_id = b where x.side_id <> y.side_id)"""


@query(
    "label_conflicts",
    CLASHES + """ select image_id, side_id, other_side, min(other_id) as other_id from (
    select a as image_id, side_a as side_id, b as other_id, side_b as other_side from met
    union all select b, side_b, a, side_a from met) group by 1, 2, 3""",
)
def label_conflicts(spark, sf):
    rows = manifest(spark, sf, "clash_v")
    rows = split.active_rows(rows, left_out(rows))
    return dedup.near_conflicts(rows, near(spark, sf))


@query("label_conflict_pairs", CLASHES + " select a, b, side_a, side_b from met")
def label_conflict_pairs(spark, sf):
    rows = manifest(spark, sf, "clash_v")
    rows = split.active_rows(rows, left_out(rows))
    return dedup.near_conflict_pairs(rows, near(spark, sf), view(spark, sf, "phash_v"))


@query(
    "frame_conflicts",
    f"""with sides as (select image_id, {SIDE} as side_id from clash_v)
  select a, b, x.side_id as side_a, y.side_id as side_b from ({FRAMES})
    join sides x on x.image_id = a join sides y on y.image_id = b where x.side_id <> y.side_id""",
)
def frame_conflicts(spark, sf):
    rows = manifest(spark, sf, "clash_v")
    links = dedup.frame_links(rows).withColumn("reason", F.lit("source frame"))
    return dedup.label_conflicts(rows, links).drop("reason")


BURST = 3600
# consecutive photos of one identity with a gap of at most BURST seconds form one burst
BURST_GROUPS = f"""with timed as (select image_id, individual_label as who,
    event_id % 5 = 0 as aware, us from (select *, cast(substr(image_id, 4) as bigint) as event_id
      from captures_v) where capture_timestamp_if_known <> ''),
  cut as (select *, case when us - lag(us) over w <= {BURST * 1_000_000} then 0 else 1 end as fresh
    from timed window w as (partition by who, aware order by us, image_id)),
  runs as (select *, sum(fresh) over (partition by who, aware order by us, image_id
    rows unbounded preceding) as run from cut)"""


@query(
    "burst_pairs",
    BURST_GROUPS
    + """, named as (select image_id, min(image_id) over (partition by who, aware, run) as burst,
    count(*) over (partition by who, aware, run) as n from runs)
  select image_id, burst from named where n > 1""",
)
def burst_pairs(spark, sf):
    """The burst of every image in one: components of the burst links, named by smallest id."""
    captures = keys.fold_attributes(view(spark, sf, "captures_v"))
    links = dedup.burst_pairs(captures, BURST)
    return graph.components(links).select(
        F.col("node").alias("image_id"), F.col("root").alias("burst")
    )


@query(
    "link_union",
    f"""select distinct a, b from (select a, b from ({COMPACT}) union all
    select m.first as a, x.image_id as b from manifest_v x join (
      select {SIDE} as side_id, capture_session_id as s, min(image_id) as first
      from manifest_v group by 1, 2) m
    on {SIDE} = m.side_id and x.capture_session_id = m.s where x.image_id <> m.first)""",
)
def link_union(spark, sf):
    return dedup.link_union(near(spark, sf), dedup.session_links(manifest(spark, sf)))


def groups_sql(burst: int, near_sql: str = NEAR) -> str:
    """Leakage groups by exhaustive pair rules and reachability."""
    return f"""with recursive rows_ as (select v, image_id, {SIDE} as side_id,
    dataset_id || ':' || individual_label as individual, capture_session_id, attr_source_frame,
    capture_timestamp_if_known from manifest_v),
  near_ as ({near_sql}),
  edges as (select x.image_id as a, y.image_id as b from rows_ x join rows_ y
      on x.side_id = y.side_id and x.image_id <> y.image_id where
      x.capture_session_id = y.capture_session_id
      or (x.attr_source_frame <> '' and x.attr_source_frame = y.attr_source_frame)
      or ({burst} > 0 and x.capture_timestamp_if_known <> '' and
        y.capture_timestamp_if_known <> '' and (x.v % 13 = 0) = (y.v % 13 = 0)
        and abs(x.v - y.v) * 37 <= {burst})
      or exists (select 1 from near_ n where (n.a = x.image_id and n.b = y.image_id)
        or (n.b = x.image_id and n.a = y.image_id))),
  reach(a, b) as (select image_id, image_id from rows_ union
    select r.a, e.b from reach r join edges e on r.b = e.a),
  grouped as (select r.a as image_id, 'g:' || min(r.b) as grp from reach r group by r.a),
  members as (select rows_.*, grp from rows_ join grouped using (image_id))"""


@query(
    "leakage_groups",
    groups_sql(60) + ' select image_id, side_id, grp as "group" from members',
)
def leakage_groups(spark, sf):
    return graph.leakage_groups(manifest(spark, sf), near(spark, sf), 60)


# --- splits ---------------------------------------------------------------------------------------------


def partition_sql(source: str) -> str:
    return f""", people as (select individual, row_number() over (order by
      #['7:' || individual]#) as place, count(*) over () as n
      from (select distinct individual from {source})),
  partitions as (select individual, case
      when place <= floor(n * cast(0.2 as double)) then 'train'
      when place <= floor(n * cast(0.2 as double)) + floor(n * cast(0.4 as double)) then 'validation'
      else 'test' end as part from people)"""


UNKNOWN = """, drawn as (select individual, part, eligible,
      row_number() over (partition by part, eligible order by #['8:' || individual]#) as place,
      round_even(count(*) over (partition by part) * cast(0.3 as double), 0) as target,
      count(*) filter (where not eligible) over (partition by part) as forced
    from partitions join eligibility using (individual)),
  chosen as (select individual, part, part <> 'train' and
      (not eligible or place <= target - forced) as unknown from drawn)"""

ELIGIBLE = """, eligibility as (select individual, max(n) >= 2 as eligible from
    (select individual, side_id, count(distinct grp) as n from members group by 1, 2) group by 1)"""

ROLES = """, stamped as (select side_id, individual, grp,
      min(nullif(capture_timestamp_if_known, '')) as stamp from members group by 1, 2, 3),
  ordered as (select *, row_number() over (partition by side_id order by
      case when stamp is null then 1 else 0 end, coalesce(stamp, #['7:' || grp]#), grp) as place,
      count(*) over (partition by side_id) as n from stamped),
  cut as (select *, case when n >= 2 then greatest(1, floor(n * cast(0.5 as double))) else 0 end
      as nq from ordered),
  roles as (select side_id, grp, part, case when part = 'train' then 'train'
      when unknown then 'query_unknown' when place > n - nq then 'query_known'
      else 'gallery' end as role, place from cut join chosen using (individual)),
  assigned as (select image_id, individual, side_id, part, role, grp
      from members join roles using (side_id, grp))"""

SPLIT = groups_sql(0) + partition_sql("members") + ELIGIBLE + UNKNOWN + ROLES


def people(spark: SparkSession, sf: str) -> DataFrame:
    return keys.with_keys(manifest(spark, sf)).select("individual")


def built(spark: SparkSession, sf: str) -> DataFrame:
    return split.build_split(manifest(spark, sf), near(spark, sf), PARAMS)


@query(
    "partition_individuals",
    "with rows_ as (select distinct dataset_id || ':' || individual_label as individual"
    " from manifest_v)" + partition_sql("rows_") + ' select individual, part as "partition" from partitions',
)
def partition_individuals(spark, sf):
    return split.partition_individuals(people(spark, sf), PARAMS)


def eligibility(groups: DataFrame) -> DataFrame:
    per_side = groups.withColumn(
        "individual", F.regexp_extract("side_id", r"^(.*):[^:]*$", 1)
    ).groupBy("individual", "side_id").agg(F.count_distinct("group").alias("n"))
    return per_side.groupBy("individual").agg((F.max("n") >= 2).alias("eligible"))


@query(
    "choose_unknown",
    groups_sql(0) + partition_sql("members") + ELIGIBLE + UNKNOWN
    + ' select individual, part as "partition", unknown from chosen',
)
def choose_unknown(spark, sf):
    groups = durable(graph.leakage_groups(manifest(spark, sf), near(spark, sf)))
    partitions = split.partition_individuals(people(spark, sf), PARAMS)
    return split.choose_unknown(partitions, eligibility(groups), PARAMS)


@query("order_groups", SPLIT + ' select side_id, grp as "group", place from ordered')
def order_groups(spark, sf):
    rows = manifest(spark, sf)
    groups = graph.leakage_groups(rows, near(spark, sf))
    stamped = groups.join(rows.select("image_id", "capture_timestamp_if_known"), "image_id")
    return split.order_groups(stamped, PARAMS.seed)


@query("assign_roles", SPLIT + ' select side_id, grp as "group", part as "partition", role from roles')
def assign_roles(spark, sf):
    rows = manifest(spark, sf)
    groups = durable(graph.leakage_groups(rows, near(spark, sf)))
    stamped = groups.join(rows.select("image_id", "capture_timestamp_if_known"), "image_id")
    partitions = split.partition_individuals(people(spark, sf), PARAMS)
    unknown = split.choose_unknown(partitions, eligibility(groups), PARAMS)
    return split.assign_roles(split.order_groups(stamped, PARAMS.seed), unknown, PARAMS)


ASSIGNED = """ select image_id, individual, side_id, part as "partition", role, grp as "group",
  '' as reason from assigned"""


@query("build_split", SPLIT + ASSIGNED)
def build_split(spark, sf):
    return built(spark, sf)


ACTIVE_SPLIT = SPLIT.replace(
    "from manifest_v),\n  near_", f"from manifest_v where not {LEFT_OUT}),\n  near_"
)


def built_without(spark: SparkSession, sf: str) -> DataFrame:
    rows = manifest(spark, sf)
    return durable(split.build_split(rows, near(spark, sf), PARAMS, left_out(rows)))


@query(
    "build_split_excluded",
    ACTIVE_SPLIT
    + ASSIGNED
    + f""" union all select image_id, dataset_id || ':' || individual_label, {SIDE}, 'excluded',
    'excluded', '', 'unusable' from manifest_v where {LEFT_OUT}""",
)
def build_split_excluded(spark, sf):
    return built_without(spark, sf)


# every second image of a class moved to the other role: near copies on both sides of a split
@query(
    "verify_split_excluded",
    ACTIVE_SPLIT
    + """, moved as (select image_id, grp, case when role in ('gallery', 'query_known') and
      cast(substr(image_id, 5, 10) as bigint) % 10 in (4, 8) then case role when 'gallery'
        then 'query_known' else 'gallery' end else role end as role from assigned)
  select grp as entity, min(role) || ',' || max(role) as detail from moved group by grp
    having min(role) <> max(role)""",
)
def verify_split_excluded(spark, sf):
    rows = built_without(spark, sf)
    pairs, images = near(spark, sf), manifest(spark, sf)
    other = F.when(F.col("role") == "gallery", "query_known").otherwise("gallery")
    moves = F.col("role").isin("gallery", "query_known") & (
        F.substring("image_id", 5, 10).cast("bigint") % 10
    ).isin(4, 8)
    moved = durable(rows.withColumn("role", F.when(moves, other).otherwise(F.col("role"))))
    header = split.seal(moved, images, pairs, PARAMS)
    found = split.verify_split(moved, header, images, pairs)
    return found.filter("rule = 'group_roles'").select("entity", "detail")


DIAGNOSTIC = f"""with recursive members as (select image_id, {SIDE} as side_id,
    dataset_id || ':' || individual_label as individual, 'i:' || image_id as grp,
    capture_timestamp_if_known from manifest_v)""" + partition_sql("members") + ELIGIBLE + UNKNOWN + """,
  ordered as (select *, row_number() over (partition by side_id order by #['7:' || image_id]#) as place,
    count(*) over (partition by side_id) as n from members),
  assigned as (select image_id, individual, side_id, part, case when part = 'train' then 'train'
    when unknown then 'query_unknown'
    when n >= 2 and place <= greatest(1, floor(n * cast(0.5 as double))) then 'query_known'
    else 'gallery' end as role, grp from ordered join chosen using (individual))"""


@query("diagnostic_split", DIAGNOSTIC + ASSIGNED)
def diagnostic_split(spark, sf):
    return split.diagnostic_split(manifest(spark, sf), PARAMS)


@query(
    "split_summary",
    SPLIT
    + """ select part as "partition", role, cast(count(*) as bigint) as images,
  cast(count(distinct side_id) as bigint) as side_ids,
  cast(count(distinct individual) as bigint) as individuals from assigned group by 1, 2""",
)
def split_summary(spark, sf):
    return split.split_summary(built(spark, sf))


@query(
    "role_filter",
    SPLIT + " select role, image_id from assigned where part = 'test'",
)
def role_filter(spark, sf):
    return split.role_filter(built(spark, sf), "test")


@query(
    "dataset_stats",
    SPLIT
    + """, used as (select a.*, capture_session_id from assigned a join rows_ using (image_id)
    where part = 'test'),
  known as (select side_id, count(*) as n, count(distinct capture_session_id) as s from used
    where role in ('gallery', 'query_known') group by 1)
  select cast((select count(distinct side_id) from used where role = 'gallery') as bigint)
      as known_side_ids,
    cast((select coalesce(min(n), 0) from known) as bigint) as min_images_per_known_side_id,
    cast((select count(*) from known where s >= 2) as bigint) as side_ids_with_two_sessions,
    cast((select count(distinct side_id) from used where role = 'query_unknown') as bigint)
      as unseen_side_ids""",
)
def dataset_stats(spark, sf):
    return mt.dataset_stats(built(spark, sf), manifest(spark, sf), "test")


def tampered(rows: DataFrame) -> DataFrame:
    """A split with planted faults: moved roles, lost images, strangers, repeats."""
    n = F.substring("image_id", 5, 10).cast("bigint")
    moved = rows.filter(n % 50 != 3).withColumns(
        {
            "role": F.when(n % 20 == 3, "query_known")
            .when(n % 40 == 15, "train")
            .otherwise(F.col("role")),
            "partition": F.when(n % 60 == 27, "test").otherwise(F.col("partition")),
        }
    )
    stranger = rows.filter(n % 100 == 7).withColumn(
        "image_id", F.concat("image_id", F.lit("-x"))
    )
    return moved.unionByName(stranger).unionByName(moved.filter(n % 50 == 11))


TAMPERED = """, numbered as (select *, cast(substr(image_id, 5, 10) as bigint) as n from assigned),
  moved as (select image_id, individual, side_id,
      case when n % 60 = 27 then 'test' else part end as part,
      case when n % 20 = 3 then 'query_known' when n % 40 = 15 then 'train' else role end as role,
      grp, n from numbered where n % 50 <> 3),
  tampered as (select image_id, individual, side_id, part, role, grp from moved
    union all select image_id || '-x', individual, side_id, part, role, grp from numbered
      where n % 100 = 7
    union all select image_id, individual, side_id, part, role, grp from moved where n % 50 = 11),
  problems as (select image_id, 'not assigned' as problem from rows_
      where image_id not in (select image_id from tampered)
    union all select distinct image_id, 'not in manifest' from tampered
      where image_id not in (select image_id from rows_)
    union all select image_id, 'assigned ' || cast(count(*) as string) || ' times' from tampered
      group by 1 having count(*) > 1)"""


@query("split_manifest_join", SPLIT + TAMPERED + " select image_id, problem from problems")
def split_manifest_join(spark, sf):
    return split.split_manifest_join(tampered(durable(built(spark, sf))), manifest(spark, sf))


@query(
    "unassigned",
    SPLIT + TAMPERED + " select image_id from problems where problem = 'not assigned'",
)
def unassigned(spark, sf):
    return split.unassigned(manifest(spark, sf), tampered(durable(built(spark, sf))))


@query(
    "extra_assignments",
    SPLIT + TAMPERED + " select image_id from problems where problem = 'not in manifest'",
)
def extra_assignments(spark, sf):
    return split.extra_assignments(tampered(durable(built(spark, sf))), manifest(spark, sf))


VIOLATIONS = """, active as (select t.*, capture_session_id from tampered t
    join rows_ r on r.image_id = t.image_id),
  violations as (
    select 'coverage' as rule, image_id as entity, problem as detail from problems
    union all select 'role', image_id, part || '/' || role from active
      where (part = 'train') <> (role = 'train')
    union all select 'individual_partitions', individual, min(part) || ',' || max(part) from active
      group by individual having min(part) <> max(part)
    union all select 'unknown_in_gallery', individual,
      'unknown individual has gallery or known-query images' from active group by individual
      having bool_or(role = 'query_unknown') and bool_or(role in ('gallery', 'query_known'))
    union all select 'no_gallery', side_id, part from active group by side_id, part
      having bool_or(role = 'query_known') and not bool_or(role = 'gallery')
    union all select 'session_leakage', side_id, capture_session_id from active
      group by side_id, capture_session_id
      having bool_or(role = 'gallery') and bool_or(role = 'query_known'))"""
REGROUPED = """, present as (select distinct image_id from active),
  again(a, b) as (select image_id, image_id from present union
    select r.a, e.b from again r join edges e on r.b = e.a
      where e.b in (select image_id from present)),
  found as (select a as image_id, 'g:' || min(b) as g from again group by a)"""


@query(
    "verify_split",
    SPLIT + TAMPERED + VIOLATIONS + REGROUPED
    + """ select rule, entity, detail from violations
  union all select 'group_roles', g, min(role) || ',' || max(role) from active
    join found using (image_id) group by g having min(role) <> max(role)
  union all select 'seal', 'intact', 'false'""",
)
def verify_split(spark, sf):
    rows, pairs = manifest(spark, sf), near(spark, sf)
    honest = durable(split.build_split(rows, pairs, PARAMS))
    header = split.seal(honest, rows, pairs, PARAMS)
    found = split.verify_split(tampered(honest), header, rows, pairs)
    sealed = F.col("rule") == "seal"
    return found.select(
        "rule",
        F.when(sealed, "intact").otherwise(F.col("entity")).alias("entity"),
        F.when(sealed, "false").otherwise(F.col("detail")).alias("detail"),
    )


@query(
    "degenerate_partitions",
    SPLIT
    + """ select p.part as "partition", r.role from
  (values ('validation'), ('test')) p(part),
  (values ('gallery'), ('query_known'), ('query_unknown')) r(role)
  where not exists (select 1 from assigned a where a.part = p.part and a.role = r.role
    and a.side_id like '%:left' and a.role <> 'query_unknown')""",
)
def degenerate_partitions(spark, sf):
    rows = built(spark, sf)
    kept = rows.filter(F.col("side_id").endswith(":left") & (F.col("role") != "query_unknown"))
    return split.degenerate_partitions(kept)


@query(
    "active_rows",
    """select image_id, case when v % 9 = 4 then 'blurred' else '' end as reason from manifest_v""",
)
def active_rows(spark, sf):
    """Active rows, and the excluded ones with their reason."""
    rows = manifest(spark, sf)
    n = F.substring("image_id", 5, 10).cast("bigint")
    excluded = rows.filter(n % 9 == 4).select("image_id", F.lit("blurred").alias("reason"))
    active = split.active_rows(rows, excluded)
    return active.select("image_id", F.lit("").alias("reason")).unionByName(excluded)


def tree_sql(leaves: str) -> str:
    """(n, digest) by the hash tree over ``leaves`` (h, c)."""
    level = "string_agg(t, chr(10) order by t)"
    return f"""select cast(sum(c) as bigint) as n, sha256({level}) as digest from (
    select k || ':' || sha256({level}) as t, sum(c) as c from (
      select substr(k, 1, 3) as k, t, c from (
        select k, k || ':' || sha256({level}) as t, sum(c) as c from (
          select substr(k, 1, 6) as k, t, c from (
            select k, k || ':' || sha256({level}) as t, sum(c) as c from (
              select substr(h, 1, 9) as k, h || ':' || cast(c as string) as t, c from ({leaves}))
            group by k)) group by k)) group by k)"""


@query(
    "content_hash",
    tree_sql(f"select sha256({CANONICAL}) as h, count(*) as c from manifest_v group by 1"),
)
def content_hash(spark, sf):
    return digest.manifest_hash(manifest(spark, sf))


@query(
    "content_hash_wide",
    tree_sql("select sha256(id || '|' || sha256) as h, count(*) as c from media_v group by 1"),
)
def content_hash_wide(spark, sf):
    text = F.concat("id", F.lit("|"), "sha256")
    return digest.content_hash(view(spark, sf, "media_v"), text)


@query(
    "near_pairs_hash",
    tree_sql(f"""select sha256('["' || a || '","' || b || '"]') as h, count(*) as c
      from ({COMPACT}) group by 1"""),
)
def near_pairs_hash(spark, sf):
    return digest.near_pairs_hash(near(spark, sf))


ROW_TEXT = """'{"group":"' || grp || '","image_id":"' || image_id || '","individual":"' || individual
  || '","partition":"' || part || '","reason":"","role":"' || role || '","side_id":"' || side_id
  || '"}'"""


@query(
    "seal",
    SPLIT
    + " select n as images, digest as assignments_sha256, 'SESSION-DISJOINT' as label from ("
    + tree_sql(f"select sha256({ROW_TEXT}) as h, count(*) as c from assigned group by 1")
    + ")",
)
def seal(spark, sf):
    rows = durable(built(spark, sf))
    header = split.seal(rows, manifest(spark, sf), near(spark, sf), PARAMS)
    return header.select("images", "assignments_sha256", "label")


@query(
    "verify_seal",
    SPLIT
    + """ select 'honest' as copy, count(*) > 0 as intact from assigned
  union all select 'tampered', count(*) < 0 from assigned""",
)
def verify_seal(spark, sf):
    honest = durable(built(spark, sf))
    header = split.seal(honest, manifest(spark, sf), near(spark, sf), PARAMS)
    checks = [("honest", honest), ("tampered", tampered(honest))]
    parts = [
        split.verify_seal(rows, header).select(F.lit(name).alias("copy"), "intact")
        for name, rows in checks
    ]
    return parts[0].unionByName(parts[1])


@query(
    "inventory",
    f"""with rows_ as (select *, {SIDE} as side_id from manifest_v),
  sides as (select side_id, side, count(*) as images, count(distinct capture_session_id) as sessions
    from rows_ group by 1, 2)
  select 'image_count' as measure, '' as key, cast(count(*) as bigint) as n from rows_
  union all select 'individual_count', '', count(distinct individual_label) from rows_
  union all select 'side_id_count', '', count(*) from sides
  union all select 'side_ids_with_at_least_4_images', '', count(*) from sides where images >= 4
  union all select 'side_ids_with_at_least_2_sessions', '', count(*) from sides where sessions >= 2
  union all select 'timestamps_known', '', count(*) from rows_ where capture_timestamp_if_known <> ''
  union all select 'side_counts', side, count(*) from rows_ group by side
  union all select 'images_per_side_id', cast(images as string), count(*) from sides group by images
  union all select 'sessions_per_side_id', cast(sessions as string), count(*) from sides
    group by sessions""",
)
def inventory(spark, sf):
    return mt.inventory(manifest(spark, sf))


@query(
    "bounded_errors",
    """with bad as (select image_id || ': side must be left or right' as line from rough_manifest_v
    where side not in ('left', 'right')),
  firsts as (select line from bad order by line limit 10)
  select (select string_agg(line, '; ' order by line) from firsts) ||
    case when count(*) > 10 then '; ... (+' || cast(count(*) - 10 as string) || ' more)' else '' end
    as summary, cast(count(*) as bigint) as total from bad""",
)
def bounded_errors(spark, sf):
    found = validate.validate_manifest_rows(rough(spark, sf))
    return mt.bounded_errors(found.filter((F.col("field") == "side") & (F.col("code") == "enum")))

