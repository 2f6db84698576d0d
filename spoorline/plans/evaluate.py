"""Whole flows: ingest, split and evaluate, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.dedup import exact_dedup, near_duplicate_pairs
from spoorline.operators.keys import build_manifest, pixel_bucket
from spoorline.operators.metrics import (
    calibrate_threshold,
    closed_set_metrics,
    dataset_stats,
    open_set_metrics,
    stratify_all_attributes,
    threshold_value,
)
from spoorline.operators.scorers import COSINE, Scorer
from spoorline.operators.similarity import true_rank_blocks
from spoorline.operators.split import (
    SplitError,
    SplitParameters,
    build_split,
    degenerate_partitions,
    seal,
    verify_split,
)
from spoorline.operators.validate import validate_label_paths
from spoorline.session import durable
from spoorline.sources.files import checked


def ingest(labels: DataFrame, files: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, dropped): labels checked against files, exact copies dropped, rows built.

    ``files``: relative_path, file_sha256, width, height.
    """
    checked(labels, validate_label_paths(labels, files))
    sized = labels.join(files, "relative_path")
    kept, dropped, conflicts = exact_dedup(sized)
    if not conflicts.isEmpty():
        raise SplitError.of(
            conflicts, "conflicting labels for identical files", F.concat_ws(" ", "file_sha256", "relative_path")
        )
    facts = ["file_sha256", "width", "height"]
    return build_manifest(
        kept.drop(*facts), kept.select("relative_path", *facts), provenance
    ), dropped


def make_split(
    manifest: DataFrame,
    phash: DataFrame,
    params: SplitParameters,
    max_distance: int = 4,
    excluded: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(assignments, header): built, sealed, independently verified, refused if degenerate."""
    pairs = durable(near_duplicate_pairs(phash, max_distance))
    assignments = durable(build_split(manifest, pairs, params, excluded))
    header = seal(assignments, manifest, pairs, params)
    violations = verify_split(assignments, header, manifest, pairs)
    violations = durable(violations)
    if not violations.isEmpty():
        raise SplitError.of(violations, "split violates", F.concat_ws(": ", "rule", "entity"))
    missing = degenerate_partitions(assignments)
    if not missing.isEmpty():
        raise SplitError.of(missing, "no images for", F.concat_ws(" ", "partition", "role"))
    return assignments, header


@dataclass(frozen=True)
class Evaluation:
    ranks: DataFrame
    known_best: DataFrame
    unknown_best: DataFrame
    threshold: float
    closed: DataFrame
    opened: DataFrame
    strata: DataFrame
    stats: DataFrame


def evaluate(
    manifest: DataFrame,
    features: DataFrame,
    assignments: DataFrame,
    partition: str,
    preprocessing: str = "original",
    target_far: float = 0.05,
    threshold: float | None = None,
    scorer: Scorer = COSINE,
) -> Evaluation:
    """Score one partition of a split against its gallery.

    ``features``: image_id and the scorer's columns (for cosine, ``vector`` of unit length). VALIDATION
    calibrates the threshold; TEST must be given the calibrated one and uses it unchanged.
    """
    if partition == "test" and threshold is None:
        raise ValueError("TEST reuses the threshold calibrated on VALIDATION")
    rows = assignments.filter(F.col("partition") == partition).join(features.select("image_id", *scorer.columns), "image_id")
    gallery = rows.filter(F.col("role") == "gallery").select(
        F.col("image_id").alias("gallery_id"), "side_id", *scorer.columns
    )
    known = F.col("role") == "query_known"
    queries = rows.filter(F.col("role").isin("query_known", "query_unknown")).select(
        F.col("image_id").alias("query_id"),
        *scorer.columns,
        F.when(known, F.col("side_id")).alias("truth"),
    )
    ranked = durable(true_rank_blocks(queries, gallery, scorer=scorer))
    # a known query always has a rank: its identity has gallery images in a verified split
    is_known = queries.filter(F.col("truth").isNotNull()).select("query_id")
    known_rows = durable(ranked.join(is_known, "query_id"))
    if not known_rows.filter(F.col("rank").isNull()).isEmpty():
        raise ValueError("a known query's identity is not in the gallery")
    ranks = known_rows.select("query_id", "rank")
    known_best = known_rows.select("query_id", "best")
    unknown_best = ranked.join(is_known, "query_id", "left_anti").select("query_id", "best")
    if threshold is None:
        threshold = threshold_value(calibrate_threshold(unknown_best, target_far))
    described = manifest.select(
        F.col("image_id").alias("query_id"),
        F.map_concat(
            # a manifest's own attributes of these names give way to the computed ones
            F.map_filter("attributes", lambda k, _: ~k.isin("side", "head_pixels")),
            F.create_map(
                F.lit("side"),
                F.col("side"),
                F.lit("head_pixels"),
                pixel_bucket("width", "height", F.lit(preprocessing)),
            ),
        ).alias("attributes"),
    )
    return Evaluation(
        ranks=ranks,
        known_best=known_best,
        unknown_best=unknown_best,
        threshold=threshold,
        closed=closed_set_metrics(ranks),
        opened=open_set_metrics(ranks, known_best, unknown_best, threshold),
        strata=stratify_all_attributes(ranks, described),
        stats=dataset_stats(assignments, manifest, partition),
    )
