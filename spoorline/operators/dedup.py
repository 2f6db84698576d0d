"""Exact and near duplicates, bursts, shared frames, and label conflicts.

Links are kept compact: a set of n linked rows is a star of n - 1 links to its smallest id, never
the n * (n - 1) / 2 pairs, so copies and bursts of any size stay linear.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.keys import side_id
from spoorline.operators.skew import lookup, with_group_facts
from spoorline.operators.validate import is_aware, known_instant
from spoorline.session import durable

BITS = 64


def exact_outcomes(labelled: DataFrame) -> DataFrame:
    """The labelled files with ``outcome`` (kept, dropped or conflict) and the ``kept`` path of their content.

    Per content hash the smallest path is kept; a hash whose copies disagree on label, side or
    session is a conflict and neither kept nor dropped.
    """
    label = F.struct("individual_label", "side", "capture_session_id")
    facts = [F.min("relative_path").alias("kept"), F.min(label).alias("_low"), F.max(label).alias("_high")]
    marked = with_group_facts(labelled, ["file_sha256"], facts)
    outcome = (
        F.when(F.col("_low") != F.col("_high"), "conflict")
        .when(F.col("relative_path") == F.col("kept"), "kept")
        .otherwise("dropped")
    )
    return marked.withColumn("outcome", outcome).drop("_low", "_high")


def exact_dedup(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, conflicts) of labelled files, by ``exact_outcomes``."""
    marked = exact_outcomes(labelled)
    kept = marked.filter("outcome = 'kept'").select(*labelled.columns)
    dropped = marked.filter("outcome = 'dropped'").select("kept", F.col("relative_path").alias("dropped"))
    conflicts = marked.filter("outcome = 'conflict'").select("file_sha256", "relative_path")
    return kept, dropped, conflicts


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _long_array(values: list[int]) -> str:
    return "array(" + ",".join(f"cast({_signed(v)} as bigint)" for v in values) + ")"


def band_masks(max_distance: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` bands out of max_distance + equal.

    Two words that differ in at most max_distance bits touch at most that many bands, so at least
    ``equal`` bands agree and one mask below selects the same bits in both.
    """
    bands = max_distance + equal
    edges = [BITS * i // bands for i in range(bands + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    return [sum(chosen) for chosen in combinations(single, equal)]


def _bands_needed(rows: int, max_distance: int) -> int:
    """Fewest agreeing bands that leave a handful of unrelated words per bucket."""
    for equal in range(1, 5):
        if rows / 2 ** (BITS * equal / (max_distance + equal)) <= 4:
            return equal
    return 4


def _ball(radius: int) -> list[int]:
    """Every word with at most ``radius`` bits set."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(BITS), r)]
    return out


def hash_pairs(
    hashes: DataFrame, max_distance: int, bucket_limit: int | None = None
) -> DataFrame:
    """Pairs of distinct words within a Hamming distance: ``hashes`` is (rep, dhash), unique dhash.

    Exact in two parts. Words meet in buckets of equal bands. A bucket above the limit is not
    joined; its words meet instead at the words half the distance away from each, where a bucket
    can never hold more than the size of that ball, however the data is skewed.
    """
    empty = hashes.limit(0).select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance")
    )
    if max_distance < 1:
        return empty
    rows = hashes.count()
    masks = band_masks(max_distance, _bands_needed(rows, max_distance))
    radius = (max_distance + 1) // 2
    ball_size = sum(comb(BITS, r) for r in range(radius + 1))
    enumerable = radius <= 3
    limit = bucket_limit if bucket_limit is not None else 2 * ball_size
    mask_list = _long_array(masks)
    keyed = hashes.select(
        "rep", "dhash", F.posexplode(F.expr(f"transform({mask_list}, m -> dhash & m)"))
    ).toDF("rep", "dhash", "mask", "key")
    hot_words = None
    if enumerable and rows > limit:
        sized = durable(
            with_group_facts(keyed, ["mask", "key"], [F.count(F.lit(1)).alias("held")])
        )
        keyed = sized.filter(F.col("held") <= limit).select(*keyed.columns)
        hot_words = sized.filter(F.col("held") > limit).select("rep", "dhash").distinct()
    left = keyed.toDF("ra", "ha", "mask", "key")
    right = keyed.toDF("rb", "hb", "mask", "key")
    close = F.expr("bit_count(ha ^ hb)") <= max_distance
    # a pair that agrees on several masks is reported at the first of them only
    first_mask = F.expr(
        f"array_position(transform({mask_list}, m -> (ha ^ hb) & m), 0L) = mask + 1"
    )
    met = left.join(right, ["mask", "key"]).filter("ha < hb").filter(close).filter(first_mask)
    met = met.select("ra", "ha", "rb", "hb")
    if hot_words is not None:
        near = hot_words.withColumn(
            "key", F.explode(F.expr(f"transform({_long_array(_ball(radius))}, m -> dhash ^ m)"))
        )
        wide = (
            near.toDF("ra", "ha", "key")
            .join(near.toDF("rb", "hb", "key"), "key")
            .filter("ha < hb")
            .filter(close)
            .select("ra", "ha", "rb", "hb")
        )
        met = met.unionByName(wide).distinct()
    return met.select(
        F.least("ra", "rb").alias("a"),
        F.greatest("ra", "rb").alias("b"),
        F.expr("bit_count(ha ^ hb)").cast("int").alias("distance"),
    )


def near_duplicate_pairs(
    phash: DataFrame, max_distance: int = 4, bucket_limit: int | None = None
) -> DataFrame:
    """Near pairs (a < b, distance) of ``phash`` (image_id, dhash), lossless and linear in copies.

    Images with one identical hash appear as a star around the smallest id (distance 0); the
    smallest id stands for all of them in pairs with other hashes. ``near_links`` and
    ``near_conflicts`` read this form for any subset of the images; ``expand_near_pairs`` lists every
    image-level pair where that listing is wanted.
    """
    reps = durable(phash.groupBy("dhash").agg(F.min("image_id").alias("rep")).select("rep", "dhash"))
    across = hash_pairs(reps, max_distance, bucket_limit)
    copies = _star(phash.select("image_id", "dhash"), ["dhash"]).withColumn("distance", F.lit(0))
    return across.unionByName(copies)


def hash_classes(pairs: DataFrame) -> DataFrame:
    """(image_id, class) of every image that near pairs name; a class holds the images of one hash.

    The class is called by its smallest image, which need not be active any more.
    """
    pairs = _measured(pairs)
    copies = pairs.filter("distance = 0").select(F.col("b").alias("image_id"), F.col("a").alias("class"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("image_id"), "distance")
    first = named.join(copies.select("image_id"), "image_id", "left_anti").select("image_id").distinct()
    return first.select("image_id", F.col("image_id").alias("class")).unionByName(copies)


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs without a distance are links between different hashes."""
    return pairs if "distance" in pairs.columns else pairs.withColumn("distance", F.lit(1))


def _class_sides(manifest: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, side_id, class) of the manifest's images, and the first of each class and side."""
    sides = manifest.select("image_id", side_id().alias("side_id"))
    held = durable(sides.join(hash_classes(pairs), "image_id"))
    return held, held.groupBy("class", "side_id").agg(F.min("image_id").alias("first"))


def near_links(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) that connect, inside each identity side, the near duplicates in ``manifest``.

    Centres are chosen among the manifest's own images of one hash and one side, so a link survives
    the exclusion of any other image of its class. Linear in images and in pairs of hashes.
    """
    pairs = _measured(pairs)
    held, firsts = _class_sides(manifest, pairs)
    copies = held.join(firsts, ["class", "side_id"]).filter("image_id <> first")
    across = (
        pairs.filter("distance > 0").select(F.col("a").alias("class"), F.col("b").alias("other"))
        .join(firsts.withColumnRenamed("first", "first_a"), "class")
        .join(firsts.select(F.col("class").alias("other"), "side_id", F.col("first").alias("first_b")), ["other", "side_id"])
    )
    return copies.select(F.col("first").alias("a"), F.col("image_id").alias("b")).unionByName(
        across.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    )


def near_conflicts(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, side_id, other_id, other_side): every image that is near one of another identity side.

    One row per conflicting image and conflicting side, with that side's smallest such image; the
    image pairs themselves are listed by ``near_conflict_pairs``.
    """
    pairs = _measured(pairs)
    held, firsts = _class_sides(manifest, pairs)
    across = pairs.filter("distance > 0").select(F.col("a").alias("class"), F.col("b").alias("other"))
    beside = across.unionByName(across.select(F.col("other").alias("class"), F.col("class").alias("other")))
    beside = beside.unionByName(held.select("class", F.col("class").alias("other")).distinct())
    others = firsts.select(F.col("class").alias("other"), F.col("side_id").alias("other_side"), F.col("first").alias("other_id"))
    clashing = (
        firsts.join(beside, "class").join(others, "other").filter("side_id <> other_side")
        .groupBy("class", "side_id", "other_side").agg(F.min("other_id").alias("other_id"))
    )
    return held.join(clashing, ["class", "side_id"]).select("image_id", "side_id", "other_id", "other_side")


def near_conflict_pairs(manifest: DataFrame, pairs: DataFrame, phash: DataFrame) -> DataFrame:
    """Every near pair (a, b, side_a, side_b) of two identity sides: as large as that listing."""
    sides = manifest.select("image_id", side_id().alias("side_id"))
    listed = expand_near_pairs(pairs, phash.join(sides.select("image_id"), "image_id", "left_semi"))
    named = listed.join(sides.toDF("a", "side_a"), "a").join(sides.toDF("b", "side_b"), "b")
    return named.filter("side_a <> side_b").select("a", "b", "side_a", "side_b")


def expand_near_pairs(pairs: DataFrame, phash: DataFrame) -> DataFrame:
    """All near pairs (a < b, distance) of the images in ``phash``: as large as that listing.

    ``pairs`` may come from more images than ``phash`` holds.
    """
    pairs = _measured(pairs)
    classes = hash_classes(pairs)
    members = phash.select("image_id").join(classes, "image_id")
    left, right = members.toDF("a", "class"), members.toDF("b", "class")
    copies = left.join(right, "class").filter("a < b").select("a", "b", F.lit(0).alias("distance"))
    across = (
        pairs.filter("distance > 0").toDF("class", "other", "distance")
        .join(members.toDF("left_id", "class"), "class")
        .join(members.toDF("right_id", "other"), "other")
    )
    return copies.unionByName(across.select(
        F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "distance"
    ))


def session_links(manifest: DataFrame) -> DataFrame:
    """Star links inside one identity's session."""
    session = F.coalesce("capture_session_id", F.lit("")).alias("session")
    rows = manifest.select("image_id", side_id().alias("side_id"), session)
    return _star(rows, ["side_id", "session"])


def frame_links(manifest: DataFrame, within_side: bool = False) -> DataFrame:
    """Star links between images cut from one source frame of a dataset, or of each identity side."""
    frame = F.col("attributes")["source_frame"]
    rows = manifest.filter(frame != "").select(
        "image_id", "dataset_id", frame.alias("frame"), side_id().alias("side_id")
    )
    return _star(rows, ["dataset_id", "frame", *(["side_id"] if within_side else [])])


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    several = F.col("_members") > 1
    facts = [F.min("image_id").alias("a"), F.count(F.lit(1)).alias("_members")]
    return (
        with_group_facts(rows, keys, facts, having=several)
        .filter(F.col("image_id") != F.col("a"))
        .select("a", F.col("image_id").alias("b"))
    )


def _buckets(manifest: DataFrame, seconds: float) -> tuple[DataFrame, int]:
    width = int(seconds * 1_000_000)
    stamp = F.col("capture_timestamp_if_known")
    rows = manifest.select(
        "image_id",
        side_id().alias("side_id"),
        is_aware(stamp).alias("aware"),
        F.unix_micros(known_instant(stamp)).alias("us"),
    ).filter(F.col("us").isNotNull())
    return rows.withColumn("bucket", F.floor(F.col("us") / F.lit(width))), width


def burst_pairs(manifest: DataFrame, seconds: float) -> DataFrame:
    """Links that connect exactly the images a pairwise "within N seconds" rule would connect.

    Time is cut into buckets N seconds wide per identity. Inside a bucket everything is within N,
    so a star will do; two buckets can only meet if they are neighbours, and then the last image
    of one and the first of the next are the closest. Both steps are plain aggregates: no identity
    is ever sorted in one task. Naive and aware stamps are never compared.
    """
    if seconds <= 0:
        return manifest.limit(0).select(F.col("image_id").alias("a"), F.col("image_id").alias("b"))
    rows, width = _buckets(manifest, seconds)
    rows = durable(rows)  # parsed once, then read by both aggregates
    keys = ["side_id", "aware", "bucket"]
    edges = rows.groupBy(*keys).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("image_id").alias("rep")
    )
    later = edges.select(
        "side_id",
        "aware",
        (F.col("bucket") - 1).alias("bucket"),
        F.col("first_us").alias("next_us"),
        F.col("rep").alias("next_rep"),
    )
    bridges = (
        edges.join(later, keys)
        .filter(F.col("next_us") - F.col("last_us") <= width)
        .select(F.least("rep", "next_rep").alias("a"), F.greatest("rep", "next_rep").alias("b"))
    )
    return _star(rows, keys).unionByName(bridges)


def label_conflicts(manifest: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b, reason) whose ends carry different identities; unknown ids are ignored."""
    sides = manifest.select("image_id", side_id().alias("side_id"))
    held = durable(links)
    named = lookup(held, "a", sides.toDF("a", "side_a"))
    named = named.join(sides.toDF("b", "side_b"), "b")
    return named.filter(F.col("side_a") != F.col("side_b")).select(
        "a", "b", "reason", "side_a", "side_b"
    )


def conflicts(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, reason, side_a, side_b): shared frames and near duplicates across identity sides.

    Frames are a star per frame; near duplicates one row per conflicting image and other side.
    """
    frames = label_conflicts(manifest, frame_links(manifest).withColumn("reason", F.lit("source frame")))
    near = near_conflicts(manifest, pairs)
    return frames.unionByName(near.select(
        F.least("image_id", "other_id").alias("a"), F.greatest("image_id", "other_id").alias("b"),
        F.lit("near duplicate").alias("reason"),
        F.when(F.col("image_id") < F.col("other_id"), F.col("side_id")).otherwise(F.col("other_side")).alias("side_a"),
        F.when(F.col("image_id") < F.col("other_id"), F.col("other_side")).otherwise(F.col("side_id")).alias("side_b"),
    ).distinct())


def link_union(*links: DataFrame) -> DataFrame:
    out = links[0].select("a", "b")
    for other in links[1:]:
        out = out.unionByName(other.select("a", "b"))
    return out.distinct()
