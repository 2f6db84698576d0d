import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from support import image, manifest_of, rows
from pyspark.sql import functions as F

from spoorline.operators import digest, images, similarity
from spoorline.plans.evaluate import ingest
from spoorline.sources import files as src
from spoorline.sources import sinks


def png(pixels):
    """A grayscale PNG file of a uint8 array."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    h, w = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(0)
    noisy = rng.integers(0, 256, (120, 160), dtype=np.uint8)
    (root / "noisy.png").write_bytes(png(noisy))
    (root / "dark.png").write_bytes(png(np.full((100, 100), 9, dtype=np.uint8)))
    (root / "small.PNG").write_bytes(png(noisy[:40, :50]))
    (root / "copy.png").write_bytes(png(noisy))
    (root / "cut.png").write_bytes(png(noisy)[:60])
    (root / "note.txt").write_text("no photo")
    return root, noisy


def name(c="image_id"):
    return F.element_at(F.split(c, "/"), -1)


def test_image_table_quality_and_hash(spark, photos):
    root, noisy = photos
    table = images.image_table(spark, str(root)).withColumn("image_id", name())
    got = {r["image_id"]: r for r in images.raster_quality(table).collect()}
    assert got["noisy.png"]["recommendation"] == "ACCEPT"
    assert got["noisy.png"]["mean_intensity"] == pytest.approx(noisy.mean())
    wide = np.pad(noisy.astype(float), 1, mode="reflect")
    lap = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4.0 * noisy
    assert got["noisy.png"]["sharpness"] == pytest.approx(lap.var())
    assert got["dark.png"]["reasons"] == ["blur", "underexposed"]
    assert got["dark.png"]["recommendation"] == "RETRY PHOTO"
    assert got["small.PNG"]["recommendation"] == "INSUFFICIENT HEAD VIEW"
    hashes = dict(rows(images.dhash_table(table)))
    assert hashes["noisy.png"] == hashes["copy.png"] != hashes["small.PNG"]
    assert hashes["dark.png"] == 0
    bounded = images.image_table(spark, str(root), max_side=80).withColumn("image_id", name())
    assert {(r["width"], r["height"]) for r in bounded.collect() if r["image_id"] == "noisy.png"} == {
        (80, 60)
    }


def test_box_resize_keeps_the_mean():
    a = np.random.default_rng(1).integers(0, 256, (90, 70), dtype=np.uint8)
    assert images.box_resize(a, 8, 9).mean() == pytest.approx(a.mean(), abs=0.6)
    assert (images.box_resize(a, 90, 70) == a).all()


def test_media_inspect_refuses_broken_files(spark, photos):
    root, _ = photos
    found = spark.read.format("binaryFile").load(str(root))
    decoded = images.image_table(spark, str(root)).select(F.col("image_id").alias("path"))
    norm = F.regexp_replace("path", "^file:/+", "/")
    got = images.media_inspect(
        found.withColumn("path", norm), decoded.withColumn("path", norm)
    ).withColumn("path", name("path"))
    assert dict(rows(got, "path", "verdict")) == {
        "noisy.png": "ok", "dark.png": "ok", "small.PNG": "ok", "copy.png": "ok",
        "cut.png": "invalid_image", "note.txt": "invalid_image",
    }


def test_head_crop(spark):
    cells = spark.createDataFrame([("a", list(range(64))), ("b", list(range(64)))],
                                  "image_id string, px array<int>")
    rasters = cells.select(*images.raster_from_grid("image_id", "px", 8, 8))
    boxes = manifest_of(spark, [image("a", attributes={"head_bbox": "1,2,4,4"}), image("b")])
    crops, problems = images.head_crop(rasters, boxes)
    row = crops.first()
    assert (row["width"], row["height"], list(row["px"])) == (3, 2, [17, 18, 19, 25, 26, 27])
    assert rows(problems, "entity_id", "code") == [("b", "missing_box")]


def test_manifest_round_trip_and_refusals(spark, tmp_path):
    made = manifest_of(spark, [
        image("b", notes='two\nlines, "quoted"', attributes={"light": "sun"}),
        image("a", stamp="2026-01-01T10:00:00"),
    ])
    path = str(tmp_path / "m")
    sinks.write_manifest(made, path)
    back = src.read_manifest(spark, path)
    assert [r["image_id"] for r in back.collect()] == ["a", "b"]
    notes = dict(rows(back, "image_id", "notes"))
    assert notes["b"] == 'two\nlines, "quoted"'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_manifest(made, path)
    bad = str(tmp_path / "bad")
    sinks.write_manifest(manifest_of(spark, [image("a", side="up")]), bad)
    with pytest.raises(src.RefusedError, match="side must be"):
        src.read_manifest(spark, bad)
    twice = str(tmp_path / "twice")
    sinks.write_manifest(manifest_of(spark, [image("a"), image("a")]), twice)
    with pytest.raises(src.RefusedError, match="occurs 2 times"):
        src.read_manifest(spark, twice)


def test_digest_ignores_order_and_sees_changes(spark):
    one = manifest_of(spark, [image("a"), image("b")])
    two = manifest_of(spark, [image("b"), image("a")])
    three = manifest_of(spark, [image("a"), image("b", notes="x")])
    digests = [digest.manifest_hash(m).first()["digest"] for m in (one, two, three)]
    assert digests[0] == digests[1] != digests[2]
    wide = spark.range(9000).select(F.col("id").cast("string").alias("t"))
    first = digest.content_hash(wide, F.col("t")).first()
    again = digest.content_hash(wide.repartition(5), F.col("t")).first()
    assert first == again and first["n"] == 9000


def test_sidecar_logs_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"hashes": {"a": "ffffffffffffffff", "b": "0f"}}, indent=1))
    assert rows(src.read_phash(spark, str(tmp_path / "p.json"))) == [("a", -1), ("b", 15)]
    assert src.read_seal_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "log.jsonl").write_text('{"split_sha256": "s", "config_sha256": "c"}\n\n')
    assert src.read_seal_log(spark, str(tmp_path / "log.jsonl")).count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"dataset_id": "d", "tier": "B", "proxy": False}, indent=1))
    assert src.read_provenance(spark, str(tmp_path / "d.json")).first()["tier"] == "B"


def test_ingest_flow_and_store(spark, photos, tmp_path):
    root, _ = photos
    found = src.read_files(spark, str(root), content=True)
    assert found.filter("relative_path = 'note.txt'").count() == 0
    labels = spark.createDataFrame(
        [(n, "x1", "left", "s1", "", "", {"light": "sun"}) for n in ("noisy.png", "copy.png", "dark.png")],
        "relative_path string, individual_label string, side string, capture_session_id string, "
        "capture_timestamp_if_known string, notes string, attributes map<string,string>",
    )
    record = spark.createDataFrame(
        [("herps", "made", "none", "CC0")],
        "dataset_id string, source string, source_reference string, license_or_permission string",
    )
    sized = found.select("relative_path", "file_sha256", F.lit(9).alias("width"), F.lit(9).alias("height"))
    manifest, dropped = ingest(labels, sized, record)
    assert manifest.count() == 2 and rows(dropped) == [("copy.png", "noisy.png")]
    store = str(tmp_path / "store")
    sinks.write_store(found.withColumn("dataset_id", F.lit("herps")), store)
    held = spark.read.parquet(store)
    once = held.count()
    sinks.write_store(found.withColumn("dataset_id", F.lit("herps")), store)
    held = spark.read.parquet(store)
    assert held.count() == once
    forged = found.withColumns({"dataset_id": F.lit("herps"), "content": F.lit(b"other")})
    with pytest.raises(ValueError, match="does not match"):
        sinks.write_store(forged, store)
    named = rows(src.read_files(spark, f"file://{root}"), "relative_path")
    assert named == rows(found, "relative_path")
    assert sinks.store_collisions(held).count() == 0
    assert {r["status"] for r in sinks.verify_store(manifest, held).collect()} == {"ok"}
    with pytest.raises(src.RefusedError, match="file not found"):
        ingest(labels.withColumn("relative_path", F.lit("gone.png")), sized, record)


def vectors(spark, n, d, seed, prefix):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v, [f"{prefix}{i:03d}" for i in range(n)]


def test_block_ranks_equal_dense_ranks(spark):
    """One identity holds a third of the gallery and crosses several blocks; scores also tie."""
    g, g_ids = vectors(spark, 90, 6, 0, "g")
    sides = ["big" if i % 3 == 0 else f"s{i % 13:02d}" for i in range(90)]
    g[5] = g[7]
    q, q_ids = vectors(spark, 25, 6, 1, "q")
    q[3] = g[5]
    truth = [None if i % 5 == 4 else sides[i * 3 % 90] for i in range(25)]
    gallery = spark.createDataFrame(
        [(a, s, v.tolist()) for a, s, v in zip(g_ids, sides, g, strict=True)],
        "gallery_id string, side_id string, vector array<double>",
    )
    queries = spark.createDataFrame(
        [(a, v.tolist(), t) for a, v, t in zip(q_ids, q, truth, strict=True)],
        "query_id string, vector array<double>, truth string",
    )
    scores = q @ g.T
    names = sorted(set(sides))
    best = np.array([[max(scores[i, j] for j in range(90) if sides[j] == s) for s in names] for i in range(25)])
    for size in (7, 1000):
        got = {r["query_id"]: r for r in
               similarity.true_rank_blocks(queries, gallery, block_rows=size).collect()}
        for i, query in enumerate(q_ids):
            assert got[query]["best"] == pytest.approx(best[i].max())
            if truth[i] is None:
                assert got[query]["rank"] is None
                continue
            own = best[i][names.index(truth[i])]
            want = 1 + sum(
                b > own or (b == own and s < truth[i]) for s, b in zip(names, best[i], strict=True)
                if s != truth[i]
            )
            assert got[query]["rank"] == want
    dense = similarity.similarity_join(queries, gallery, block_rows=8)
    assert dense.count() == 25 * 90
    maxed = similarity.best_per_identity_blocks(queries, gallery, block_rows=8)
    assert maxed.count() == 25 * len(names)


def test_descriptor_matches_and_homography(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 100, (12, 2))
    descriptors = rng.normal(size=(12, 16))
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [0.0005, 0.0002, 1]])
    moved = np.hstack([points, np.ones((12, 1))]) @ h.T
    moved = moved[:, :2] / moved[:, 2:]
    moved[10:] += 60  # two matches off the plane

    def table(column, image_id, xy):
        data = [(image_id, k, float(p[0]), float(p[1]), d.tolist())
                for k, (p, d) in enumerate(zip(xy, descriptors, strict=True))]
        return spark.createDataFrame(
            data, f"{column} string, kp_id int, x double, y double, descriptor array<double>"
        )

    q = table("query_id", "q", points)
    g = table("gallery_id", "g", moved).unionByName(table("gallery_id", "lone", moved).limit(1))
    assert rows(similarity.descriptor_ratio_match(q, g)) == [("q", "g", 12), ("q", "lone", 0)]
    inliers = similarity.ransac_inliers(similarity.descriptor_matches(q, g), threshold=2.0)
    assert rows(inliers) == [("q", "g", 10)]


def test_registered_inliers_read_every_query_and_gallery_image(spark, tmp_path):
    from spoorline.plans import catalog_scores
    from spoorline.plans.registry import QUERIES

    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 64))
    base[[6, 17, 19]] = base[[0, 13, 15]] + 0.001  # near copies across the two sides
    data = [(i, v.tolist()) for i, v in enumerate(base)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    images = {"q": {}, "g": {}}
    for side, name, condition in (("q", "query_id", "k >= 6"), ("g", "gallery_id", "k < 6")):
        for r in catalog_scores.descriptors(spark, str(tmp_path), name, condition).collect():
            images[side].setdefault(r[name], {})[r.kp_id] = ((r.x, r.y), np.array(r.descriptor))
    assert len(images["q"]) == 8 and len(images["g"]) == 12
    expected = {}
    for q, own in images["q"].items():
        for g, theirs in images["g"].items():
            pairs = []
            for xy, d in own.values():
                near = sorted((float(np.linalg.norm(d - e)), k) for k, (_, e) in theirs.items())
                if near[0][0] < 0.8 * near[1][0]:
                    pairs.append((xy, theirs[near[0][1]][0]))
            if len(pairs) >= 4:
                expected[q, g] = len(pairs)
    out = {(r.query_id, r.gallery_id): r.inliers for r in QUERIES["ransac_inliers"](spark, str(tmp_path)).collect()}
    assert out.keys() == expected.keys() and all(0 <= n <= expected[k] for k, n in out.items())
    copies = {(f"img-{q:010d}", f"img-{g:010d}") for q, g in ((6, 0), (17, 13), (19, 15))}
    assert copies <= out.keys() and all(out[c] == 8 for c in copies)


def test_scorers_give_the_ranks_of_pairwise_scores(spark):
    """Descriptor and homography ranks through blocks equal ranks from every pair scored alone."""
    from spoorline.operators import scorers

    rng = np.random.default_rng(9)
    centre = rng.normal(size=(4, 10, 8))
    points = rng.uniform(0, 100, (4, 10, 2))

    def shot(side, noise):
        keep = rng.permutation(10)[: rng.integers(1, 11)]
        at = points[side][keep] @ (np.eye(2) + rng.normal(scale=0.05, size=(2, 2))) + rng.normal(scale=noise, size=(len(keep), 2))
        return [(float(x), float(y), d.tolist()) for (x, y), d in zip(at, centre[side][keep] + rng.normal(scale=0.01, size=(len(keep), 8)), strict=True)]

    kind = "array<struct<x:double,y:double,descriptor:array<double>>>"
    gallery = [(f"g{i:02d}", f"s{i % 4}", None if i == 11 else shot(i % 4, 0.5)) for i in range(16)]
    queries = [(f"q{i:02d}", None if i == 5 else f"s{i % 4}", shot(i % 4, 0.5)) for i in range(9)]
    g = spark.createDataFrame(gallery, f"gallery_id string, side_id string, keypoints {kind}")
    q = spark.createDataFrame(queries, f"query_id string, truth string, keypoints {kind}")
    for scorer in (scorers.MatchScorer(), scorers.HomographyScorer()):
        ready = lambda p: scorer.prepared(pd.DataFrame({"keypoints": [[dict(zip(("x", "y", "descriptor"), k, strict=True)) for k in p or []]]}))  # noqa: B023, E731
        want = {}
        for name, truth, mine in queries:
            best = {}
            for _, side, theirs in gallery:
                score = scorer.scores(ready(mine), ready(theirs))[0, 0]
                best[side] = max(best.get(side, 0.0), score)
            order = sorted(best, key=lambda s: (-best[s], s))
            want[name] = (order.index(truth) + 1 if truth else None, max(best.values()))
        for size in (3, None):
            ranked = similarity.true_rank_blocks(q, g, size, scorer)
            assert {r.query_id: (r.rank, r.best) for r in ranked.collect()} == want


def test_homography_of_points_without_area_has_no_inlier():
    from spoorline.operators.scorers import homography_inliers

    line = np.array([[float(i), 2.0 * i] for i in range(9)])
    assert homography_inliers(line, line, 1.0, 50) == 0


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """Line breaks at either end or nowhere, byte order marks, no text, many splits; no content is read whole."""
    rng = np.random.default_rng(11)
    root = tmp_path / "long"
    (root / "a b").mkdir(parents=True)
    noise = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    made = {
        "noise.png": noise, "end.png": noise + b"\n", "ends.png": b"\n\n" + noise + b"\r\n\n\n", "breaks.png": b"\n" * 5000,
        "mark.png": b"\xef\xbb\xbf" + noise, "marked.png": b"\xef\xbb\xbf" * 2 + noise + b"\n", "none.png": b"\0" * 70_000,
        "a b/c%20d.png": noise[:50_000] + "é\n".encode("utf-16"), "small.png": b"x", "note.txt": noise,
        "packed.png.gz": noise,
    }
    for name, data in made.items():
        (root / name).write_bytes(data)
    monkeypatch.setattr(src, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(src, "PIECE_BYTES", 700)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = rows(src.read_files(spark, str(root)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    want = {n: d for n, d in made.items() if n.endswith(".png")}
    assert found == sorted((n, hashlib.sha256(d).hexdigest(), len(d)) for n, d in want.items())
    every = rows(src.read_files(spark, str(root), suffixes=[]))
    assert every == sorted((n, hashlib.sha256(d).hexdigest(), len(d)) for n, d in made.items())
