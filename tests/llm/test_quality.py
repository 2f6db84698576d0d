import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from spoorline.llm import quality
from spoorline.llm.quality import QualityParameters, index_vectors, judged, tokens, train, word_sums, word_vectors
from spoorline.session import shared_dir

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy_and_fold(spark, tables):
    docs, labels = tables
    out = judged(docs, train(docs, labels))
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    truth = [(rows[x.doc_id], x.quality) for x in labels.collect() if x.doc_id in rows]
    held = [(r, q) for r, q in truth if r.held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    good = [r.score for r, q in held if q == 1]
    bad = [r.score for r, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def contexts(texts, p):
    """The sum of the index vectors of the neighbours, and the count, of each word hash."""
    sums, seen = {}, {}
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        found, _ = tokens(data, np.array([0, len(data)]))
        places, signs = index_vectors(found, p)
        for i, w in enumerate(found):
            seen[w] = seen.get(w, 0) + 1
            for j in range(max(0, i - p.reach), min(len(found), i + p.reach + 1)):
                if i != j:
                    np.add.at(sums.setdefault(w, np.zeros(p.width)), places[j], signs[j])
            sums.setdefault(w, np.zeros(p.width))
    return sums, seen


def test_word_sums_and_features_are_those_of_every_word(spark, small_documents):
    p = QualityParameters(width=8, block_bytes=3000)
    rows = [(r.doc_id, r.text) for r in small_documents.collect()] + [(-1, None), (-2, ""), (-3, "Zorb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(5)
    sums, seen = contexts([t for _, t in rows], p)
    for held in (500_000, 40):
        got = {}
        for r in word_sums(docs, replace(p, most_held=held)).collect():
            for word, row in zip(*quality.unpacked(r.body, 9)):
                assert word not in got
                got[word] = row.tolist()
        assert got == {w: [seen[w], *sums[w]] for w in sums}

    mean = sum(sums.values()) / sum(seen.values())
    units = {w: v / seen[w] - mean for w, v in sums.items()}
    units = {w: np.rint(7 * (v / np.abs(v).max())) for w, v in units.items()}
    units = {w: v / np.linalg.norm(v) for w, v in units.items()}
    table = quality.with_features(
        docs, word_vectors(docs, p), p,
        lambda batch, x: pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"]),
        "doc_id bigint, x array<double>",
    )
    found = {r.doc_id: np.array(r.x) for r in table.collect()}
    assert found.keys() == {d for d, _ in rows}
    for d, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words, _ = tokens(data, np.array([0, len(data)]))
        v = np.array([units[w] for w in words]).reshape(-1, p.width)
        n = max(len(v), 1)
        change = np.abs(np.diff(v, axis=0)).sum(axis=0) / n
        spread = np.sqrt(np.maximum((v * v).sum(axis=0) / n - (v.sum(axis=0) / n) ** 2, 0))
        expected = np.concatenate([v.sum(axis=0) / n, spread, change, [np.log1p(len(v))]])
        assert np.allclose(found[d], expected, atol=2e-3)


def test_odd_rows_and_missing_labels(spark, cluttered):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = judged(cluttered, train(cluttered, none)).collect()
    assert len(rows) == cluttered.count() and {r.score for r in rows} == {0.5}
    odd = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(18)] * 2 + [(3, None, None), (None, 1, 0), (999, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = train(cluttered, odd, replace(QualityParameters(), epochs=20))
    rows = {r.doc_id: r.score for r in judged(cluttered, model).collect()}
    assert rows[0] == rows[1] == rows[17] and all(0 <= s <= 1 for s in rows.values())
    kept = quality.accepted(cluttered, model)
    assert kept.columns == cluttered.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, s in rows.items() if s >= 0.3}
    assert judged(cluttered.limit(0), model).collect() == []
    assert judged(cluttered, train(cluttered.limit(0), odd)).count() == 18


def test_temperature_softens_overconfident_logits():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperature(3 * z, y) - 3) < 0.4


def test_texts_travel_as_ranks_of_words_in_less_room(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    texts = [*docs.text, None, "", "Zorb"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    words, places, sizes = quality.worded(batch, "text")
    body = quality.spelled(places, sizes)
    got, n = quality.unspelled(body)
    found = [tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts]
    assert (words[got] == np.concatenate(found)).all() and n.tolist() == [len(f) for f in found]
    assert len(body) < 0.85 * len(zstandard.compress("".join(docs.text.dropna()).encode()))
    for odd in ([None], [""], [" "], ["a"]):
        places, sizes = quality.worded(pa.RecordBatch.from_arrays([pa.array(odd, pa.string())], names=["text"]), "text")[1:]
        assert [v.tolist() for v in quality.unspelled(quality.spelled(places, sizes))] == [places.tolist(), sizes.tolist()]


def test_training_leaves_only_the_table_of_words(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    model = train(docs, labels, QualityParameters(epochs=5))
    assert [f.name.rsplit("-", 1)[0] for f in set(shared.iterdir()) - before] == ["quality-words"]
    assert judged(docs, model).count() == docs.count()
