import hashlib
import re

import numpy as np

from spoorline.llm.contamination import FmIndex, contamination, decontaminated
from tests_llm_support import fold


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def brute(docs, items):
    table = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            table.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in table}
    out = {}
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := table.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out[doc] = (
            len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w),
        )
    return out


def result(df):
    return {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()
    }


def pairs(df, key):
    return [(r[key], r.text) for r in df.collect()]


def test_whole_table_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = brute(pairs(docs, "doc_id"), pairs(bench, "item_id"))
    assert sum(e[4] for e in expected.values()) > 3
    assert result(contamination(docs, bench)) == expected
    assert result(contamination(docs, bench, block_rows=200)) == expected


def test_short_equal_null_and_overlapping_items(spark, cluttered):
    bench = spark.createDataFrame(
        [(1, "ONE"), (2, "one"), (3, None), (4, "..."), (10, "odd text"), (11, "Çà"), (12, "w1x1 w2x2 w3x3"),
         (13, " ".join(f"w{i}x{i % 13}" for i in range(5, 40))), (None, "one"), (10, "odd text"), (14, "a b c d e")],
        "item_id bigint, text string",
    )
    expected = brute(
        pairs(cluttered, "doc_id"), [("" if i is None else i, t) for i, t in pairs(bench, "item_id")]
    )
    assert result(contamination(cluttered, bench)) == expected
    assert result(contamination(cluttered, bench, block_rows=3)) == expected
    assert contamination(cluttered.limit(0), bench).collect() == []
    assert {r.n_hit for r in contamination(cluttered, bench.limit(0)).collect()} == {0}


def test_cutting_removes_every_hit_and_nothing_else(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    flags = result(contamination(docs, bench))
    clean = decontaminated(docs, bench)
    assert clean.columns == docs.columns
    after = {r.doc_id: r for r in clean.collect()}
    assert after.keys() == before.keys()
    for doc, row in after.items():
        if flags[doc][4]:
            assert len(words_of(row.text)) == flags[doc][0] - flags[doc][1]
            assert row.n_chars == len(row.text)
        else:
            assert row == before[doc]
    assert not any(f[4] for f in result(contamination(clean, bench)).values())


def test_index_counts_and_locates():
    rng = np.random.default_rng(5)
    runs = [rng.integers(1, 4, n) for n in (1, 40, 40, 7)] + [np.tile([1, 2], 30)] * 2
    text = np.concatenate([np.r_[r, 0] for r in runs])
    index = FmIndex(text, 5, sample=4)
    for n in (1, 2, 5):
        found = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)} | {(5,) * n}
        found = [f for f in found if 0 not in f]
        low, high = index.search(np.array(found), np.full(len(found), n))
        for phrase, a, b in zip(found, low, high, strict=True):
            places = [i for i in range(len(text) - n + 1) if tuple(text[i : i + n]) == phrase]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == places


def test_items_without_an_id_are_one_item(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha beta delta epsilon")], "doc_id bigint, text string")
    bench = spark.createDataFrame(
        [(None, "alpha beta gamma"), (None, "delta"), (5, "beta"), (6, None)], "item_id bigint, text string"
    )
    digest = hashlib.sha256(b",5").hexdigest()
    for size in (200_000, 1):
        rows = contamination(docs, bench, block_rows=size).collect()
        assert sorted(map(tuple, rows)) == [(1, 3, 3, 2, digest, True), (2, 4, 2, 2, digest, True)]
