import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import maxscore

DDL = "vec_id bigint, embedding array<double>, label int, place int, shard string, score int"


def brute(rows, k):
    good = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(1024 * x) for x in v] for _, v in good]
    out = []
    for a, (i, _) in enumerate(good):
        if i is None or i % 100:
            continue
        found = []
        for b, (j, _) in enumerate(good):
            if a != b:
                score = sum(x * y for x, y in zip(whole[a], whole[b]))
                found.append((-max(-(2**63), min(2**63 - 1, score)), j is None, j or 0))
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(sorted(found)[:k])]
    return out


def vectors(n, width, seed, odd=True):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, width)) * np.linspace(0.02, 0.3, width)
    rows = []
    for i in range(n):
        v = (centres[i % 7] + 0.02 * rng.standard_normal(width)).tolist()
        if odd and i % 9 == 0:
            v = centres[0].tolist()  # many equal vectors: ties
        rows.append((i * 5 if i % 2 else i, v, 1, 2, "s", 3))
    if odd:
        extra = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [math.nan] * width, [math.inf] * width, [0.5], [-1.0] * (width + 3)]
        rows += [(100 * i if i % 2 else None, v, 1, 2, "s", 3) for i, v in enumerate(extra)]
        rows += [rows[0], rows[20], (300, rows[20][1], 1, 2, "s", 3)]
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


@pytest.mark.parametrize(("shard", "cell", "k"), [(4096, 16384, 10), (16, 3, 4), (7, 1000, 1)])
def test_equal_to_all_products(spark, monkeypatch, shard, cell, k):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "CELL_QUERIES", cell)
    rows = vectors(420, 24, 1)
    got = maxscore.top_k(spark.createDataFrame(rows, DDL).repartition(6), F.col("vec_id") % 100 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert order(got.collect()) == order(brute(rows, k))


def test_bounds_rule_out_most_rows(spark, monkeypatch):
    """Of alike shards, few are searched, and nothing is lost."""
    rows = [r for r in vectors(2000, 32, 2, odd=False)]
    seen = []
    plain = maxscore.Shard.search
    monkeypatch.setattr(maxscore.Shard, "search", lambda self, *a: (seen.append(len(self.ids)), plain(self, *a)))
    packed = [{"weights": maxscore._dense([np.floor(1024 * np.array(v)).tobytes() for _, v, *_ in part]).tobytes(), "ids": [i for i, *_ in part],
               "width": 32, "places": [n * 100]} for n, part in enumerate([[r for r in rows if r[0] % 7 == m][:100] for m in range(7)])]
    query = np.frombuffer(packed[3]["weights"]).reshape(-1, 32)[0]
    best = maxscore.Best(5, -math.inf)
    for row in [packed[3], *packed[:3], *packed[4:]]:
        shard = maxscore.Shard(row)
        bounds = np.maximum(query * shard.most, query * shard.least)
        if not bounds.sum() < best.floor:
            shard.search(query, -1, bounds, best)
    everything = np.concatenate([np.frombuffer(r["weights"]).reshape(-1, 32) @ query for r in packed])
    assert best.scores.tolist() == sorted(everything.tolist(), reverse=True)[:5]


def test_large_components_few_rows_and_empty(spark):
    rows = [(0, [1e16, -3.0], 1, 2, "s", 3), (100, [1e12, 5.5], 1, 2, "s", 3), (7, [1e30, 1.0], 1, 2, "s", 3), (8, [2.0**-11, 1e9], 1, 2, "s", 3)]
    df = spark.createDataFrame(rows, DDL)
    assert order(maxscore.top_k(df, F.col("vec_id") % 100 == 0).collect()) == order(brute(rows, 10))
    assert maxscore.top_k(df.limit(0), F.lit(True)).collect() == []
    assert maxscore.top_k(df.limit(1), F.lit(True)).collect() == []
