import numpy as np
import pytest

from spoorline.llm.embeddings import VectorParameters, near_vectors


def brute(rows, cosine=0.9):
    width = max((len(v) for _, v in rows if v), default=0)
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.r_[np.array(v, float), np.zeros(width - len(v))]
    ids = sorted(good)
    out = {i: [0, i] for i, _ in rows}
    if ids:
        x = np.array([good[i] for i in ids])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        label = np.array(ids)
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
            if (new == label).all():
                break
            label = new
        for k, i in enumerate(ids):
            out[i] = [int(linked[k].sum()), int(label[k])]
    return {i: tuple(v) for i, v in out.items()}


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def planted(count, width, seed):
    """Unit vectors, every fourth followed by a partner at a cosine between 0.9 and 1."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < count:
        x = rng.normal(size=width)
        x /= np.linalg.norm(x)
        rows.append(x)
        if len(rows) % 4 == 0:
            z = rng.normal(size=width)
            z -= (z @ x) * x
            c = rng.uniform(0.9, 1)
            rows.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    return [(i, [float(v) for v in x]) for i, x in enumerate(rows)]


@pytest.mark.parametrize("p", [VectorParameters(per_list=64), VectorParameters(per_list=24, tile=8, block=32, most_fitted=300)])
def test_recall_and_no_false_link(spark, p):
    rows = planted(1200, 64, 1)
    expected = brute(rows)
    found = result(near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), p))
    assert all(found[i][0] <= n for i, (n, _) in expected.items())
    total = sum(n for n, _ in expected.values())
    assert total > 400 and sum(n for n, _ in found.values()) >= 0.98 * total


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    copies = [(10_000 + i, [x * 1.5 + (k == 3) * 0.01 for k, x in enumerate(v)]) for i, v in rows[:200]]
    both = vectors.select("vec_id", "embedding").union(
        spark.createDataFrame(copies, "vec_id bigint, embedding array<float>")
    )
    rows = [(r.vec_id, r.embedding) for r in both.collect()]
    assert result(near_vectors(both)) == brute(rows)


def test_unusable_equal_and_dense_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1e-30, 0.0]), (7, [1e30, 0.0]), (8, [-0.0, 2.0]), (9, [0.0, 2.0]), (10, [1.0]), (11, [-1.0, 0.0])]
    rows += [(100 + i, [5.0, 5.0, float(i % 2)]) for i in range(30)]
    rows += [(200 + i, list(map(float, rng.normal(0, 1, 3)))) for i in range(80)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, key string")
    assert result(near_vectors(df, VectorParameters(per_list=8, tile=8, block=16))) == brute(rows)
    assert near_vectors(df.limit(0)).collect() == []
    assert result(near_vectors(df.filter("vec_id < 3"))) == {i: (0, i) for i in range(3)}


@pytest.mark.parametrize("ids", [[1, 1, 2, 3, None, None, 7, 5, 6], [None] * 9, [4] * 9])
def test_null_and_repeated_ids_are_rows_of_their_own(spark, ids):
    """Links follow the rows; a group is named by its smallest id."""
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    vectors = [x, y, [1.0, 0.01, 0.1], [0.01, 1.0, 0.1], x, y, [0.0, 0.0, 1.0], None, [0.0, 0.0, 1.0]]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id bigint, embedding array<double>")
    groups = [[0, 2, 4], [1, 3, 5], [6, 8], [7]]
    expected = []
    for rows in groups:
        names = [ids[i] for i in rows if ids[i] is not None]
        name = min(names, default=None)
        expected += [(ids[i], len(rows) - 1, name, ids[i] == name) for i in rows]
    key = lambda r: [(v is None, v or 0) for v in r]
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=key) == sorted(expected, key=key)
