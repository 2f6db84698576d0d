import re
from collections import Counter, defaultdict

import numpy as np

from spoorline.llm.near import NearParameters, least_matches, near_duplicates
from spoorline.llm.store import components
from tests_llm_support import fold



def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """doc_id -> (set size, smallest reachable doc_id), by exhaustive comparison."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for other, n in Counter(o for x in s for o in holders[x] if o > d).items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())
    return out


def test_whole_table_against_exhaustive_comparison(spark, small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    assert result(near_duplicates(small_documents)) == brute(rows)


def test_nulls_empties_repeats_and_clashing_columns(cluttered):
    rows = [(r.doc_id, r.text) for r in cluttered.collect()]
    assert result(near_duplicates(cluttered)) == brute(rows)


def test_empty_table(cluttered):
    assert near_duplicates(cluttered.limit(0)).collect() == []


def test_dense_group_with_strays_crosses_tiles(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[k] = f"n{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df, NearParameters(tile=16))) == brute(rows)


def test_pruning_keeps_the_threshold_and_drops_the_unlike():
    p = NearParameters()
    least = least_matches(p)
    assert least[-1] / 250 < 0.75 and least[-1] / 250 > 0.5
    assert all(b > a for a, b in zip(least, least[1:], strict=False))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}
