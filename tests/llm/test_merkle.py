import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spoorline.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos int, tree string, node string, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = [None if row[c] is None else str(row[c]) for c in COLUMNS]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def tree(nodes):
    """(root, for each node the pairs of left and right siblings upwards)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 2
            paths[i].append((nodes[run] if k % 2 else "", nodes[k + 1] if k % 2 == 0 and k + 1 < len(nodes) else ""))
            at[i] = k // 2
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def fold(node, path):
    for left, right in path:
        node = sha(left + node + right)
    return node


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    found = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        found.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([subroot for _, subroot, _ in found])
    out = []
    for (own, subroot, paths), above in zip(found, upper, strict=True):
        for r, below in zip(own, paths, strict=True):
            node, path = leaf(r), below + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            bad = leaf({**r, "n_chars": r["n_chars"] + 1}) if hit and r["n_chars"] is not None else node
            folded = fold(bad, path)
            assert (folded == root) == (bad == node)
            out.append((r["doc_id"], node, subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def documents(n):
    rows = []
    for i in range(n):
        lang = None if i % 11 == 0 else ["en", "de", "ü", "", "zz"][0 if i % 3 else i % 5]
        row = (
            None if i % 13 == 0 else i // 2 if i % 17 == 0 else i, None if i % 7 == 3 else f"tèxt {i % 40}", lang,
            None if i % 5 == 0 else "s", None if i % 6 == 0 else i * 3, i, "x", "y", 9,
        )
        rows += [row] * (2 if i % 19 == 0 else 1)
    return rows


@pytest.mark.parametrize(("rise", "n"), [(2, 230), (8, 40), (1, 17), (2, 1), (2, 16), (3, 0)])
def test_equal_to_plain_trees(spark, monkeypatch, rise, n):
    monkeypatch.setattr(merkle, "RISE", rise)
    monkeypatch.setattr(merkle, "SPAN", 1 << rise)
    df = spark.createDataFrame(documents(n), DDL)
    expected = brute([r.asDict() for r in df.collect()]) if n else []
    got = merkle.audited(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_one_group_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RISE", 2)
    monkeypatch.setattr(merkle, "SPAN", 4)
    df = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.lit(2**63 - 1).alias("n_chars"),
    )
    assert len({r.root for r in merkle.manifest(df).select("root").collect()}) == 1
    assert sorted(map(tuple, merkle.audited(df).collect())) == sorted(brute([r.asDict() for r in df.collect()]))
