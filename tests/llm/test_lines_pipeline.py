from collections import Counter, defaultdict

import corpus_pipeline
from test_contamination import brute as contaminated_by_search
from test_near import brute as components_by_comparison

from spoorline.llm import contamination, lines, quality
from spoorline.llm.pieces import MODEL, codec

SF = "/root/testdata/sf0.001"


def lines_brute(rows, ratio=0.1, least=3):
    """doc_id -> (text, lines, dropped) from (doc_id, host, text)."""
    pages = defaultdict(set)
    for _, host, text in rows:
        if text is not None:
            pages[host or ""].add(text)
    flagged = set()
    for host, texts in pages.items():
        held = defaultdict(int)
        for text in texts:
            for line in {x.strip(" ") for x in text.split("\n")}:
                held[line] += 1
        flagged |= {(host, x) for x, n in held.items() if x and n >= least and n > len(texts) * ratio}
    out = {}
    for doc, host, text in rows:
        if text is None:
            out[doc] = (None, 0, 0)
            continue
        parts = text.split("\n")
        stay = [x for x in parts if (host or "", x.strip(" ")) not in flagged]
        out[doc] = ("\n".join(stay), len(parts), len(parts) - len(stay))
    return out


def test_lines_against_brute_force(spark, cluttered):
    hosts = [None, "", "h1", "h2"]
    rows = [(i, hosts[i % 4], f"menu\nbody {i}\n\n menu \nfoot {i % 3}") for i in range(60)]
    rows += [(100 + i, "h1", "same\nold\npage") for i in range(50)]
    rows += [(200, "solo", "menu\nx"), (201, "h1", None), (202, "h1", ""), (203, None, "menu")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()}
    assert found == lines_brute(rows)
    assert found[100] == ("same\nold\npage", 3, 0) and found[200][2] == 0
    odd = [(r.doc_id, r.source, r.text) for r in cluttered.collect()]
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(cluttered).collect()}
    assert found == lines_brute(odd)
    whole = lines.without_boilerplate(cluttered)
    assert whole.columns == cluttered.columns
    assert {r.doc_id: r.text for r in whole.collect()} == {d: t for d, (t, _, _) in found.items()}
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.predicted for r in quality.judged(docs, quality.train(docs, labels)).collect()}
    left = [(r.doc_id, r.source, r.text) for r in docs.collect() if scores[r.doc_id]]
    texts = {d: t for d, (t, _, _) in lines_brute(left).items()}
    roots = components_by_comparison(list(texts.items()))
    texts = {d: t for d, t in texts.items() if roots[d][1] == d}
    flags = contaminated_by_search(list(texts.items()), bench)
    expected = {d: codec(MODEL).encode(t) for d, t in texts.items() if not flags[d][4]}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert found.keys() == texts.keys() and len(found) < docs.count()
    assert all(found[d].ids == ids for d, ids in expected.items())
    assert all(r.round_trip for r in found.values())
    for doc, flag in flags.items():
        if flag[4]:
            assert found[doc].n_tokens < len(codec(MODEL).encode(texts[doc]))


def test_stages_keep_columns_and_survive_odd_and_empty_tables(spark, cluttered):
    for docs in (cluttered, cluttered.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert contamination.decontaminated(cluttered, cluttered.select("doc_id", "text").toDF("item_id", "text")).count() == 18


def test_null_and_repeated_ids_in_every_stage(spark):
    schema = "doc_id bigint, text string, source string, n_chars bigint"
    ids = [None, None, 4, 4, None]

    def run(stage, rows):
        return Counter((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(rows, schema), SF).collect())

    pages = [(ids[i % 5], f"menu\nbody {i}", "h", 0) for i in range(20)] + [(None, "menu\nx", "solo", 0)]
    pages += [pages[0], pages[2]]
    expected = Counter((d, t.removeprefix("menu\n") if h == "h" else t) for d, t, h, _ in pages)
    assert run(corpus_pipeline.line_dedup, pages) == expected
    cut = Counter((r.doc_id, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(pages, schema)).collect())
    assert cut == Counter((d, int(h == "h")) for d, _, h, _ in pages)

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    texts = [(None, a), (9, a), (3, f"{a} z"), (None, b), (None, b), (None, c), (7, d), (7, e), (7, e), (None, None)]
    left = run(corpus_pipeline.near_dedup, [(i, t, "h", 0) for i, t in texts])
    assert left == Counter([(3, f"{a} z"), (None, b), (None, c), (7, d), (7, e), (None, None)])

    passage, other = (" ".join(f"{x}{i}" for i in range(15)) for x in "pq")
    texts = [(None, f"{passage} x"), (None, f"{passage} y {other}"), (5, f"z {passage}"), (5, f"{other} w"), (5, "clean"),
             (None, "clean"), (None, None), (None, f"{passage} x")]
    rows = [(i, t, "h", 0) for i, t in texts]
    bench = spark.createDataFrame([(1, passage), (2, other)], "item_id bigint, text string")
    expected = Counter((i, t and t.replace(passage, "").replace(other, "")) for i, t in texts)
    docs = spark.createDataFrame(rows, schema)
    reports = []
    for size in (1, 2, 200_000):
        out = contamination.decontaminated(docs, bench, block_rows=size)
        assert Counter((r.doc_id, r.text) for r in out.collect()) == expected
        reports.append(Counter(tuple(r) for r in contamination.contamination(docs, bench, block_rows=size).collect()))
    assert reports[0] == reports[1] == reports[2] and sum(reports[0].values()) == len(texts)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(d, t, "h", 0) for t, own in docs.select("text", "doc_id").collect() for d in (own, None)]
    left = run(corpus_pipeline.quality_classifier, rows)
    assert Counter(t for d, t in left.elements() if d is None) == Counter(t for d, t in left.elements() if d is not None)
    coded = corpus_pipeline.tokenisation(spark, spark.createDataFrame(rows, schema), SF)
    assert coded.filter("doc_id is null").count() == docs.count()
