import random
import zlib

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from spoorline.llm.pieces import MARK, MODEL, codec, decoded, encoded

pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")


@pytest.fixture(scope="module")
def library():
    """The library over the same pieces and scores, segmenting by best score."""
    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def by_table(own, chunk):
    """Best score of a chunk from all pairs of positions."""
    scores = {own.bytes[i].decode(): s for _, s, i in own.automaton.values()}
    best = [0.0] + [float("-inf")] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(end):
            score = scores.get(chunk[start:end])
            if score is None and end - start == 1:
                score = own.unknown
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_scores_are_best_possible():
    own = codec(MODEL)
    score_of = {i: s for _, s, i in own.automaton.values()}
    rng = random.Random(4)
    for _ in range(150):
        chunk = MARK * rng.randint(0, 3) + "".join(rng.choices("theaingsé日𝄞.,#7'", k=rng.randint(1, 25)))
        ids = own.segment(chunk)
        unknown = sum(own.bytes[i] != b"" and i not in score_of for i in ids)
        total = sum(score_of.get(i, 0) for i in ids)
        chars = len([c for c in chunk if c == "𝄞" and len(own.segment(c)) == 4])
        assert unknown == 4 * chars
        assert total + own.unknown * chars == pytest.approx(by_table(own, chunk))


def test_like_the_best_path_of_the_library(spark, small_documents, library):
    """Its n-best search is exact; its one-best shortcut drops better paths at such score gaps."""
    own = codec(MODEL)
    score_of = {i: s for _, s, i in own.automaton.values()}
    words = sorted({w for r in small_documents.limit(60).collect() for w in r.text.split()})
    for word in words[::3]:
        ids, first = own.encode(word), library.nbest_encode_as_ids(word, 2)[0]
        if ids != first:
            assert sum(map(score_of.get, ids)) == sum(map(score_of.get, first))


def test_whole_table_round_trip(spark, small_documents):
    rows = encoded(small_documents)
    texts = {r.doc_id: r.text for r in small_documents.collect()}
    for r in rows.collect():
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {r.doc_id: r.text for r in decoded(rows).collect()} == texts


def test_odd_rows(spark, cluttered):
    extra = spark.createDataFrame(
        [(100, " lead"), (101, "a  b "), (102, f"raw{MARK}mark"), (103, "日本𝄞\t\r\n"), (104, "é" * 3000)],
        "doc_id bigint, text string",
    )
    docs = cluttered.select("doc_id", "text", "n_chars", "id").unionByName(extra, allowMissingColumns=True)
    rows = {r.doc_id: r for r in encoded(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {d for d, r in rows.items() if not r.round_trip} == {102}
    assert rows[0].ids == [] and rows[1].ids == []
    back = {r.doc_id: r.text for r in decoded(encoded(docs)).collect()}
    assert back == texts | {102: "raw mark"}
    assert encoded(docs.limit(0)).collect() == []
