import random
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spoorline.llm.tokenfiles import (
    MODEL, FileParameters, IdEncoder, Remembered, added_tokens, packed, pretoken_starts, read_ids, stored_ids, unpacked,
    write_ids,
)


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(MODEL)
    own.encode_special_tokens = True
    return own


def encode_all(encoder, texts):
    bodies = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ids, ends = encoder.encode(data, np.r_[0, np.cumsum([len(b) for b in bodies])])
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_ids_like_the_library_on_hard_texts(library):
    rng = random.Random(8)
    bits = ["'", "''", "'s", "'re", "'ve", "'ll", "'LL", "don't", " ", "  ", "\n", "\t ", " ", "　", "é", "日本",
            "12", "½", "a", "B", "!", "...", "<|endoftext|>", "𝄞", "́", "_", "-", "r", "e", "\r\n", "\x00", "​", "\x1c", "\x85"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "x" * 3000, " " * 500]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for remembered in (10, 1 << 20):
        encoder = IdEncoder(MODEL, remembered)
        assert encode_all(encoder, texts) == expected
        assert encode_all(encoder, texts) == expected


def expected_rows(library, rows):
    out, start = {}, 0
    for doc, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def result(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_whole_table(spark, library, small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    expected = expected_rows(library, rows)
    assert result(stored_ids(spark, small_documents)) == expected
    many = FileParameters(block=64, file_ids=5000)
    assert result(stored_ids(spark, small_documents, p=many)) == expected


def test_odd_rows(spark, library, cluttered):
    rows = [(r.doc_id, r.text) for r in cluttered.collect()]
    assert result(stored_ids(spark, cluttered)) == expected_rows(library, rows)
    assert stored_ids(spark, cluttered.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id bigint, text string")
    out = sorted((r.start, r.doc_id, r.n_tokens) for r in stored_ids(spark, twice).collect())
    assert [o[1:] for o in out] == [(None, 2), (1, 2), (1, 2)] and [o[0] for o in out] == [0, 2, 4]


@pytest.mark.parametrize("ids", [
    [7], [5] * 3000, list(range(3000)), [1, 2, 3] * 1000, [50256, 0] * 700,
    np.random.default_rng(1).integers(0, 50257, 5000).tolist(), (np.random.default_rng(2).zipf(1.2, 9000) % 50257).tolist(),
])
def test_coder_round_trip(ids):
    body = packed([1, None], np.array([0, len(ids)]), np.array(ids, np.uint16), 256)
    names, counts, back = unpacked(body)
    assert names == [1, None] and counts.tolist() == [0, len(ids)] and back.tolist() == ids
    if len(set(ids)) < 10 and len(ids) > 100:
        assert len(body) < len(ids)


def test_damage_is_found():
    ids = (np.random.default_rng(3).zipf(1.3, 4000) % 50000).astype(np.uint16)
    body = bytearray(packed([4], np.array([4000]), ids, 256))
    for at in (0, 300, len(body) // 2, len(body) - 40):
        bad = bytearray(body)
        bad[at] ^= 0x41
        with pytest.raises(Exception):  # noqa: B017  (a damaged header may fail in its parser)
            unpacked(bytes(bad))


def test_files_are_whole_and_in_order(spark, small_documents, tmp_path):
    target = f"file://{tmp_path}/ids"
    manifest = write_ids(small_documents, target, p=FileParameters(file_ids=20_000))
    files = {r.file for r in manifest.collect()}
    assert files == {f.name for f in (tmp_path / "ids").iterdir()}
    order = []
    for row in sorted(manifest.collect()):
        order += unpacked((tmp_path / "ids" / row.file).read_bytes())[0]
    assert order == sorted(order) and len(order) == small_documents.count()
    assert read_ids(manifest, target).count() == len(order)


def test_added_tokens_have_their_own_ids(spark):
    loaded = Tokenizer.from_file(MODEL)
    rng = random.Random(9)
    end = "<|endoftext|>"
    bits = [end, end, "<|endo", "ftext|>", "<|", "|>", " ", "  ", "\n", "a", "'", "s", "'s", "12", "é", "日本", "!", "endoftext"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(2000)]
    texts += [f"a{end}b", end, 3 * end, f" {end} ", "a<|endo", "ftext|>b", "", f"it{end}'s"]
    expected = [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]
    for remembered in (10, 1 << 20):
        own = IdEncoder(MODEL, remembered, added_tokens(MODEL))
        assert encode_all(own, texts) == expected
        assert encode_all(own, texts) == expected
    rows = list(enumerate([*texts[:20], f"a{end}b", None, "after"]))
    out = result(stored_ids(spark, spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert out == expected_rows(loaded, rows) and out[20][1] == 4


def test_known_words_cost_little_more_than_finding_them():
    rng = np.random.default_rng(11)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (30_000, 6))]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 100_000)).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    encoder = IdEncoder(MODEL, 1 << 20)
    first = encoder.encode(data, bounds)[0]

    def least(work):
        times = []
        for _ in range(9):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    finding, whole = least(lambda: pretoken_starts(points, bounds)), least(lambda: encoder.encode(data, bounds))
    assert (encoder.encode(data, bounds)[0] == first).all()
    assert whole < 5 * finding


def test_hashes_that_meet_in_one_place():
    known = Remembered(1000)
    hashes = (np.arange(700, dtype=np.uint64) << np.uint64(40)) + np.uint64(known.mask)
    assert (known.find(hashes) == -1).all()
    known.add(hashes[:300])
    known.add(hashes[300:600])
    assert known.find(hashes).tolist() == [*range(600), *[-1] * 100]
    assert known.find(hashes[::-1])[100:].tolist() == list(range(599, -1, -1))


@pytest.mark.parametrize("block,crc", [(64, 1626030804), (512, 929059597)])
def test_bytes_of_a_file_stay(block, crc):
    ids = (np.random.default_rng(5).zipf(1.1, 30_000) % 50257).astype(np.uint16)
    ids[10_000:12_000] = 7
    body = packed([3, None], np.array([29_000, 1000]), ids, block)
    assert zlib.crc32(body[-20_000:]) == crc  # coded words only
    assert (unpacked(body)[2] == ids).all()
