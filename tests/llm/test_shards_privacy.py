import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from spoorline.llm import privacy, shards

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind, m[0]))
    return sorted(out)


def listed(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def terms_of(rows, p):
    """doc_id -> revealing word spans, straight from the definition."""
    base = {d: base_of(t) for d, t in rows}
    context = []
    for d, t in rows:
        t = t or ""
        for start, _, end, kind, value in base[d]:
            low, high = max(0, start - p.reach), min(len(t), end + p.reach)
            for m in re.finditer(r"[^\W\d_]+", t):
                inside = low <= m.start() and m.end() <= start or end <= m.start() and m.end() <= high
                if inside and len(m[0]) >= 3:
                    context.append((d, t, f"{kind}:{value.lower()}", m[0].lower(), m.start(), m.end()))
    n = len(rows)
    n_te, pages, n_e = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, t, e, w, _, _ in context:
        n_te[e, w].add(d)
        pages[e, w].add(t)
        n_e[e].add(d)
    n_t = Counter(w for _, t in rows for w in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t or "")})
    out = defaultdict(set)
    for d, _, e, w, start, end in context:
        if len(pages[e, w]) >= p.support and n > len(n_e[e]):
            pmi = math.log(n * len(n_te[e, w]) / (n_t[w] * len(n_e[e])))
            if pmi / math.log(n / len(n_e[e])) >= p.share - 1e-12 and not any(
                b[0] < end and start < b[2] for b in base[d]
            ):
                out[d].add((start, 4, end, "term", ""))
    return base, out


def check(docs, p=privacy.PrivacyParameters()):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base, terms = terms_of(rows, p)
    found = {r.doc_id: r for r in privacy.report(docs, p).collect()}
    assert found.keys() == base.keys()
    for d, spans in base.items():
        r = found[d]
        count = Counter(s[3] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert r.spans == listed(sorted(spans + sorted(terms[d])))
    return base, terms


TRICKY = [
    "a@b.co_x@d.ee, a@@b.com x@y .a@b.c.d.e a%b+c@d-e.f1.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1.1.1 0001.02.3.255 10.0.0.1x 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111 4111  1111 1111 1111 79927398713 00000000000000000000",
    "+1 (212) 555-0100 +49.30.123456 +1 23 ++4412345678901 +1234567890123456 +1((((( +9 - 9",
    "é𝄞 mail ünï@host.example.org + 10.0.0.1 &\n4111111111111111 +4915112345678",
    "1" * 3000 + " " + "a" * 3000 + " " + "1.1.1." * 500 + "@" * 50,
    "5500 0000 0000 0004" * 40, "x@y.z " * 700, "12 34-56 7 8 9 0 1 2 3", "4222222222222 4222222222222", "5-5-5-5-5-5 -4242424242424242-",
]


def test_base_and_terms_against_plain_python(spark, cluttered):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    rows += [(100 + i, f"Call {'agent' if i % 2 else 'broker'} Zorblatt number {i} via zed@corp.example today ok") for i in range(8)]
    rows += [(200 + i, f"plain words today number {i} agent broker") for i in range(20)]
    base, terms = check(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sum(len(t) for t in terms.values()) >= 8
    check(cluttered)
    assert privacy.report(cluttered.limit(0)).collect() == []


def test_whole_table(spark):
    base, _ = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(map(len, base.values())) > 20


def test_sanitised_text(spark):
    rows = [(i, f"Ask Zorblatt {i} at zed@corp.example now", "x") for i in range(5)] + [(9, None, "x"), (10, "Nothing here", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, base string")
    out = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert out[9] is None and out[10] == "Nothing here"
    assert "zed" not in out[0] and "Zorblatt" not in out[0] and "<email>" in out[0]


def test_sharding_contract_and_stability(spark, cluttered):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.sharded(docs).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 20 < moved < 110
    odd = shards.sharded(cluttered.unionByName(cluttered)).collect()
    assert len(odd) == 36 and {r.size for r in odd if r.doc_id == 0} == {1}
    assert shards.sharded(cluttered.limit(0)).collect() == []


def test_weights(spark, tmp_path):
    keys = spark.range(8000)
    shares = Counter(r[0] for r in keys.select(shards.rendezvous(keys.id, [1, 2, 5])).collect())
    assert abs(shares[1] / 8000 - 0.25) < 0.03 and abs(shares[2] / 8000 - 0.625) < 0.03
    shards.write_sharded(keys, str(tmp_path / "out"), [1, 1], key="id", files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 8000 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}


def test_repeated_and_null_ids_multiply_no_row(spark):
    rows = [(1, "mail a@b.co now"), (1, "nothing here"), (1, "mail a@b.co now"), (None, "x@y.org"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [tuple(r) for r in privacy.sanitised(df).select("doc_id", "text").collect()]
    expected = [(1, "mail <email> now"), (1, "nothing here"), (1, "mail <email> now"), (None, "<email>"), (None, None), (2, "")]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    found = privacy.report(df).select("doc_id", "n_email").collect()
    assert sorted(((r.doc_id, r.n_email) for r in found), key=repr) == sorted([(1, 1), (1, 0), (1, 1), (None, 1), (None, 0), (2, 0)], key=repr)
