import hashlib
import itertools
import random
import zlib

import pytest

from spoorline.llm import dialogue

DDL = "conv_id bigint, turn bigint, role string, text string, pos int, conv string, mark string, audit string"
STRIP = " \t\n\x0b\f\r"


def dp(kinds):
    """Least (cost, audit) by a plain table over positions and last roles."""
    def close(labels):
        for _ in range(3):
            for p, x, c, q in dialogue.INSERTS:
                if p in labels:
                    way = (labels[p][0] + c, labels[p][1] + x)
                    labels[q] = min(labels.get(q, way), way)
        return labels

    labels = close({dialogue.START: (0, "")})
    for kind in kinds:
        following = {}
        for p, x, c, q in dialogue.edits(kind):
            if p in labels:
                way = (labels[p][0] + c, labels[p][1] + x)
                following[q] = min(following.get(q, way), way)
        labels = close(following)
    return min(labels[s] for s in dialogue.ENDS if s in labels)


def exhaustive(kinds, most):
    """All audits up to a cost, by trying every edit."""
    found = []

    def go(i, state, cost, audit):
        if cost > most:
            return
        if i == len(kinds) and state in dialogue.ENDS:
            found.append((cost, audit))
        for p, x, c, q in dialogue.INSERTS:
            if p == state and not audit.endswith("II"):
                go(i, q, cost + c, audit + x)
        if i < len(kinds):
            for p, x, c, q in dialogue.edits(kinds[i]):
                if p == state:
                    go(i + 1, q, cost + c, audit + x)

    go(0, dialogue.START, 0, "")
    return min(found)


def test_search_against_exhaustion_and_table():
    rng = random.Random(5)
    for n, a, b in itertools.product(range(5), "sua", "uax"):
        kinds = [(rng.choice([a, b, "u"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        found = dialogue.cheapest(kinds, dialogue.START, dialogue.ENDS)
        assert found == dp(kinds) == exhaustive(kinds, found[0])
    for n in range(60):
        kinds = [(rng.choice("suua "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        assert dialogue.cheapest(kinds, dialogue.START, dialogue.ENDS) == dp(kinds)


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(conv, rows):
    own, seen, kinds, faults = broken(rows), set(), [], []
    for turn, role, text in own:
        end = text.rstrip(STRIP)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = dp(kinds)
    lines, last, at = [], "", 0
    for x in audit:
        following = "assistant" if last == "u" else "user"
        if x == "I":
            lines.append(f"{following}:")
            last = following[0]
            continue
        turn, role, text = own[at]
        at += 1
        if x != "D":
            role = role if x == "K" else following
            lines.append(f"{role}:{text}")
            last = role[0]
    assert "".join(x[0] for x in lines) == ("s" * (lines[:1] != [] and lines[0][0] == "s")) + "ua" * (len(lines) // 2)
    turns = [t for t, *_ in own if t is not None]
    initials = [k[0] for k in kinds]
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        n = rng.choice([0, 1, 1, 2, 3, 5, 8]) if conv != 7 else 400
        start = rng.randrange(3)
        for i in range(n + 1):
            role = rng.choice([None, "", "tool"]) if rng.random() < 0.05 else ["user", "assistant", "system"][(i + start) % (2 if i else 3)]
            text = rng.choice(["Hi.", "What?", "no end", None, "", " \t", "ß!\n", "x" * 3000 + ".", f"t{i}."])
            rows.append((conv, None if rng.random() < 0.1 else i + 2 * (i > 4), role, text, 1, "c", "m", "a"))
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("segment", [256, 5])
def test_whole_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    monkeypatch.setattr(dialogue, "FAN", 3 if segment < 10 else 64)
    rows = conversations()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[:4])
    got = dialogue.repaired_conversations(spark.createDataFrame(rows, DDL).repartition(5)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((brute(*x) for x in by_conv.items()), key=key)


def test_nothing_left_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, "", "", "")], DDL)
    assert [tuple(r) for r in dialogue.repaired_conversations(one).collect()] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]
    assert dialogue.repaired_conversations(one.limit(0)).collect() == []
