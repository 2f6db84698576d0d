"""Repair of conversations by the cheapest edits that give a well-formed order of roles.

A conversation is a lattice: a node is a number of turns read and the last role given, an edge is an
edit. A bidirectional Dijkstra search meets in its middle and takes, of all crossings of least cost,
the least audit. A long conversation is cut into segments of ``SEGMENT`` turns; a segment is summed
up by the least audit between each pair of roles at its edges, and summaries are joined in groups of
``FAN`` until one is left. Joining them is exact: two audits of one segment with the same edges and
cost are never one the beginning of the other, so the least whole audit is made of least parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.merkle import group_key
from spoorline.llm.sqlcrc import CRC_STEPS, crc_of
from spoorline.llm.store import kept
from spoorline.operators.skew import ordered_numbers

SEGMENT = 256
FAN = 64

#: What was given last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INSERTS = [(state, "I", 2, following) for state, following in NEXT.items()]

Label = tuple[int, str]
Kind = tuple[str, bool, bool]  # initial of the role, blank or duplicate, truncated


@lru_cache(maxsize=4096)
def edits(kind: Kind) -> tuple[tuple[int, str, int, int], ...]:
    """(state before, letter, cost, state after) of every edit of one turn."""
    initial, delete, truncated = kind
    found = [(state, "D", 3, state) for state in NEXT]
    if not delete:
        late = int(truncated)
        if initial == "s":
            found.append((START, "K", late, SYSTEM))
        for state, following in NEXT.items():
            found.append((state, "R", 2 + late, following))
            if initial == NAMES[following][0]:
                found.append((state, "K", late, following))
    return tuple(found)


@lru_cache(maxsize=4096)
def _out(kind: Kind) -> dict[int, list[tuple[str, int, int]]]:
    return {s: [(x, c, q) for p, x, c, q in edits(kind) if p == s] for s in NEXT}


@lru_cache(maxsize=4096)
def _into(kind: Kind) -> dict[int, list[tuple[str, int, int]]]:
    return {s: [(x, c, p) for p, x, c, q in edits(kind) if q == s] for s in NEXT}


_INSERT_INTO = {s: [(x, c, p) for p, x, c, q in INSERTS if q == s] for s in NEXT}
_INSERT_OUT = {s: [(x, c, q) for p, x, c, q in INSERTS if p == s] for s in NEXT}


def cheapest(kinds: list[Kind], entry: int, exits: Iterable[int]) -> Label | None:
    """(cost, audit) of the least way from ``entry`` before the turns to one of ``exits`` after them.

    Each side settles nodes by cost, and nodes of one cost in its own direction: only keeping a turn
    can be free, so a label is final once settled. The search ends when the two next costs together
    exceed the best crossing, so that every crossing of that cost has been seen.
    """
    n = len(kinds)
    ahead: dict[tuple[int, int], Label] = {(0, entry): (0, "")}
    behind: dict[tuple[int, int], Label] = {(n, x): (0, "") for x in exits}
    front = [(0, 0, entry)]
    back = [(0, -n, x) for x in exits]
    heapq.heapify(back)
    done_ahead: set[tuple[int, int]] = set()
    done_behind: set[tuple[int, int]] = set()
    best = None  # of crossings seen so far

    def settle(heap: list, labels: dict, done: set, sign: int) -> tuple[int, int] | None:
        cost, i, state = heapq.heappop(heap)
        node = (sign * i, state)
        if node in done or labels[node][0] < cost:
            return None
        done.add(node)
        return node

    def relax(heap: list, labels: dict, node: tuple[int, int], label: Label, sign: int) -> None:
        old = labels.get(node)
        if old is None or label < old:
            labels[node] = label
            if old is None or label[0] < old[0]:
                heapq.heappush(heap, (label[0], sign * node[0], node[1]))

    while front and back and (best is None or front[0][0] + back[0][0] <= best):
        forward = front[0][0] <= back[0][0]
        if forward:
            node = settle(front, ahead, done_ahead, 1)
        else:
            node = settle(back, behind, done_behind, -1)
        if node is None:
            continue
        i, state = node
        cost, audit = (ahead if forward else behind)[node]
        if forward:
            steps = [((i, q), c, audit + x) for x, c, q in _INSERT_OUT[state]]
            if i < n:
                steps += [((i + 1, q), c, audit + x) for x, c, q in _out(kinds[i])[state]]
            for other, c, text in steps:
                relax(front, ahead, other, (cost + c, text), 1)
        else:
            steps = [((i, p), c, x + audit) for x, c, p in _INSERT_INTO[state]]
            if i:
                steps += [((i - 1, p), c, x + audit) for x, c, p in _into(kinds[i - 1])[state]]
            for other, c, text in steps:
                relax(back, behind, other, (cost + c, text), -1)
        met = (behind if forward else ahead)
        for other, c in [(node, 0), *((o, c) for o, c, _ in steps)]:
            if other in met:
                total = cost + c + met[other][0]
                best = total if best is None else min(best, total)
    if best is None:
        return None
    crossings = []
    done_behind |= {(n, x) for x in exits}  # nothing is before the first node of either side
    for node in done_ahead | {(0, entry)}:
        i, state = node
        cost, audit = ahead[node]
        ways = [(node, "", 0)] + [((i, q), x, c) for x, c, q in _INSERT_OUT[state]]
        if i < n:
            ways += [((i + 1, q), x, c) for x, c, q in _out(kinds[i])[state]]
        for other, letter, c in ways:
            if other in done_behind and cost + c + behind[other][0] == best:
                crossings.append(audit + letter + behind[other][1])
    return best, min(crossings)


# ---- summaries of segments -------------------------------------------------------------------------

_SUMMARY = [
    ("conv", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()),
    ("min_turn", pa.int64()), ("max_turn", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
]
SUMMARY = pa.schema(_SUMMARY)
SUMMARY_DDL = (
    "conv string, part bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_initial string, last_initial string, turns bigint, min_turn bigint, max_turn bigint, "
    "costs array<bigint>, audits array<string>"
)
LEGAL = {"su", "ua", "au"}


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, across batches; a run is at most one segment or one fan."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _emitted(found: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    weight = 0
    for row in found:
        rows.append(row)
        weight += 64 + sum(len(v) for v in row.values() if isinstance(v, str))
        if len(rows) >= size or weight > 1 << 22:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _summary(key: tuple, rows: list[dict], segment: int) -> dict:
    """What one segment of turns amounts to, whatever stands before and after it."""
    firsts = {r["pos"] for r in rows if r["mark"] == 1}
    turns = [r for r in rows if r["mark"] == 0]
    kinds: list[Kind] = []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for r in turns:
        fault = "blank" if r["blank"] else "duplicate" if r["pos"] not in firsts else "truncated" if r["open"] else None
        if fault:
            count[fault] += 1
        kinds.append((r["initial"], fault in ("blank", "duplicate"), fault == "truncated"))
    costs: list[int | None] = [None] * 16
    audits: list[str | None] = [None] * 16
    entries, alone = range(4), key[1] == 0 and len(turns) < segment
    if key[1] == 0:
        entries = (START,)
    for entry in entries:
        for exits in [ENDS] if alone else [(x,) for x in range(4)]:
            found = cheapest(kinds, entry, exits)
            if found:
                costs[4 * entry + exits[-1]], audits[4 * entry + exits[-1]] = found
    numbers = [r["turn"] for r in turns if r["turn"] is not None]
    return count | {
        "conv": key[0], "part": key[1], "n": len(turns),
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(kinds, kinds[1:])),
        "first_initial": kinds[0][0], "last_initial": kinds[-1][0],
        "turns": len(set(numbers)), "min_turn": min(numbers, default=None), "max_turn": max(numbers, default=None),
        "costs": costs, "audits": audits,
    }


def joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring stretches."""
    costs: list[int | None] = [None] * 16
    audits: list[str | None] = [None] * 16
    for entry in range(4):
        for end in range(4):
            ways = [
                (a["costs"][4 * entry + m] + b["costs"][4 * m + end], a["audits"][4 * entry + m] + b["audits"][4 * m + end])
                for m in range(4)
                if a["costs"][4 * entry + m] is not None and b["costs"][4 * m + end] is not None
            ]
            if ways:
                costs[4 * entry + end], audits[4 * entry + end] = min(ways)
    same = a["max_turn"] is not None and a["max_turn"] == b["min_turn"]  # turns ascend: only an edge is shared
    known = [x for x in (a["min_turn"], b["min_turn"]) if x is not None]
    tops = [x for x in (a["max_turn"], b["max_turn"]) if x is not None]
    return {
        "conv": a["conv"], "part": a["part"],
        **{k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")},
        "illegal": a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in LEGAL),
        "first_initial": a["first_initial"], "last_initial": b["last_initial"],
        "turns": a["turns"] + b["turns"] - same, "min_turn": min(known, default=None), "max_turn": max(tops, default=None),
        "costs": costs, "audits": audits,
    }


def _summaries(segment: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emitted((_summary(k, rows, segment) for k, rows in _grouped(batches, ["conv", "part"])), SUMMARY)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[dict]:
        for (_, part), rows in _grouped(batches, ["conv", "above"]):
            out = rows[0]
            for row in rows[1:]:
                out = joined(out, row)
            yield {k: v for k, v in (out | {"part": part}).items() if k != "above"}

    yield from _emitted(found(), SUMMARY, 64)


def _in_order(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fn, schema)


# ---- the operator ----------------------------------------------------------------------------------


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, turn, role, text) with turns numbered from 0 in each conversation.

    ``conv`` is the conversation's id as a text that is never null. Order: turn (nulls first), then
    role and text, so rows of one turn have a defined order; null role or text is one space. Rows
    that agree in all of these are interchangeable. Written to the shared folder.
    """
    rows = turns.select(
        group_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    numbered = ordered_numbers(rows, ["conv"], order, "pos").withColumn("pos", F.col("pos") - 1)
    return kept(numbered.select("conv", "pos", "turn", "role", "text"), "turns")


def _last_seen(text: str) -> Column:
    r"""The last `[^\x20\x09-\x0D]` of a text, empty if it has none."""
    bare = F.rtrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    return F.substring(bare, -1, 1)


def repair_report(ordered: DataFrame) -> DataFrame:
    """(conv, n, turns, min_turn, max_turn, blank, duplicate, truncated, illegal, cost, audit).

    One row per conversation of ``ordered_turns``. A turn's first fault counts: blank, then a repeat
    of an earlier role and text, then an end without `.`, `!` or `?`. An empty role has no initial
    and can only be given a new role or deleted. Repeats are found by the smallest position of each
    (conversation, role, digest of text), an aggregate that combines before the shuffle; the
    positions come to their segment as marks, so nothing is joined on a frequent text.
    """
    last = _last_seen("text")
    part = F.expr(f"pos div {SEGMENT}").alias("part")
    light = ordered.select(
        "conv", part, "pos", F.lit(0).alias("mark"), "turn", F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
    )
    firsts = ordered.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("pos").alias("pos"))
    marks = firsts.select("conv", part, "pos", F.lit(1).alias("mark"))
    found = _in_order(
        light.unionByName(marks, allowMissingColumns=True), ["conv", "part"], ["pos", "mark"], _summaries(SEGMENT),
        SUMMARY_DDL,
    )
    found = kept(found, "segments")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        above = found.withColumn("above", F.expr(f"part div {FAN}"))
        found = kept(_in_order(above, ["conv", "above"], ["part"], _joined, SUMMARY_DDL), "segments")
    ways = [F.struct(F.col("costs")[x].alias("cost"), F.col("audits")[x].alias("audit")) for x in ENDS]
    best = F.array_min(F.filter(F.array(*ways), lambda w: w["cost"].isNotNull()))
    facts = ["conv", "n", "turns", "min_turn", "max_turn", "blank", "duplicate", "truncated", "illegal"]
    return found.select(*facts, best["cost"].alias("cost"), best["audit"].alias("audit"))


REPAIRED = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each conversation's audit, which comes before its turns, to the turns as they pass."""

    def found() -> Iterator[dict]:
        audit, at, conv, state, place = "", 0, None, START, 0

        def inserted() -> Iterator[dict]:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                yield {"conv": conv, "place": place, "role": NAMES[state], "text": "", "edit": "I"}
                at, place = at + 1, place + 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["pos"] < 0:
                    yield from inserted()
                    audit, at, conv, state, place = row["text"], 0, row["conv"], START, 0
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = SYSTEM if edit == "K" and row["role"][0] == "s" else NEXT[state]
                role = row["role"] if edit == "K" else NAMES[state]
                yield {"conv": conv, "place": place, "role": role, "text": row["text"], "edit": edit}
                place += 1
        yield from inserted()

    yield from _emitted(found(), REPAIRED, 4096)


def repaired(ordered: DataFrame, report: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit): the turns after the cheapest edits, numbered from 0.

    Turns pass in order through one task a conversation, which holds one batch and the audit. Within
    a partition the rows of a conversation come out together and in order.
    """
    audits = report.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return _in_order(
        audits.unionByName(ordered.select("conv", "pos", "role", "text")), ["conv"], ["pos"], _walk,
        "conv string, place bigint, role string, text string, edit string",
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[dict]:
        conv, running = None, None
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != conv:
                    if running:
                        yield {"conv": conv, "sha256": running.hexdigest()}
                    conv, running = key, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
        if running:
            yield {"conv": conv, "sha256": running.hexdigest()}

    yield from _emitted(found(), pa.schema([("conv", pa.string()), ("sha256", pa.string())]))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: by crc32 of `conv_id:turn` modulo 20, nulls as one space,
    0 drops a row, 1 empties its text, 2 takes out its `.!?`, 3 repeats it and 4 makes it a user's."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_fault"))
    fault = F.col("_fault")
    copies = F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """Damage, then repair, every conversation: one row per conv_id, null being one conversation.

    A conversation whose rows are all dropped has zeros, an empty audit and the digest of nothing.
    Rows of one turn are ordered by role, then text. Other columns are ignored; an empty table gives
    no rows. ``repaired_sha256`` is by its definition one running digest a conversation.
    """
    ordered = ordered_turns(damaged(turns))
    report = kept(repair_report(ordered), "repairs")
    lines = repaired(ordered, report)
    digests = lines.select("conv", "role", "text").mapInArrow(_digested, "conv string, sha256 string")
    whole = turns.select("conv_id").distinct().withColumn("conv", group_key(F.col("conv_id")))
    zero = F.lit(0).cast("bigint")
    gaps = F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns")
    return whole.join(report, "conv", "left").join(digests, "conv", "left").select(
        "conv_id",
        F.coalesce(gaps, zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def _plus(label: str, cost: str, letter: str) -> str:
    return f"(lpad((substr({label}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({label}, 10) || {letter})"


def _closed(a: str, b: str, c: str, d: str) -> str:
    """Labels after insertions; a label is its cost in nine digits, then its audit."""
    user = f"least({c}, {_plus(f'least({a}, {b}, {d})', '2', "'I'")})"
    return f"{a} as l0, {b} as l1, {user} as l2, least({d}, {_plus(user, '2', "'I'")}) as l3"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEPT = "case when initial = 'u' then 'K' else 'R' end", "case when initial = 'a' then 'K' else 'R' end"
_COST = "case when initial = 'u' then 0 else 2 end + late", "case when initial = 'a' then 0 else 2 end + late"
CHECK = f"""
with recursive {CRC_STEPS},
hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc_of("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as k
  from conversations, crc),
broken as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from hit),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
    right(rtrim(text, {_SPACES}), 1) as ending from broken),
fault as (select *, substr(role, 1, 1) as initial, case when ending = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
    when ending not in ('.', '!', '?') then 'truncated' end as fault,
    substr(lag(role) over (partition by conv_id order by pos), 1, 1) as before from placed),
facts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from fault group by conv_id),
row as (select conv_id, pos, role, text, initial, coalesce(fault in ('blank', 'duplicate'), false) as gone,
    case when fault = 'truncated' then 1 else 0 end as late from fault),
way as (select conv_id, 0::bigint as pos, '000000000' as l0, null::varchar as l1, '000000002I' as l2,
    '000000004II' as l3 from facts
  union all
  select conv_id, pos, {_closed("m0", "m1", "m2", "m3")} from (
    select w.conv_id, r.pos, {_plus("l0", "3", "'D'")} as m0,
      least({_plus("l1", "3", "'D'")}, case when not gone and initial = 's' then {_plus("l0", "late", "'K'")} end) as m1,
      least({_plus("l2", "3", "'D'")},
        case when not gone then {_plus("least(l0, l1, l3)", _COST[0], _KEPT[0])} end) as m2,
      least({_plus("l3", "3", "'D'")}, case when not gone then {_plus("l2", _COST[1], _KEPT[1])} end) as m3
    from way w join row r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1)),
best as (select facts.*, substr(least(l0, l3), 1, 9)::bigint as cost, substr(least(l0, l3), 10) as audit
  from facts join way on way.conv_id is not distinct from facts.conv_id and way.pos = facts.n),
line as (select conv_id, n, 0::bigint as pos, audit as rest, '' as made, '' as last from best
  union all
  select conv_id, n, pos + 1,
    case when token = '' then '' else substr(rest, length(token) + 1) end,
    made || case when puts = 0 then '' when puts = 1 then chr(10) || first || ':' else
        chr(10) || first || ':' || chr(10) || second || ':' end
      || case when edit = 'K' then chr(10) || role || ':' || text when edit = 'R' then chr(10) || given || ':' || text
        else '' end,
    case when edit = 'K' then initial when edit = 'R' then substr(given, 1, 1)
      when puts = 2 then substr(second, 1, 1) when puts = 1 then substr(first, 1, 1) else last end
  from (select *, length(token) - length(edit) as puts, case when last = 'u' then 'assistant' else 'user' end as first,
      case when last = 'u' then 'user' else 'assistant' end as second,
      case when (last = 'u') = ((length(token) - length(edit)) % 2 = 0) then 'assistant' else 'user' end as given
    from (select l.conv_id, n, l.pos, rest, made, last, role, text, initial,
        regexp_extract(rest, '^I*[KRD]?') as token, right(regexp_extract(rest, '^I*[KRD]'), 1) as edit
      from line l left join row r on r.conv_id is not distinct from l.conv_id and r.pos = l.pos + 1
      where l.pos <= n)))
select whole.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
  coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  sha256(coalesce(substr(made, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) whole
  left join best on best.conv_id is not distinct from whole.conv_id
  left join line on line.conv_id is not distinct from whole.conv_id and line.pos = line.n + 1
"""
