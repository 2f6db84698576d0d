"""A Merkle manifest of a table: digests of rows, of groups and of the whole, with a proof for each row.

The nodes of a tree are cut into aligned blocks of ``SPAN``. A block keeps each of its levels as one
hex string, 64 characters a node, so parents are digests of fixed-width substrings, and the siblings
of a node are the substrings that flank it. The roots of blocks are the nodes of the next tree of
blocks, until one is left. No group is gathered: a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.sqlcrc import CRC_STEPS, crc_of
from spoorline.llm.store import kept
from spoorline.operators.skew import ordered_numbers

RISE = 8
SPAN = 1 << RISE
HEX = 64


def digest(text: str) -> str:
    return f"sha2(cast({text} as binary), 256)"


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or '-' for null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A group as a string that is never null: null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group.cast("string")))


_PARENT = (
    f"array_join(transform(sequence(0, (length(%s) - 1) div {2 * HEX}), "
    f"j -> {digest(f'substring(%s, {2 * HEX} * j + 1, {2 * HEX})')}), '')"
)


def _levels() -> Column:
    """All levels of a block, lowest first, each one hex string.

    The first block of a tree, if it is not full, is the whole tree and ends at one node. Any other
    block rises by all its levels, as its tree goes on above it, even where one node is left.
    """
    last = "element_at(acc, -1)"
    parent = _PARENT % (last, last)
    return F.expr(
        f"aggregate(sequence(1, {RISE}), array(array_join(transform(items, x -> x.node), '')), (acc, k) -> "
        f"if(block > 0 or size(items) = {SPAN} or length({last}) > {HEX}, concat(acc, array({parent})), acc))"
    )


def _siblings(place: str) -> str:
    """The other nodes of the run at each level: what stands left of the node, and right of it."""
    index = f"shiftright({place}, l)"
    left = f"substring(levels[l], ({index} - {index} % 2) * {HEX} + 1, ({index} % 2) * {HEX})"
    right = f"substring(levels[l], ({index} + 1) * {HEX} + 1, (1 - {index} % 2) * {HEX})"
    return (
        f"transform(slice(sequence(0, {RISE}), 1, size(levels) - 1), "
        f"l -> named_struct('left', {left}, 'right', {right}))"
    )


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """(tree, block, items, levels) from (tree, pos, node) and carried columns."""
    item = F.struct("pos", "node", *carry)
    cut = nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("block"))
    return cut.agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("levels", _levels())


def rungs(nodes: DataFrame, carry: Sequence[str] = ()) -> list[DataFrame]:
    """The tables of blocks above (tree, pos, node), lowest first; the last has one block a tree.

    ``pos`` counts each tree's nodes from 0 without gaps. Each table is written to the shared folder
    and is ``SPAN`` times shorter than the one before.
    """
    found = [kept(_blocks(nodes, carry), "merkle")]
    while (found[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = found[-1].select("tree", F.col("block").alias("pos"), F.element_at("levels", -1).alias("node"))
        found.append(kept(_blocks(above, ()), "merkle"))
    return found


def roots(ladder: list[DataFrame]) -> DataFrame:
    """(tree, node): the root of every tree."""
    return ladder[-1].select("tree", F.element_at("levels", -1).alias("node"))


def _opened(blocks: DataFrame, facts: Sequence[str]) -> DataFrame:
    """One row an item: its fields, its path (siblings here, then those of the block), the block's facts."""
    siblings = _siblings(f"cast(x.pos % {SPAN} as int)")
    items = F.expr(f"transform(items, x -> struct(x as item, {siblings} as own))")
    rows = blocks.select("tree", "path", *facts, F.explode(items).alias("_opened"))
    return rows.select("tree", "_opened.item.*", F.concat("_opened.own", "path").alias("path"), *facts)


def paths(ladder: list[DataFrame], tops: DataFrame, facts: Sequence[str]) -> DataFrame:
    """Every lowest node with its path to the top, from (tree, path, facts) of the trees' own roots.

    Blocks meet the paths above them by (tree, block), which is unique on both sides.
    """
    rows = ladder[-1].join(tops, "tree")
    for lower in reversed(ladder[:-1]):
        above = _opened(rows, facts).withColumnRenamed("pos", "block").drop("node")
        rows = lower.join(above, ["tree", "block"])
    return _opened(rows, facts)


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """(key, carried, leaf, path, subroot, root) for every row.

    A row's leaf is ``leaf_hash`` of ``columns``. Leaves of one group (null is a group) ascend by key,
    nulls first, equal keys by leaf; two neighbours make a parent, an odd last one alone, up to the
    group's subroot. The subroots, null group first and then by UTF-8 bytes, make the root likewise.
    ``path`` lists, level by level from leaf to root, what stands left and right of the node in its
    run, ready for ``folded``. Repeated rows are leaves of their own; an empty table gives no rows;
    other columns are ignored.
    """
    extra = {f"_c{i}": (name, c) for i, (name, c) in enumerate((carried or {}).items())}
    leaves = docs.select(
        group_key(F.col(group)).alias("tree"),
        F.col(key).alias("_key"),
        leaf_hash([F.col(c) for c in columns]).alias("node"),
        *[c.alias(short) for short, (_, c) in extra.items()],
    )
    order = [F.col("_key").asc_nulls_first(), F.col("node").asc()]
    placed = ordered_numbers(leaves, ["tree"], order, "pos").withColumn("pos", F.col("pos") - 1)
    ladder = rungs(placed, ["_key", *extra])

    groups = roots(ladder).select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "node")
    ranked = ordered_numbers(groups, ["tree"], [F.col("_group").asc()], "pos").withColumn("pos", F.col("pos") - 1)
    upper = rungs(ranked, ["_group"])
    nothing = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    top = roots(upper).select("tree", F.col("node").alias("root"), nothing.alias("path"))
    tops = paths(upper, top, ["root"]).select(
        F.col("_group").alias("tree"), F.col("node").alias("subroot"), "root", "path"
    )
    return paths(ladder, tops, ["subroot", "root"]).select(
        F.col("_key").alias(key),
        *[F.col(short).alias(name) for short, (name, _) in extra.items()],
        F.col("node").alias("leaf"),
        "path",
        "subroot",
        "root",
    )


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.expr(f"aggregate({path}, {leaf}, (h, p) -> {digest('concat(p.left, h, p.right)')})")


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, in order."""
    return F.expr(digest(f"array_join(transform({path}, p -> concat(p.left, p.right)), '')"))


def tampered_leaf() -> Column:
    """The leaf of a document whose ``n_chars`` was raised by one where 7 divides the id's crc32, else null."""
    bumped = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), bumped, F.col("text")]
    return F.when(hit, leaf_hash(columns))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with each proof folded from the row as a tampered copy holds it.

    A null doc_id is never tampered with; a null n_chars stays null, so its leaf still verifies.
    """
    rows = manifest(docs, carried={"_altered": tampered_leaf()})
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest().alias("proof_sha256"),
        folded("coalesce(_altered, leaf)").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    texts = ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


CHECK = f"""
with recursive {CRC_STEPS},
leaf as (select row_number() over () as rid, doc_id, lang, {_sql_leaf("n_chars")} as h,
    case when {crc_of("doc_id::varchar")} % 7 = 0 then {_sql_leaf("n_chars + 1")} end as altered
  from documents, crc),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos,
    count(*) over (partition by lang) as n from leaf),
low as (select lang, 0 as lvl, pos, h, n from placed
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2
  from low where n > 1 group by lang, lvl, n, pos // 2),
sub as (select lang, lvl, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n
  from low where n = 1),
high as (select 0 as lvl, pos, h, n from sub
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2
  from high where n > 1 group by lvl, n, pos // 2),
climb as (select rid, p.lang, 0 as lvl, pos, coalesce(altered, h) as h, '' as proof from placed p
  union all
  select c.rid, c.lang, c.lvl + 1, c.pos // 2,
    sha256(case when c.pos % 2 = 0 then c.h || coalesce(s.h, '') else s.h || c.h end), c.proof || coalesce(s.h, '')
  from climb c join sub on sub.lang is not distinct from c.lang and c.lvl < sub.lvl
    left join low s on s.lang is not distinct from c.lang and s.lvl = c.lvl and s.pos = xor(c.pos, 1)),
reached as (select c.rid, sub.pos, c.h, c.proof, sub.h as subroot
  from climb c join sub on sub.lang is not distinct from c.lang and c.lvl = sub.lvl),
rise as (select rid, 0 as lvl, pos, h, proof, subroot from reached
  union all
  select c.rid, c.lvl + 1, c.pos // 2,
    sha256(case when c.pos % 2 = 0 then c.h || coalesce(s.h, '') else s.h || c.h end), c.proof || coalesce(s.h, ''),
    c.subroot
  from rise c left join high s on s.lvl = c.lvl and s.pos = xor(c.pos, 1)
  where c.lvl < (select max(lvl) from high))
select leaf.doc_id, leaf.h as leaf, subroot, top.h as root, sha256(proof) as proof_sha256, rise.h as folded_root,
  rise.h = top.h as verified
from leaf join rise using (rid) join (select h, lvl from high where n = 1) top on rise.lvl = top.lvl
"""
