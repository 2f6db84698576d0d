"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Documents with equal shingle sets form a class; all further work is on one representative per class.
Bands of minima put representatives into buckets. A bucket is compared on signatures (one byte per
minimum) inside tasks, in tiles of bounded size, and only pairs that survive leave the task:

* first every member against the bucket's centre (its most copied member), one comparison per row;
* then, where a bucket still holds several components, the members outside its largest component
  against all members of other components. Members of one component need no further comparison,
  so a large group of near copies costs its size, not its square. What such a row could be linked
  with leaves the task as one row per component part, and each part's sets are gathered once.

After each batch of minima a pair is dropped when the posterior probability that its similarity
reaches the threshold falls below the chosen miss probability. Survivors are verified on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.store import components, dropped, kept
from spoorline.llm.words import SPACED, Words, arrow_map, each_slice, mix, shingles


@dataclass(frozen=True)
class NearParameters:
    """``bands * rows`` minima; ``batch`` of them per Bayesian step; ``miss`` per comparison.

    A pair at the threshold meets in no bucket with probability (1 - threshold**rows)**bands,
    1.3e-6 by default.
    """

    width: int = 5
    percent: int = 75
    bands: int = 50
    rows: int = 5
    batch: int = 50
    miss: float = 1e-7
    tile: int = 512
    seed: int = 7


def least_matches(p: NearParameters) -> list[int]:
    """For each batch end n: the fewest equal bytes out of n that keep a pair.

    Uniform prior on the similarity s; one byte of two minima agrees with probability
    s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    agree = s + (1 - s) / 256
    high = s >= p.percent / 100
    out = []
    for n in range(p.batch, p.bands * p.rows + 1, p.batch):
        least = n
        for m in range(n, -1, -1):
            log = m * np.log(agree) + (n - m) * np.log1p(-agree)
            mass = np.exp(log - log.max())
            if mass[high].sum() / mass.sum() < p.miss:
                break
            least = m
        out.append(least)
    return out


def minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions h -> factor * h modulo 2**32."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(out, (factors[:, None] * h[None, i : i + 1024]).min(axis=1), out=out)
    return out


SKETCH = "doc_id bigint, n_shingles bigint, set_key binary, signature binary, buckets array<bigint>"


def sketches(docs: DataFrame, p: NearParameters) -> DataFrame:
    """One row per document: size and digest of its shingle set, signature bytes and bucket keys."""
    count = p.bands * p.rows
    draws = np.random.default_rng(p.seed).integers(0, 1 << 32, count, dtype=np.uint64)
    factors = (draws | np.uint64(1)).astype(np.uint32)
    names = mix(np.arange(1, p.bands + 1, dtype=np.uint64))

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for low, high, data, bounds in each_slice(batch):
            words = Words(data, bounds, SPACED)
            sizes, keys, signatures, buckets = [], [], [], []
            for i in range(high - low):
                found = shingles(words.hash[words.first[i] : words.first[i + 1]], p.width)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    signatures.append(None)
                    buckets.append(None)
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                values = minima(found, factors)
                signatures.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                key = names.copy()
                for row in values.reshape(p.bands, p.rows).T.astype(np.uint64):
                    key = mix(key + row)
                buckets.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, high - low),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(arrow_map(sketch), SKETCH)


def _survivors(asking, asked, least: list[int], step: int):
    """Index pairs (asking, asked) of different labels that pass every Bayesian step.

    A pair of two rows that both ask in this bucket is taken once, from its smaller id.
    """
    q, m = np.nonzero(
        (asking["label"][:, None] != asked["label"][None, :])
        & (~asked["both"][None, :] | (asking["id"][:, None] < asked["id"][None, :]))
    )
    equal = np.zeros(len(q), np.int32)
    for k, need in enumerate(least):
        part = slice(k * step, (k + 1) * step)
        for i in range(0, len(q), 1 << 14):
            cut = slice(i, i + (1 << 14))
            equal[cut] += (
                asking["signature"][q[cut], part] == asked["signature"][m[cut], part]
            ).sum(axis=1)
        stay = equal >= need
        q, m, equal = q[stay], m[stay], equal[stay]
    return q, m


CANDIDATES = "asker bigint, label bigint, part int, members array<bigint>"


def compare(rows: DataFrame, p: NearParameters, stars: bool) -> DataFrame:
    """Candidates (asker, label, part, members) of rows (bucket, tile, block, asks, both, id, label, part, signature).

    Rows that ask are compared with all rows of their (bucket, tile, block) that do not and that have
    another label; groups are bounded by how the caller cuts tiles and blocks. What leaves a task is
    not one row per pair but one per asker, label and part of that label's members. With ``stars``
    the one row that asks is a bucket's centre, and the roles are exchanged: members ask the centre.
    """
    least, step, width = least_matches(p), p.batch, p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {
                n: batch.column(i).to_numpy(zero_copy_only=False)
                for i, n in enumerate(batch.schema.names)
                if n != "signature"
            }
            body = b"".join(batch.column("signature").to_pylist())
            cols["signature"] = np.frombuffer(body, np.uint8).reshape(-1, width)
            if pending is not None:
                cols = {n: np.concatenate([pending[n], v]) for n, v in cols.items()}
            change = np.zeros(len(cols["id"]), bool)
            for n in ("bucket", "tile", "block"):
                change[1:] |= cols[n][1:] != cols[n][:-1]
            cuts = np.flatnonzero(change)
            last = cuts[-1] if len(cuts) else 0
            pending = {n: v[last:] for n, v in cols.items()}
            if last:
                yield judged({n: v[:last] for n, v in cols.items()}, cuts[:-1])
        if pending is not None:
            yield judged(pending, np.zeros(0, np.int64))

    def judged(cols, cuts) -> pa.RecordBatch:
        found = []
        edges = np.concatenate([[0], cuts, [len(cols["id"])]])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            asks = cols["asks"][low:high]
            asking = {n: v[low:high][asks] for n, v in cols.items()}
            asked = {n: v[low:high][~asks] for n, v in cols.items()}
            q, m = _survivors(asking, asked, least, step)
            if stars:
                found.append((asked["id"][m], asking["id"][q], asked["part"][m], asking["id"][q]))
            else:
                found.append((asking["id"][q], asked["label"][m], asked["part"][m], asked["id"][m]))
        asker, label, part, member = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((part, label, asker))
        asker, label, part, member = asker[order], label[order], part[order], member[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (asker[1:] != asker[:-1]) | (label[1:] != label[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(fresh)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[first, len(order)], pa.int32()), pa.array(member, pa.int64())
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(asker[first]), pa.array(label[first]), pa.array(part[first], pa.int32()), lists],
            names=["asker", "label", "part", "members"],
        )

    ordered = (
        rows.select("bucket", "tile", "block", "asks", "both", "id", "label", "part", "signature")
        .repartition("bucket", "tile", "block")
        .sortWithinPartitions("bucket", "tile", "block")
    )
    return ordered.mapInArrow(run, CANDIDATES)


def verified(candidates: DataFrame, members: DataFrame, docs: DataFrame, p: NearParameters) -> DataFrame:
    """Links (a, b): for each candidate row, the first member whose full set reaches the similarity.

    All members of a row have one label, that is, one component, so one link per row says it all.
    ``members`` (label, part, id) holds every member named, once; a task holds the sets of one part.
    Similarities are judged in whole numbers.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, part, asks, ids = (batch.column(n).to_pylist() for n in ("label", "part", "asks", "id"))
            lists = batch.column("members")
            left, right = [], []
            for low, high, data, bounds in each_slice(batch):
                words = Words(data, bounds, SPACED)
                for i in range(low, high):
                    if (label[i], part[i]) != at:
                        held, at = {}, (label[i], part[i])
                    own = shingles(words.hash[words.first[i - low] : words.first[i - low + 1]], p.width)
                    if not asks[i]:
                        held[ids[i]] = own
                        continue
                    for member in lists[i].as_py():
                        other = held[member]
                        few, many = sorted((len(own), len(other)))
                        if 100 * few < p.percent * many:
                            continue
                        shared = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * shared >= p.percent * (few + many - shared):
                            left.append(ids[i])
                            right.append(member)
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    ids = candidates.select(F.col("asker").alias("id")).union(members.select("id")).distinct()
    texts = kept(
        docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(
            ids.hint("merge"), "id", "left_semi"
        ),
        "near-texts",
    ).hint("merge")
    none = F.lit(None).cast("array<bigint>")
    rows = (
        members.select("label", "part", "id", F.lit(False).alias("asks"), none.alias("members"))
        .unionByName(candidates.select("label", "part", F.col("asker").alias("id"), F.lit(True).alias("asks"), "members"))
        .join(texts, "id")
        .repartition("label", "part")
        .sortWithinPartitions("label", "part", "asks")
    )
    links = kept(rows.mapInArrow(verify, "a bigint, b bigint"), "near-links")
    dropped(texts)
    return links


def near_duplicates(docs: DataFrame, p: NearParameters | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents whose five-word shingle sets
    have a Jaccard similarity of at least 75 %.

    ``docs`` needs a unique doc_id and text; other columns, whatever their names, are ignored. Words
    are runs of non-space characters, A-Z folded. A text of fewer words than a shingle is one
    shingle; a null or wordless text has none, is linked with nothing and is its own component.
    Equal texts always share a component. An empty table gives an empty result. A document is kept
    if it has the smallest doc_id of its component.
    """
    p = p or NearParameters()
    docs = docs.select("doc_id", "text")
    sketch = kept(sketches(docs, p), "near-sketches")
    classes = (
        sketch.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    reps = (
        classes.select("id", "copies")
        .join(sketch.select(F.col("doc_id").alias("id"), "signature", "buckets"), "id")
    )
    entries = reps.select(F.explode("buckets").alias("bucket"), "id", "copies")
    crowded = (
        entries.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("copies", -F.col("id"))).alias("top"))
        .filter("size > 1")
        .select("bucket", "size", (-F.col("top.col2")).alias("centre"))
    )
    members = kept(
        entries.select("bucket", "id").join(crowded, "bucket"), "near-members"
    )
    tiles = F.ceil(F.col("size") / F.lit(p.tile)).cast("int")
    signed = sketch.select(F.col("doc_id").alias("id"), "signature").hint("merge")

    # Every member against the centre of its bucket; a centre is copied to each tile of its bucket.
    centre = F.col("id") == F.col("centre")
    tile = F.pmod(F.xxhash64("id"), tiles).cast("int")
    spread = members.select(
        "bucket",
        F.explode(F.when(centre, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(tile))).alias("tile"),
        F.lit(0).alias("block"),
        centre.alias("asks"),
        F.lit(False).alias("both"),
        "id",
        F.col("id").alias("label"),
        tile.alias("part"),
    )
    stars = kept(
        compare(spread.join(signed, "id"), p, stars=True)
        .groupBy("asker", "label")
        .agg(F.min("part").alias("part"))
        .withColumn("members", F.array("label")),
        "near-candidates",
    )
    centres = stars.select("label", "part", F.col("label").alias("id")).distinct()
    links = verified(stars, centres, docs, p)
    roots = kept(components(links), "near-roots")

    # Buckets that still hold several components.
    labels = members.select("id").distinct().join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left"
    ).select("id", F.coalesce("root", "id").alias("label"))
    families = labels.groupBy("label").agg(F.count(F.lit(1)).alias("family"))
    parts = F.ceil(F.col("family") / F.lit(p.tile)).cast("int")
    labels = kept(
        labels.join(families, "label").select(
            "id", "label", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")
        ),
        "near-labels",
    )
    labelled = kept(members.select("bucket", "id", "size").join(labels, "id"), "near-labels")
    parties = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("party"))
    mixed = (
        parties.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("labels"),
            F.max(F.struct("party", "label")).alias("main"),
        )
        .filter("labels > 1")
        .select("bucket", F.col("main.label").alias("main"), F.col("main.party").alias("party"))
    )
    open_rows = labelled.join(mixed, "bucket")
    blocks = F.ceil((F.col("size") - F.col("party")) / F.lit(p.tile)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    minor = F.col("label") != F.col("main")
    asked = open_rows.select(
        "bucket", tile.alias("tile"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        F.lit(False).alias("asks"), minor.alias("both"), "id", "label", "part",
    )
    asking = open_rows.filter(minor).select(
        "bucket", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), block.alias("block"),
        F.lit(True).alias("asks"), F.lit(True).alias("both"), "id", "label", "part",
    )
    more = kept(
        compare(asked.unionByName(asking).join(signed, "id"), p, stars=False)
        .groupBy("asker", "label", "part")
        .agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members")),
        "near-candidates",
    )
    if not more.isEmpty():
        named = labels.join(more.select("label", "part").distinct(), ["label", "part"], "left_semi")
        found = verified(more, named, docs, p)
        if not found.isEmpty():
            roots = kept(components(links.unionByName(found)), "near-roots")
    for table in (members, labels, labelled, stars, more):
        dropped(table)

    owners = (
        sketch.select("doc_id", "n_shingles", "set_key")
        .join(classes.select("set_key", "id"), "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"))
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
    )
    return owners.select(
        "doc_id",
        "n_shingles",
        F.coalesce("root", "id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("root", "id")).alias("kept"),
    )
