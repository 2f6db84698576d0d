"""Order-independent content digests, computed as a hash tree.

A single SHA-256 over the whole sorted text would have to stream every row through one process.
The tree hashes each row, then sorted groups of digests, so no step handles more than a few
thousand digests, and any change to any row still changes the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import canonical_row, json_text
from spoorline.operators.keys import MANIFEST_FIELDS

DEPTHS = (9, 6, 3, 0)  # hex digits that name a node at each level, the same at every size


def content_hash(df: DataFrame, text: Column) -> DataFrame:
    """One row (n, digest) over the multiset of row texts; no row for no rows.

    A node above the leaves has at most 16**3 children; the lowest nodes hold few leaves up to some
    10**13 distinct rows.
    """
    leaves = df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    level = leaves.select("h", F.concat_ws(":", "h", F.col("c").cast("string")).alias("t"), "c")
    for depth in DEPTHS:
        nodes = level.groupBy(F.substring("h", 1, depth).alias("h")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "\n"), 256).alias("d"),
            F.sum("c").alias("c"),
        )
        level = nodes.select("h", F.concat_ws(":", "h", "d").alias("t"), "c", "d")
    return level.select(F.col("c").cast("bigint").alias("n"), F.col("d").alias("digest"))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    attributes = "attributes" if "attributes" in manifest.columns else None
    fields = [c for c in MANIFEST_FIELDS if c in manifest.columns]
    return content_hash(manifest, canonical_row(fields, attributes))


def near_pairs_hash(pairs: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    text = F.concat(F.lit("["), json_text(low), F.lit(","), json_text(high), F.lit("]"))
    return content_hash(pairs, text)
