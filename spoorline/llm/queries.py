"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import (
    contamination,
    dialogue,
    embeddings,
    lines,
    maxscore,
    merkle,
    near,
    pages,
    pieces,
    privacy,
    quality,
    shards,
    tokenfiles,
)
from spoorline.llm.catalog import query, table


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_line_dedup", lines.CHECK)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op3_sentencepiece_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


@query("op9_rendezvous_sharding", shards.CHECK)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


@query("op10_pii_sanitisation")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"))


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op5_token_id_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.stored_ids(spark, table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", merkle.CHECK)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", dialogue.CHECK)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op11_exact_topk", maxscore.CHECK)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
