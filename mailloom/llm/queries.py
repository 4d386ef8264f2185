"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import bloomdedup, interplay, langid, lattice, lm, mixing, oddsketch, oracles, packing, passages, quality, repair, sharding, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.grade_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "score", "expected_grade", "p_not_toxic", "p_good", F.col("accepted").alias("kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken_words(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.external_shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = oddsketch.near_duplicates(_table(spark, sf_dir, "documents"), words=2, threshold=0.8)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomdedup.annotate_duplicates(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_language_id": op2_language_id,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_mixing": op4_mixing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_sharding": op7_sharding,
        "op8_packing": op8_packing,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_decontamination": op11_decontamination,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_decontamination": oracles.OP11, "op12_filter_audit": oracles.OP12, "op13_conversation_repair": oracles.OP13}
