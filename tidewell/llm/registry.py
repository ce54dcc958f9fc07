"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import op9_chat, sql
from tidewell.llm.op1_quality import quality_rules
from tidewell.llm.op10_tokens import document_token_counts
from tidewell.llm.op11_manifest import manifest
from tidewell.llm.op12_spots import COMMON, spot_fingerprints
from tidewell.llm.op13_repair import repaired_conversations
from tidewell.llm.op2_url import url_filter
from tidewell.llm.op3_packing import best_fit_packing
from tidewell.llm.op4_bpe import bpe_round_trip
from tidewell.llm.op5_topk import top_k
from tidewell.llm.op6_substring import repeated_paragraphs
from tidewell.llm.op7_jaccard import jaccard_join
from tidewell.llm.op8_suffix import remove_repeats
from tidewell.llm.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("t")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents")).drop("t", "key")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("t", "root")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return op9_chat.digests(op9_chat.read_back(op9_chat.format_windows(turns)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_fingerprints(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spot_fingerprints": op12_spot_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op5_exact_top_k": sql.TOP_K,
    "op7_ngram_jaccard": sql.JACCARD_JOIN,
    "op9_chat_formatting": sql.CHAT_FORMATTING,
    "op11_merkle_manifest": sql.MERKLE_MANIFEST,
    "op12_spot_fingerprints": sql.SPOT_FINGERPRINTS.replace("COMMON_WORDS", ", ".join(f"'{w}'" for w in COMMON)),
    "op13_conversation_repair": sql.CONVERSATION_REPAIR,
}
