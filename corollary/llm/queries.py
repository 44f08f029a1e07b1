"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, jaccard, language_id, line_dedup, mixing, secrets, suffix_dedup, toxicity
from .scratch import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the SQL checks; ``benchmark_proximity`` has n_near_items besides."""
    return benchmark_proximity(spark, sf_dir).drop("n_near_items")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(table(spark, sf_dir, "conversations"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeat groups that operator 9 can list, with all their places."""
    return suffix_dedup.maximal_repeats(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.quality_from_labels(table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_toxicity, op4_secret_scans, op5_benchmark_decontamination, benchmark_proximity,
        op6_exact_dedup, op7_line_dedup, op8_chat_formatting, op9_suffix_array_dedup, maximal_repeats, op10_source_mixing,
    )
}

ORACLES = {
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
