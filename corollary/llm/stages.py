"""Pipeline stages: an operator's decisions applied to whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard, mixing, toxicity
from .scratch import table, write_once

#: Keys that are broadcast to drop rows by; more are joined in a shuffle.
BROADCAST_KEYS = 1_000_000


def _sent(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast hint if they are few enough."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject. Null and empty texts stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the smallest doc_id; of rows that repeat an id and a text, one."""
    fate = exact_dedup.exact_dedup(docs).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    fate = write_once(fate.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")).where("NOT stays OR rows > 1"), "fate")
    sha = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["gone_id"]) & (sha == keys["gone_sha"])
    gone = _sent(fate.select("gone_id", "gone_sha"))
    out = docs.join(gone, same(gone), "left_anti")
    again = fate.where("stays")
    if again.limit(1).count():
        twice = _sent(again.select("gone_id", "gone_sha"))
        one = docs.join(twice, same(twice), "left_semi")
        key = F.struct("doc_id", exact_dedup.normalised(F.col("text")))
        out = out.unionByName(one.groupBy(key.alias("key")).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near duplicates. Rows without an id stay."""
    found = jaccard.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone_id"))
    gone = write_once(found.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select("gone_id"), "gone")
    keys = _sent(gone)
    return docs.join(keys, docs["doc_id"] == keys["gone_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of what is left."""
    return mixing.mix_sources(docs, mixing.quality_from_labels(table(spark, sf_dir, "labels")))
