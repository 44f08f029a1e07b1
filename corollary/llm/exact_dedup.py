"""Exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import write_once

#: Ids of rows with copies that are broadcast to fetch their texts; more are joined in a shuffle.
BROADCAST_IDS = 1_000_000
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Each row's normalised text is hashed once, to MD5 (128 bits) and SHA-256; rows are grouped by these,
    without their texts, by a partial aggregation: a text with a million copies leaves each task as one
    row. Only the texts of groups with two rows or more are fetched, and grouped by MD5 and the text
    itself, which compares their bytes: a collision makes two groups.

    Null and empty texts are equal to each other. Null ids come after all others: such a row stays
    only where its group has no id at all. Of rows repeated with one id, one stays. Texts of any length
    are hashed whole. An empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hashed = rows.select("doc_id", F.unhex(F.md5("norm")).alias("h128"), F.sha2("norm", 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id())
    hashed = write_once(hashed, "hashed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = hashed.groupBy("h128", "text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h128", "text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    several = write_once(groups.where("group_size > 1"), "groups")
    members = hashed.join(several.select("h128", "text_sha256"), ["h128", "text_sha256"], "left_semi").select(F.col("doc_id").alias("member")).distinct()
    members = write_once(members, "members")
    members = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    texts = rows.join(members, rows["doc_id"].eqNullSafe(F.col("member")), "left_semi").withColumn("h128", F.unhex(F.md5("norm")))
    equal = texts.groupBy("h128", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    equal = equal.where("group_size > 1").select("h128", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    equal = equal.join(several.select("h128", "text_sha256", "keep_row"), ["h128", "text_sha256"])
    found = hashed.join(equal, ["h128", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n
"""
