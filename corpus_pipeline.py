"""A training corpus from raw documents, stage by stage; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corollary.llm import stages
from corollary.llm.scratch import table, write_once

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact dedup", stages.drop_copies),
    ("n-gram jaccard join", stages.drop_near_copies),
    ("benchmark decontamination", stages.drop_contaminated),
    ("mixing sources to target weights", stages.mix),
]

#: SQL cannot express the fitted model of the first stage; the tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All STAGES over the documents of ``sf_dir``: (doc_id, size, source_size, target, taken)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
