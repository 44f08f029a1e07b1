"""Scratch tables of the library, and what long chains of steps need besides."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..scratch import write_once
from .arrowmap import release

__all__ = ["settle", "table", "write_once"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
