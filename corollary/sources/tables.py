"""External tables as relations: a projection to places x1..xN, without nulls, as a set where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relation(df: DataFrame, *places: str | Column, distinct: bool = True) -> DataFrame:
    """Columns x1..xN of ``df``. Rows with a null place are no facts; relations are sets.

    ``distinct=False`` is for places that hold a key of the table: the set needs no shuffle then.
    """
    cells = [(F.col(p) if isinstance(p, str) else p).alias(f"x{i}") for i, p in enumerate(places, 1)]
    rows = df.select(*cells).dropna()
    return rows.distinct() if distinct else rows


class Tables:
    """The Parquet tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
