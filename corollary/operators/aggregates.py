"""Counts and aggregates over complete sets of bindings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AggregateError(ValueError):
    """Some binding set has no finite number for the variable: there is no aggregate of the rest."""


@dataclass(frozen=True)
class Aggregate:
    """``value`` is None for no binding sets; ``witnesses`` counts binding sets, not distinct values."""

    value: float | None
    witnesses: int


def aggregated(bindings: DataFrame, variable: str, op: str) -> DataFrame:
    """One row: value, witnesses, bad (binding sets without a finite number). Each row is a binding set."""
    number = F.expr(f"try_cast(`{variable}` AS double)")
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    made = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[op](number)
    return bindings.agg(made.alias("value"), F.count(F.lit(1)).alias("witnesses"), F.count(F.when(~good | number.isNull(), 1)).alias("bad"))


def aggregate(bindings: DataFrame, variable: str, op: str) -> Aggregate:
    """Sum, min, max or avg of a variable over all binding sets, or an error; never over a part of them."""
    row = aggregated(bindings, variable, op).first()
    if row["bad"]:
        raise AggregateError(f"{row['bad']} binding sets have no finite number for {variable}")
    if not row["witnesses"]:
        return Aggregate(None, 0)
    if row["value"] is None or row["value"] in (float("inf"), float("-inf")):
        raise AggregateError(f"{op} of {variable} overflows")
    return Aggregate(row["value"], row["witnesses"])


def exactly(bindings: DataFrame, counted: str, by: list[str], n: int, canon: DataFrame | None = None) -> DataFrame:
    """Values of ``by`` with exactly ``n`` (1 or more) different entities in ``counted``; equal names count once."""
    if canon is not None:
        near = canon.select(F.col("term").alias("_t"), F.col("rep").alias("_r"))
        bindings = bindings.join(near, F.col(counted) == F.col("_t"), "left").withColumn(counted, F.coalesce("_r", counted)).drop("_t", "_r")
    grouped = bindings.groupBy(*by).agg(F.count_distinct(counted).alias("_n"))
    return grouped.where(F.col("_n") == n).select(*by) if by else grouped.where(F.col("_n") == n)
