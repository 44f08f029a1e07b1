"""Equality: classes of terms with one representative each, and relations rewritten through them."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_once

#: Equations up to which the classes are found on the driver; more are found by distributed rounds.
DRIVER_EDGES = 100_000


def classes(pairs: list[tuple]) -> dict:
    """{term: representative} by union-find; the least term of a class represents it."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def path(pairs: list[tuple], start, goal) -> list[tuple] | None:
    """A shortest chain of equations from one term to another, as evidence; None if there is none."""
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append((b, (a, b)))
        near[b].append((a, (a, b)))
    came = {start: None}
    todo = deque([start])
    while todo:
        x = todo.popleft()
        if x == goal:
            out = []
            while came[x] is not None:
                x, edge = came[x]
                out.append(edge)
            return out[::-1]
        for y, edge in near[x]:
            if y not in came:
                came[y] = (x, edge)
                todo.append(y)
    return None


def canon(edges: DataFrame, driver_edges: int = DRIVER_EDGES, max_rounds: int = 60) -> DataFrame:
    """(x1, x2) equations -> (term, rep). Small tables are solved on the driver, others by rounds of
    large-star and small-star steps, in which no node's neighbours are ever gathered in one place."""
    spark = edges.sparkSession
    at = edges.where("x1 <> x2").select(F.greatest("x1", "x2").alias("u"), F.least("x1", "x2").alias("v")).distinct()
    few = at.limit(driver_edges + 1).collect()
    kind = at.schema["u"].dataType.simpleString()
    if len(few) <= driver_edges:
        found = sorted(classes([(r["u"], r["v"]) for r in few]).items())
        return spark.createDataFrame(found, f"term {kind}, rep {kind}")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    at = write_once(at, "equal")
    before = state(at)
    for _ in range(max_rounds):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = write_once(moved.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "equal")
        after = state(at)
        if after == before:
            return at.select(F.col("u").alias("term"), F.col("v").alias("rep")).unionByName(at.select(F.col("v").alias("term"), F.col("v").alias("rep")).distinct())
        before = after
    raise RuntimeError(f"equality classes did not settle in {max_rounds} rounds")


def canonical(relation: DataFrame, names: DataFrame, places: list[str] | None = None) -> DataFrame:
    """The relation with each place's term put in for by its representative; a set again."""
    for p in places or relation.columns:
        near = names.select(F.col("term").alias(f"t_{p}"), F.col("rep").alias(f"r_{p}"))
        relation = relation.join(near, F.col(p) == F.col(f"t_{p}"), "left").withColumn(p, F.coalesce(f"r_{p}", p)).drop(f"t_{p}", f"r_{p}")
    return relation.distinct()


def frame(spark: SparkSession, mapping: dict) -> DataFrame | None:
    return spark.createDataFrame(sorted(mapping.items()), "term string, rep string") if mapping else None
