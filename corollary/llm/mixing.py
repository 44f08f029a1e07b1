"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_once

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> also weight, target.

    Sources in code-point order, null last, take the weights in turn. A target stops at EPOCHS times
    its source; what is above goes to the others by weight. That is one level for all sources:
    target = min(cap, level * weight), found from sums over the sources sorted by cap / weight. One
    row per source goes through the one-task windows here, never one per document.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    found = ranked.withColumn("fit", fits).withColumn("level", F.min_by("fit", F.when(F.col("fit").isNotNull(), F.col("cap") / F.col("weight"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    share: float = 1.0,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: str = "mix-1:",
    id_col: str = "doc_id",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words; whole epochs first, then the sample).

    Each source is taken whole floor(target / source_size) times. The rest of its budget is filled in
    the order of exponential keys -ln(u) / quality, ties by id; the document that crosses the budget
    gives only the words that fit, so a source gives its target to the word.

    No source is sorted as a whole: keys fall into BUCKETS ranges, sums per (source, bucket) locate
    the one bucket where the budget ends, that bucket is cut again in the same way, and only the rows
    of the cut bucket's cut bucket are sorted.

    Null or empty texts have size 0 and give nothing; a null source is a source of its own, last in
    order; missing, zero or negative qualities count as 1, of repeated ones the highest counts. Rows that repeat an id are rows of their
    own, with one key; among them the larger size comes first. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:  # joined with the narrow rows: texts are not shuffled
        known = quality.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("known")).agg(F.max("quality").alias("quality"))
        rows = rows.join(known, F.col("doc_id") == F.col("known"), "left").drop("known")
        weight = F.when(F.col("quality") > 0, F.col("quality").cast("double")).otherwise(weight)
    rows = rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"))
    rows = rows.withColumn("place", (1 - F.exp(-F.col("key"))) * BUCKETS)
    rows = rows.withColumn("b1", F.least(F.floor("place"), F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.withColumn("b2", F.least(F.floor((F.col("place") - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = write_once(rows.drop("place"), "mix-rows")

    first = write_once(rows.groupBy("source", "b1").agg(F.sum("size").alias("words")), "mix-sums")
    plan = source_targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    upto = lambda *order: Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")

    def cut(sums: DataFrame, bucket: str, base: Column) -> DataFrame:
        """The bucket of each source in which the budget ends, and the words taken before it."""
        run = sums.withColumn("before", base + F.coalesce(F.sum("words").over(upto(bucket)), nothing))
        reached = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
        return run.where(reached).groupBy("source").agg(F.min(F.struct(bucket, "before")).alias("at")).select(F.col("source").alias("s"), F.col(f"at.{bucket}").alias(f"cut_{bucket}"), F.col("at.before").alias(f"before_{bucket}"))

    plan = write_once(plan, "mix-plan")
    same = F.col("source").eqNullSafe(F.col("s"))
    one = cut(first.join(plan.select(F.col("source").alias("s"), "rest"), same).drop("s"), "b1", nothing)
    plan = plan.join(one, same, "left").drop("s")
    inside = rows.join(plan.where("cut_b1 IS NOT NULL").select(F.col("source").alias("s"), "cut_b1", "before_b1", "rest"), same & (F.col("b1") == F.col("cut_b1"))).drop("s")
    second = inside.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("before_b1").alias("before_b1"), F.first("rest").alias("rest"))
    two = cut(second, "b2", F.col("before_b1"))
    plan = write_once(plan.join(two, same, "left").drop("s"), "mix-cuts")

    at = F.struct("b1", "b2")
    edge = F.struct(F.col("cut_b1"), F.col("cut_b2"))
    known = rows.join(plan.withColumnRenamed("source", "s"), same, "left").drop("s")
    known = known.withColumn("side", F.when(F.col("cut_b2").isNull(), F.lit(1)).when(at < edge, F.lit(-1)).when(at > edge, F.lit(1)).otherwise(F.lit(0)))
    done = known.where("side <> 0").withColumn("extra", F.when(F.col("side") < 0, F.col("size")).otherwise(nothing))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_b2") + F.coalesce(F.sum("size").over(order), nothing)
    sampled = known.where("side = 0").withColumn("extra", F.least(F.col("size"), F.greatest(nothing, F.col("rest") - start)))
    return done.unionByName(sampled).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def quality_from_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 where labelled good, 0.5 where labelled bad; of repeated labels the highest."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return known.select("doc_id", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("quality"))
