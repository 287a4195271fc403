"""Mixing sources to target weights by repeating documents.

Sizes are summed per source; targets share a total by weight, none above
``most`` times its source; a document then appears floor(rate) times, and once
more with probability frac(rate), drawn from a hash of seed and doc_id (of the
text where there is no doc_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardamom.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. The targets are
    min(most * size, level * weight) with the level at which they add up to
    share times all sizes (or to the most there is). The table has a row per
    source, however many documents there are; only one row of sums at a time
    reaches the driver. A source of size 0 has target and rate 0.
    """
    # ids by range partition: no window over all sources in one task
    ordered = sizes.select("source", F.col("source_size").cast("long").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last())
    ordered = written(ordered.sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sources")
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # a row per partition
    before, seen = {}, 0
    for part in sorted(counts):
        before[part] = seen
        seen += counts[part]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    place = offset + F.col("at") - F.col("part").cast("long") * (1 << 33)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = written(ordered.select("source", "source_size", weight.alias("weight")), "weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, None
    while True:
        held = F.lit(False) if full is None else F.col("source_size") * most <= F.col("weight") * full
        s = weighed.agg(F.sum(F.when(held, F.col("source_size") * most).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not s["free"]:
            level = float("inf") if total else 0.0
            break
        level = (share * total - s["held"]) / s["free"]
        if full is not None and level <= full:
            break
        full = level
    target = F.least(F.col("source_size") * most, F.col("weight") * F.lit(level)) if level != float("inf") else F.col("source_size") * most
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return weighed.withColumn("target", target).withColumn("rate", rate)


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from seed and doc_id alone, or from the text where doc_id is null."""
    null = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), null)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def copies(rate: Column, drawn: Column) -> Column:
    return F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")


def _goals(sized: DataFrame, **options) -> DataFrame:
    """(s, source_size, target, rate), written first, so that a join with it may split a hot source."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    return written(goal.select(F.col("source").alias("s"), "source_size", "target", "rate"), "targets")


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs.

    size: words of the text, null has none. A null source is one source. Rows
    with equal doc_id, or with null doc_id and equal texts, draw the same
    number. Reruns give the same rows. An empty table has no rows. Other columns
    are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), draw(seed).alias("drawn"))
    sized = written(sized, "sized")
    out = sized.join(_goals(sized, weights=weights, share=share, most=most), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("drawn")).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, columns (of any names) unchanged; see ``planned``."""
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # rates per source, then each row repeats itself: the texts are not shuffled by document
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("of"), draw(seed).alias("drawn"))
    out = rows.join(_goals(sized, weights=weights, share=share, most=most), F.col("of").eqNullSafe(F.col("s")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), copies(F.col("rate"), F.col("drawn")).cast("int")))).select("row.*")


def total_by_source(plan: DataFrame) -> DataFrame:
    """(source, source_size, target, taken) to compare what the mix takes with its targets."""
    return plan.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))

