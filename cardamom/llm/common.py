"""What several operators need: tables in the shared folder, groups of linked ids, columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.plans.numbering import own_folder
from cardamom.plans.numbering import scratch as written

__all__ = ["linked_groups", "own", "own_folder", "table", "unique_name", "word_count", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast and renamed to names that cannot clash with those of the input."""
    return df.select(*[df[c].cast(kind).alias(f"_{c}") for c, kind in columns.items()])


def linked_groups(edges: DataFrame) -> DataFrame:
    """(node, component): for every id in edges (a, b), the smallest id reachable from it.

    Each round, every node takes the neighbour (or itself) whose hash is least,
    edges are renamed by it, and those within one node go: the number of nodes
    falls by a constant factor, whatever the shape of the graph. The rounds'
    renamings are then joined. No node's edges are gathered: minima are
    aggregated before the shuffle, and joins may be split at hot nodes.
    """
    edges = edges.where("a is not null and b is not null")
    every = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))), F.col(c).alias("v"))  # noqa: E731, B023
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        names = written(least.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["v"].alias("to")), "names")
        rounds.append(names)
        e = e.join(names.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        e = e.join(names.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        e = written(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return every.distinct().select("node", F.col("node").alias("component"))
    found = rounds[0]
    for names in rounds[1:]:
        found = found.join(names.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
        found = found.select("node", F.coalesce("next", "to").alias("to"))
    found = written(found, "groups")
    smallest = written(found.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component")), "smallest")
    return found.join(smallest, "to").select("node", "component")


def unique_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it from clashing with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Runs of bytes outside 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
