"""Chat logs: snapshots that prefix a longer conversation go, the rest is rendered.

Every turn gets a rolling hash of the turns up to it. It is a sum of hashes of
(place, role, text), so that a long conversation is summed in chunks. A
conversation whose last rolling hash is that of a turn inside a longer one is a
snapshot of it; of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardamom.llm.common import written

#: Turns summed in one window; offsets of chunks are summed apart.
CHUNK = 256
#: Characters of a text in the bounds of ranges.
BOUND = 256


def _lanes(place: Column) -> list[Column]:
    """Two numbers of 47 bits for a turn at its place; sums of 65,000 turns stay in a long."""
    digest = F.sha2(F.to_json(F.struct(place.alias("p"), "role", "text"), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(digest, 1 + 12 * i, 11), 16, 10).cast("decimal(38,0)") for i in (0, 1)]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text) with places from 0 by turn; see ``collapsed`` for ties and nulls.

    Rows are numbered over the whole table in ranges of (conv_id, turn, role,
    text), with an offset for each partition, and from the first of their conversation: no
    conversation is in one task, whatever its turns are. Bounds of the ranges
    hold the first BOUND characters of a text.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    t = t.where("conv_id is not null").distinct().repartitionByRange(*order, F.substring("text", 1, BOUND)).sortWithinPartitions(*order, "text")
    t = written(t.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    sizes = t.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    sizes = written(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    number = F.col("before") + F.col("at") - F.col("part").cast("long") * (1 << 33)
    t = t.join(F.broadcast(sizes), "part").withColumn("number", number)
    firsts = written(t.groupBy("conv_id").agg(F.min("number").alias("first")), "firsts")
    return t.join(firsts, "conv_id").select("conv_id", "turn", (F.col("number") - F.col("first")).alias("place"), "role", "text")


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2) from turns: the rolling hash of each turn and those before it."""
    a, b = _lanes(F.col("place"))
    t = placed.select("conv_id", "place", F.floor(F.col("place") / CHUNK).alias("chunk"), a.alias("a"), b.alias("b"))
    t = written(t, "turns")
    sums = t.groupBy("conv_id", "chunk").agg(F.sum("a").alias("a0"), F.sum("b").alias("b0"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv_id", "chunk", F.coalesce(F.sum("a0").over(earlier), zero).alias("a0"), F.coalesce(F.sum("b0").over(earlier), zero).alias("b0"))
    own = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "chunk", "place", F.sum("a").over(own).alias("a"), F.sum("b").over(own).alias("b"))
    return t.join(sums, ["conv_id", "chunk"]).select("conv_id", "place", (F.col("a") + F.col("a0")).cast("string").alias("h1"), (F.col("b") + F.col("b0")).cast("string").alias("h2"))


def collapsed(conversations: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, kept) for every conversation.

    Not kept: a conversation all of whose turns (role and text, in order) begin
    a longer one, or which equals one of a smaller conv_id. Turns are ordered by
    turn (null first), role and text; repeated rows count once. Null roles and
    texts equal only nulls. Rows without a conv_id belong to no conversation and
    are left out. placed: the turns of conversations, where the caller has them.
    """
    p = written(prefixes(turns(conversations) if placed is None else placed), "prefixes")
    ends = p.groupBy("conv_id").agg(F.max("place").alias("place"))
    last = written(p.join(ends, ["conv_id", "place"]), "lasts")
    # a prefix inside a conversation: at a place before its last
    inside = p.join(last.select("conv_id", F.col("place").alias("end")), "conv_id").where("place < end").select("place", "h1", "h2").distinct()
    first = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    whole = first.join(inside, ["place", "h1", "h2"], "left_anti").select("conv_id", F.lit(True).alias("kept"))
    return last.join(written(whole, "maximal"), "conv_id", "left").select("conv_id", (F.col("place") + 1).alias("n_turns"), F.coalesce("kept", F.lit(False)).alias("kept"))


def rendered(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, kept, chat): collapsed, with each kept conversation as one text, null for others.

    A turn is begin, role, line end, text, end, line end; null role and text are empty.
    A kept conversation is gathered in one row, so its text has to fit one.
    """
    placed = turns(conversations)
    states = written(collapsed(conversations, placed), "states")
    t = placed.join(states.where("kept").select("conv_id"), "conv_id", "left_semi")
    said = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    text = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("all"))
    text = text.select("conv_id", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("chat"))
    return states.join(text, "conv_id", "left").select("conv_id", "n_turns", "kept", "chat")

