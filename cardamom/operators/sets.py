"""Numbered sets of records: combining, listing, sorting, slicing, ranking their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.plans.numbering import sorted_ranks
from cardamom.schema import SORTABLE

RANK_PAGE = 8


def result(ids: DataFrame) -> DataFrame:
    """(ord, rank): ascending by ordinal."""
    return sorted_ranks(ids.select("ord"), F.col("ord"))


def combine(sets: DataFrame, first: int, last: int, op: str) -> DataFrame:
    """(ord): sets first to last of (set_id, ord) folded from the left by AND, OR or NOT."""
    if first > last:
        raise ValueError("the range of sets is reversed")
    own = sets.where(F.col("set_id").between(first, last))
    if op == "OR":
        return own.select("ord").distinct()
    per = own.select("set_id", "ord").distinct().groupBy("ord").agg(F.count("*").alias("n"), F.min("set_id").alias("low"))
    if op == "AND":
        return per.where(F.col("n") == last - first + 1).select("ord")
    if op == "NOT":  # in the first and in no other
        return per.where((F.col("n") == 1) & (F.col("low") == first)).select("ord")
    raise ValueError(f"unknown operator: {op}")


def listed(sets: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(set_id, items), all or of a range of numbers."""
    if first is not None:
        sets = sets.where(F.col("set_id").between(first, last if last is not None else first))
    return sets.groupBy("set_id").agg(F.count("*").alias("items"))


def first_keys(phrases: DataFrame, code: str) -> DataFrame:
    """(ord, key): the least term of each record under a code."""
    return phrases.where(F.col("code") == code).groupBy("ord").agg(F.min("term").alias("key"))


def sorted_set(current: DataFrame, phrases: DataFrame, keys: list[tuple[str, bool]], sortable: tuple[str, ...] = SORTABLE) -> DataFrame:
    """(ord, rank) of (ord, rank) by [(code, descending), ...]; a record without a key sorts as empty, ties keep their order.

    phrases: (ord, term, code). All keys of a record come from one aggregation, and
    from a table bucketed by ord without an exchange of it.
    """
    for code, _ in keys:
        if code not in sortable:
            raise ValueError(f"not a sortable field: {code}")
    df, order = current.select("ord", F.col("rank").alias("_was")), []
    if keys:
        least = [F.min(F.when(F.col("code") == code, F.col("term"))).alias(f"_k{i}") for i, (code, _) in enumerate(keys)]
        df = df.join(phrases.where(F.col("code").isin(*{c: None for c, _ in keys})).groupBy("ord").agg(*least), "ord", "left")
    for i, (_, descending) in enumerate(keys):
        key = F.coalesce(F.col(f"_k{i}"), F.lit(""))
        order.append(key.desc() if descending else key.asc())
    return sorted_ranks(df, *order, F.col("_was").asc()).select("ord", "rank")


def parse_items(items: str) -> list[tuple[int, int]]:
    """1,3-5 as ranges; a reversed range is refused."""
    out = []
    for part in items.split(","):
        low, _, high = part.strip().partition("-")
        pair = (int(low), int(high or low))
        if pair[0] > pair[1] or pair[0] < 1:
            raise ValueError(f"not a range of items: {part}")
        out.append(pair)
    return out


def sliced(current: DataFrame, items: str) -> DataFrame:
    """The rows of (ord, rank) whose rank is asked for; those past the end are not there."""
    ranges = [F.col("rank").between(a, b) for a, b in parse_items(items)]
    return current.where(reduce(lambda a, b: a | b, ranges))


def order_count(current: DataFrame, items: str) -> DataFrame:
    """(ordered): how many items an order for them takes, cut at the end of the set."""
    return sliced(current, items).agg(F.count("*").alias("ordered"))


def value_counts(phrases: DataFrame, code: str, ids: DataFrame) -> DataFrame:
    """(term, items): records of the set per value of a code."""
    return phrases.where(F.col("code") == code).join(ids.select("ord"), "ord", "left_semi").groupBy("term").agg(F.count("*").alias("items"))


def top_values(counts: DataFrame, page: int = RANK_PAGE) -> DataFrame:
    """(rank, items, term): most records first, then by term; a page of them."""
    top = counts.orderBy(F.col("items").desc(), "term").limit(page)
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(F.col("items").desc(), "term")).alias("rank"), "items", "term")  # of a page
