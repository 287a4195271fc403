"""Browsing a sorted term list in pages of twelve rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardamom.plans.numbering import scratch

PAGE_ROWS, MAX_REF = 12, 50
#: Rows that a page needs on either side of a term, at most.
REACH = 2 * PAGE_ROWS


def write_list(terms: DataFrame, path: str) -> None:
    """Writes (code, term, items) sorted, and beside it its directory: what each file holds of each code, and how many terms stand before."""
    spark = terms.sparkSession
    scratch(terms, "terms").repartitionByRange("code", "term").sortWithinPartitions("code", "term").write.parquet(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    held = spark.read.schema("code string, term string, items long").parquet(path).groupBy("code", name.alias("file")).agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("terms"))
    earlier = Window.partitionBy("code").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    held.withColumn("before", F.coalesce(F.sum("terms").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}_directory")


@dataclass(frozen=True)
class Listing:
    """A written list of the terms of a code."""

    spark: SparkSession
    path: str
    code: str

    def around(self, entered: str | None) -> tuple[DataFrame, int, int]:
        """(terms, before, n): the files (term, items) that hold the term's place and REACH rows on either side; terms before these, and in all."""
        own = self.spark.read.schema("code string, file string, first string, last string, terms long, before long").parquet(f"{self.path}_directory").where(F.col("code") == self.code)
        at = F.lit(0) if entered is None else F.coalesce(F.max(F.when(F.col("first") <= entered, F.col("before"))), F.lit(0))
        size = own.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("n"), at.alias("at")).first()
        here = (F.col("before") <= size["at"]) & (F.col("before") + F.col("terms") > size["at"])
        end = own.agg(F.max(F.when(here, F.col("before") + F.col("terms"))).alias("e")).first()["e"] or 0
        near = (F.col("before") + F.col("terms") > size["at"] - REACH) & (F.col("before") < end + REACH)
        files = own.where(near).select("file", "before").collect()  # those that a page reaches into
        rows = self.spark.read.schema("code string, term string, items long")
        rows = rows.parquet(*[f"{self.path}/{f['file']}" for f in files]) if files else self.spark.createDataFrame([], "code string, term string, items long")
        return rows.where(F.col("code") == self.code).select("term", "items"), min((f["before"] for f in files), default=0), size["n"]


def wrapped(ref: int | Column) -> int | Column:
    """Row numbers go from 1 to 50 and begin again."""
    return F.pmod(ref - 1, F.lit(MAX_REF)) + 1 if isinstance(ref, Column) else (ref - 1) % MAX_REF + 1


def _page(rows: DataFrame, first_ref: int, entered: str | None) -> DataFrame:
    place = F.row_number().over(Window.orderBy("term")) - 1  # of a page
    starred = F.lit(False) if entered is None else F.col("term") == entered
    return rows.select(wrapped(F.lit(first_ref) + place).cast("int").alias("ref"), "items", "term", starred.alias("starred"))


def window(terms: DataFrame | Listing, entered: str) -> tuple[int, int, bool]:
    """(start, place of the entered term, absent) over (term, items); only three numbers reach the driver."""
    rows, before, n = terms.around(entered) if isinstance(terms, Listing) else (terms, 0, None)
    s = rows.agg(F.count(F.when(F.col("term") < entered, 1)).alias("at"), F.count("*").alias("n"), F.count(F.when(F.col("term") == entered, 1)).alias("here")).first()
    at, n, absent = s["at"] + before, s["n"] if n is None else n, not s["here"]
    return max(0, min(at - 2, max(0, n + absent - PAGE_ROWS))), at, absent


def view(terms: DataFrame | Listing, entered: str | None, absent: bool, near: str | None = None) -> DataFrame:
    """The list (of a written one the files around ``near``), with an entered term that is not in it at its place."""
    terms = terms.around(near)[0] if isinstance(terms, Listing) else terms
    rows = terms.select("term", F.col("items").cast("long").alias("items"))
    if entered is None or not absent:
        return rows
    return rows.union(terms.sparkSession.createDataFrame([(entered, 0)], "term string, items long"))


def browse(terms: DataFrame | Listing, entered: str | None = None, first_ref: int = 1) -> DataFrame:
    """(ref, items, term, starred): the entered term third, shifted at either end; from the head without a term.

    Of a written list only the files around the term are read; of any other table all rows are counted.
    """
    if entered is None:
        return _page(view(terms, None, False).orderBy("term").limit(PAGE_ROWS), first_ref, None)
    start, at, absent = window(terms, entered)
    rows = view(terms, entered, absent, entered)
    # two short sorted lists around the term: the list is never numbered
    below = rows.where(F.col("term") < entered).orderBy(F.col("term").desc()).limit(at - start)
    above = rows.where(F.col("term") >= entered).orderBy("term").limit(PAGE_ROWS - (at - start))
    return _page(below.union(above), first_ref, entered)


def next_page(terms: DataFrame | Listing, last: str, first_ref: int, entered: str | None = None, absent: bool = False) -> DataFrame:
    """The rows after the last one shown; an inserted term keeps its place, no row is starred."""
    return _page(view(terms, entered, absent, last).where(F.col("term") > last).orderBy("term").limit(PAGE_ROWS), first_ref, None)


def previous_page(terms: DataFrame | Listing, last: str, next_ref: int, entered: str | None = None, absent: bool = False) -> DataFrame:
    """The page that begins 24 rows before the row after ``last``, the last one shown (at the head, if there are fewer)."""
    back = view(terms, entered, absent, last).where(F.col("term") <= last).orderBy(F.col("term").desc()).limit(2 * PAGE_ROWS)
    return _page(back.orderBy("term").limit(PAGE_ROWS), wrapped(next_ref - 2 * PAGE_ROWS), None)
