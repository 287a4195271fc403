"""Keywords in context: windows of words around matches, merged where they meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.operators import checks, search
from cardamom.plans.numbering import scratch

SIZE, LEAST, MOST = 30, 2, 50
#: Fields in the order in which their windows are shown.
FIELDS = ("TI", "AP", "OB", "PR", "DE", "PB")


def terms_of(e) -> tuple[list[str], list[str]]:
    """(words, stems) of an expression; phrases, sets and proximity operands, at any depth, have none."""
    if isinstance(e, search.And | search.Or | search.Not):
        (w1, s1), (w2, s2) = terms_of(e.a), terms_of(e.b)
        return w1 + w2, s1 + s2
    return [e.value.upper()] if isinstance(e, search.Word) else [], [e.stem.upper()] if isinstance(e, search.Prefix) else []


_KEY = ["ord", "tag", "field_seq", "value_seq"]
_STORED = "key string, ord long, field_seq int, value_seq long, at array<int>"


def _words(raw: str = "raw") -> Column:
    """The words of a value as they are shown; a value without any has one empty word."""
    return F.split(text.spaced(F.col(raw)), " ")


def places(vals: DataFrame, tasks: int | None = None) -> DataFrame:
    """(tag, key, ord, field_seq, value_seq, at): where the words of each value, cut at white space and reduced to letters and digits, stand in it.

    Values are reduced whole and only then cut. They are dealt out first, so that gathering the places of a word shuffles nothing more.
    tasks: among how many values are dealt out, so that the words of one can be sorted in memory.
    """
    v = vals.select("ord", "tag", "field_seq", F.col("value_seq").cast("long").alias("value_seq"), "raw").repartition(*([] if tasks is None else [tasks]), "ord", "tag", "field_seq", "value_seq")
    v = v.select("ord", "tag", "field_seq", "value_seq", F.posexplode_outer(F.split(text.reduced(text.spaced(F.col("raw"))), " ")).alias("i", "key")).where("key <> ''")
    return v.groupBy("ord", "tag", "field_seq", "value_seq", "key").agg(F.sort_array(F.collect_list("i")).alias("at")).select("tag", "key", "ord", "field_seq", "value_seq", "at")


def write(found: DataFrame, path: str, tasks: int | None = None) -> None:
    """A folder per tag and first character of the key, sorted by key. tasks: how many sort it."""
    rows = scratch(found.withColumn("shard", text.shard(F.col("key"))), "contexts")
    order = ["tag", "shard", "key", "ord"]
    rows.repartitionByRange(*([] if tasks is None else [tasks]), *order).sortWithinPartitions(*order).write.partitionBy("tag", "shard").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return checks.loaded(spark, path, _STORED, "tag string, shard string")


def _meant(words: list[str], stems: list[str], sharded: bool) -> Column:
    """Which keys are meant; of a table with shards also which shards, which are folders."""
    hits = [F.col("key").isin(*words)] if words else []
    hits += [F.col("key").startswith(s) for s in stems]
    if sharded and "" not in stems and (words or stems):
        return F.col("shard").isin(*sorted({text.shard_of(w) for w in [*words, *stems] if w})) & reduce(lambda a, b: a | b, hits)
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _span(i: Column, n: Column, before: int, after: int) -> Column:
    """(start, stop) of the window around word i of n: moved back past the front, then forward past the end."""
    low, end = i - before, n - 1
    high = i + after + F.greatest(F.lit(0), -low)
    start = F.greatest(F.lit(0), F.greatest(F.lit(0), low) - F.greatest(F.lit(0), high - end))
    return F.struct(start.alias("start"), F.least(high, end).alias("stop"))


def _merged(spans: str) -> Column:
    """Windows that overlap or touch as one. Starts and stops both rise with the place, so only neighbours have to be looked at."""
    apart = lambda a, b: F.coalesce(b["start"] > a["stop"] + 1, F.lit(True))  # none before the first, none behind the last
    begins = F.filter(spans, lambda x, i: apart(F.get(F.col(spans), i - 1), x))
    ends = F.filter(spans, lambda x, i: apart(x, F.get(F.col(spans), i + 1)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))


def windows(vals: DataFrame, words: list[str], stems: list[str] = (), size: int = SIZE, stored: DataFrame | None = None) -> DataFrame:
    """(ord, tag, field_seq, value_seq, start, window) of values (ord, tag, field_seq, value_seq, raw).

    One word more before the match than after it where size is even; windows are
    shifted at the ends of the value and merged where they overlap or touch.
    Without words and stems there are no windows. stored: the places of words
    (``opened``); the values are then opened only where something matches.
    """
    if not LEAST <= size <= MOST:
        raise ValueError(f"a window has {LEAST} to {MOST} words")
    before, after = size // 2, (size - 1) // 2
    table = places(vals) if stored is None else stored
    m = table.where(_meant(list(words), list(stems), stored is not None))
    m = m.groupBy(*_KEY).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    m = scratch(m, "windows") if stored is not None else m  # so small a side is joined as it is
    out = m.join(vals.select("ord", "tag", "field_seq", F.col("value_seq").cast("long").alias("value_seq"), "raw"), _KEY)
    out = out.select(*_KEY, "at", _words().alias("words"))  # once for a value, however many windows it has
    out = out.select(*_KEY, "words", F.transform("at", lambda i: _span(i, F.size("words"), size // 2, (size - 1) // 2)).alias("each"))
    shown = lambda x: F.concat(F.when(x["start"] > 0, "... ").otherwise(""), F.array_join(F.slice("words", x["start"] + 1, x["stop"] - x["start"] + 1), " "), F.when(x["stop"] < F.size("words") - 1, " ...").otherwise(""))
    out = out.select(*_KEY, "words", _merged("each").alias("spans"))
    return out.select(*_KEY, F.inline(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), shown(x).alias("window")))))


def of_set(vals: DataFrame, current: DataFrame, e, size: int = SIZE, fields: tuple[str, ...] = FIELDS, stored: DataFrame | None = None) -> DataFrame:
    """Windows over the records of a slice (ord, rank), with rank and place of the field; stored: as in ``windows``."""
    words, stems = terms_of(e)
    own = vals.where(F.col("tag").isin(*fields)).join(current.select("ord"), "ord", "left_semi")
    place = F.array_position(F.array(*[F.lit(t) for t in fields]), F.col("tag")).alias("field_place")
    if stored is not None:
        stored = stored.where(F.col("tag").isin(*fields)).join(current.select("ord"), "ord", "left_semi")
    return windows(own, words, stems, size, stored).join(current.select("ord", "rank"), "ord").select("rank", "ord", place, "tag", "value_seq", "start", "window")
