"""Card-image files: lines of 80 columns and CR LF, records, fields and values.

Columns 1-2 are the tag, 4-72 data. ``$$`` opens a record, ``<<`` and ``>>`` are
the file's first and last line, two blanks continue the field above. A
continuation whose column 4 is MARKER begins a new value in fields that repeat.

Records are read by ``parse.parsed``, in one pass. ``records``, ``classified``,
``fields`` and ``values`` here are a second reader, by windows over lines, which
shares no parsing with it and is held against it (``checks.parity``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.plans.numbering import CHUNK, sorted_ranks
from cardamom.schema import SINGLE_TAGS
from cardamom.sources import store

WIDTH, DATA_AT, DATA_WIDTH = 82, 4, 69
MARKER = 0xAC
#: Lines of a range, which is read and handed on as one batch, and bytes that a task reads.
RANGE, TASK_BYTES = 1 << 15, 128 << 20
#: A heading's code and label are parted by these two characters; a further part may follow.
SEPARATOR = "\u00a0\u0002"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) without reading any content, and so in no more tasks than a shuffle has, whatever the files' size."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    return every.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def misaligned(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).where(F.col("length") % WIDTH != 0)


def lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, line_no, bytes) of the files of a folder; a file whose length is no multiple of 82 is refused.

    A line's number follows from its place, so ranges of whole lines are read
    independently, each at once through pyarrow's file systems (sources/store.py), and no pass only counts lines. most: of each file
    only so many lines, and no more is read.
    """
    every = files(spark, path)
    off = F.col("length") % WIDTH != 0
    size = every.agg(F.min(F.when(off, F.struct("file", "length"))).alias("bad"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size["bad"]:
        raise ValueError(f"{size['bad']['file']}: {size['bad']['length']} bytes are no multiple of {WIDTH}")
    n = (F.col("length") / WIDTH).cast("long")
    cut = every.withColumn("n", n if most is None else F.least(n, F.lit(most).cast("long"))).where("n > 0")
    cut = cut.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))).alias("after"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // TASK_BYTES))
    ranges = cut.select("file", "after", F.least(F.lit(RANGE), F.col("n") - F.col("after")).alias("lines"))
    return ranges.repartition(tasks).mapInArrow(_read, "file string, line_no long, bytes binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of lines for each range (file, lines after which it begins, lines); bytes are cut by width, not line by line."""
    for batch in batches:
        for row in batch.to_pylist():
            system, name = store.opened(row["file"])
            with system.open_input_file(name) as source:
                raw = source.read_at(row["lines"] * WIDTH, row["after"] * WIDTH)
            if len(raw) != row["lines"] * WIDTH:
                raise OSError(f"{row['file']}: ends before line {row['after'] + row['lines']}")
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), row["lines"], [None, pa.py_buffer(raw)]).cast(pa.binary())
            numbers = pa.array(np.arange(row["after"] + 1, row["after"] + row["lines"] + 1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["file"], pa.string()), row["lines"]), numbers, cells], names=["file", "line_no", "bytes"])


def tag(b: str = "bytes") -> Column:
    return text.latin1(F.substring(b, 1, 2))


def bad_lines(df: DataFrame) -> DataFrame:
    """(bad_lines): lines that do not end in CR LF; they are counted, not dropped."""
    return df.agg(F.count(F.when(F.substring("bytes", 81, 2) != F.unhex(F.lit("0D0A")), 1)).alias("bad_lines"))


def structure(df: DataFrame) -> DataFrame:
    """(file, header, trailer): the last << and >> line of each file, trimmed."""
    own = df.where(tag().isin("<<", ">>")).withColumn("t", tag()).withColumn("v", F.rtrim(text.latin1(F.substring("bytes", 1, 80))))
    pick = lambda t: F.max_by(F.when(F.col("t") == t, F.col("v")), F.when(F.col("t") == t, F.col("line_no")))
    return own.groupBy("file").agg(pick("<<").alias("header"), pick(">>").alias("trailer"))


def records(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file, line_no, bytes, ord) of the lines inside records; ord counts from 0 by file and line.

    The last ``$$`` or ``>>`` at or before a line tells whether it is in a record, the number of ``$$`` up to it in which.
    Both run within chunks of a file first, then over a row per chunk, which is merged: lines are made by the thousand
    of a row that Spark counts as one, so that by its sizes it would broadcast any number of them.
    """
    mark = F.when(tag() == "$$", 1).when(tag() == ">>", 0)
    marked = df.withColumns({"mark": mark, "_chunk": F.floor(F.col("line_no") / chunk)})
    opened = F.coalesce(F.sum("mark"), F.lit(0))
    lasts = marked.groupBy("file", "_chunk").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("_last"), opened.alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_last", ignorenulls=True).over(earlier(Window.partitionBy("file").orderBy("_chunk")))
    numbers = F.coalesce(F.sum("_n").over(earlier(Window.orderBy("file", "_chunk"))), F.lit(0))  # a row per chunk
    chunks = lasts.select("file", "_chunk", before.alias("_before"), numbers.alias("_numbers"))
    run = Window.partitionBy("file", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumns({"_own": F.last("mark", ignorenulls=True).over(run), "_up_to": F.coalesce(F.sum("mark").over(run), F.lit(0))})
    inside = own.join(chunks.hint("merge"), ["file", "_chunk"]).where(F.coalesce("_own", "_before") == 1)
    return inside.select("file", "line_no", "bytes", (F.col("_numbers") + F.col("_up_to") - 1).cast("long").alias("ord"))


def spans(recs: DataFrame) -> DataFrame:
    """(ord, file, an, first_line, last_line, offset, length); an is that of the first AN line with anything in columns 4-80, or empty."""
    an = text.trim(text.latin1(F.substring("bytes", 4, 77)))
    has = (tag() == "AN") & (an != "")
    first = F.min_by(F.when(has, an), F.when(has, F.col("line_no")))
    out = recs.groupBy("ord", "file").agg(F.coalesce(first, F.lit("")).alias("an"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return out.withColumns({"offset": text.line_offset(F.col("first_line")), "length": (F.col("last_line") - F.col("first_line") + 1) * WIDTH})


def range_faults(s: DataFrame) -> DataFrame:
    """(ord, fault) of records whose lines are inverted, whose length is not whole, or that overlap the next of their file.

    Records are numbered in ranges of file and line, and each meets the next by its number.
    """
    n = sorted_ranks(s.select("ord", "file", "first_line", "last_line", "length"), F.col("file"), F.col("first_line"), F.col("ord"))
    after = n.select((F.col("rank") - 1).alias("before"), F.col("file").alias("own"), F.col("first_line").alias("later"))
    n = n.join(after, (F.col("rank") == F.col("before")) & (F.col("file") == F.col("own")), "left")
    fault = F.when(F.col("last_line") < F.col("first_line"), "inverted").when(F.col("length") % WIDTH != 0, "short").when(F.col("later") <= F.col("last_line"), "overlap")
    return n.select("ord", fault.alias("fault")).where("fault is not null")


def unknown(ordinals: DataFrame, s: DataFrame) -> DataFrame:
    """(ord) of ordinals asked for that no record has."""
    return ordinals.select("ord").distinct().join(s.select("ord"), "ord", "left_anti")


def classified(recs: DataFrame) -> DataFrame:
    """recs with kind (separator, continuation, tag), tag, and field_seq: 0 for lines before the first tagged one."""
    kind = F.when(tag() == "$$", "separator").when(tag() == "  ", "continuation").otherwise("tag")
    df = recs.withColumns({"kind": kind, "tag": tag()})
    by = Window.partitionBy("ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("field_seq", F.sum(F.when(F.col("kind") == "tag", 1).otherwise(0)).over(by))


def orphans(cl: DataFrame) -> DataFrame:
    """(ord, line_no) of continuations that continue nothing."""
    return cl.where("kind = 'continuation' and field_seq = 0").select("ord", "line_no")


def fields(cl: DataFrame) -> DataFrame:
    """(ord, field_seq, tag, line_start, line_end, offset, length)."""
    f = cl.where("field_seq > 0 and kind <> 'separator'").groupBy("ord", "field_seq").agg(F.min_by("tag", "line_no").alias("tag"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    return f.withColumns({"offset": text.line_offset(F.col("line_start")), "length": (F.col("line_end") - F.col("line_start") + 1) * WIDTH})


def values(cl: DataFrame, percent_in_block: bool = False, marker: int = MARKER, singles: tuple[str, ...] = SINGLE_TAGS) -> DataFrame:
    """(ord, tag, field_seq, value_seq, raw, raw_bytes, code, label, percent, line, offset, continuation).

    Chunks of a value are put together with nothing between; blanks at its end
    go once. The marker begins a value only in tags that repeat, and is dropped there.
    """
    df = cl.where("field_seq > 0 and kind <> 'separator'")
    by_field = Window.partitionBy("ord", "field_seq")
    df = df.withColumn("field_tag", F.first("tag").over(by_field.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    data = text.latin1(F.substring("bytes", DATA_AT, DATA_WIDTH))
    opens = (F.col("kind") == "continuation") & F.startswith(data, F.lit(chr(marker))) & ~F.col("field_tag").isin(*singles)
    df = df.withColumns({"opens": opens, "chunk": F.when(opens, F.substr(data, F.lit(2))).otherwise(data)})
    running = by_field.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("value_seq", F.sum(F.col("opens").cast("int")).over(running))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "chunk")))  # the lines of one value
    v = df.groupBy("ord", "field_seq", "value_seq").agg(F.min("field_tag").alias("tag"), parts.alias("parts"), F.min("line_no").alias("line"), F.bool_or("opens").alias("continuation"))
    whole = F.rtrim(F.array_join(F.transform("parts", lambda p: p["chunk"]), ""))
    v = v.withColumn("latin", whole).withColumn("raw", text.trim_end(F.col("latin"))).withColumn("raw_bytes", F.encode("latin", "ISO-8859-1"))
    has, cut = F.contains("raw", F.lit(SEPARATOR)), F.split("raw", SEPARATOR, 3 if percent_in_block else 2)
    third = F.when(has, F.trim(F.get(cut, F.lit(2)))) if percent_in_block else F.lit(None).cast("string")
    return v.select(
        "ord", "tag", "field_seq", "value_seq", "raw", "raw_bytes",
        F.when(has, text.trim_end(F.get(cut, F.lit(0)))).alias("code"), F.when(has, text.trim_end(F.get(cut, F.lit(1)))).alias("label"), third.alias("percent"),
        "line", text.line_offset(F.col("line")).alias("offset"), "continuation",
    )


def strict_heading(raw: Column, most: int = 2) -> Column:
    """(parts, problem): split at every U+0002; 2 to ``most`` parts, all but the last ending in U+00A0."""
    parts = F.split(raw, "\u0002", -1)
    heads = F.slice(parts, 1, F.size(parts) - 1)
    ok = F.size(parts).between(2, most) & F.forall(heads, lambda p: F.endswith(p, F.lit("\u00a0")))
    clean = F.concat(F.transform(heads, lambda p: F.substr(p, F.lit(1), F.length(p) - 1)), F.slice(parts, -1, 1))
    return F.struct(F.when(ok, clean).alias("parts"), F.when(~ok, F.concat(F.lit("parts: "), F.size(parts).cast("string"))).alias("problem"))


def trailer_check(df: DataFrame, recs: DataFrame) -> DataFrame:
    """(declared_lines, lines, declared_records, records) from the trailer (columns 4-12 and 13-21) and the file."""
    v = text.latin1(F.col("bytes"))
    t = df.where(tag() == ">>").agg(F.max(F.substring(v, 4, 9).try_cast("long")).alias("declared_lines"), F.max(F.substring(v, 13, 9).try_cast("long")).alias("declared_records"))
    n = df.where(~tag().isin("<<", ">>")).agg(F.count("*").alias("lines"))
    return t.join(n).join(recs.agg(F.countDistinct("ord").alias("records")))  # one row each


def provenance(file: Column) -> Column:
    """(record_group, fiscal_year) from a file's base name: leading RGnnn, first FYdd that no digit follows."""
    base = F.element_at(F.split(file, "/"), -1)
    return F.struct(F.nullif(F.regexp_extract(base, r"^(RG\d{3})", 1), F.lit("")).alias("record_group"), F.nullif(F.regexp_extract(base, r"FY(\d{2})(?!\d)", 1), F.lit("")).try_cast("int").alias("fiscal_year"))


def name_in(path: str, file: Column) -> Column:
    """The part of a file's path below the folder."""
    return F.element_at(F.split(file, "/" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", 2), -1)


def digests(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, length, sha256) of the files of a folder and those below it, by their path in it (whole: as Spark names it).

    The digest of a file follows from its bytes in order, so a task streams each
    file, whatever its size, through pyarrow's file systems (sources/store.py).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("file").to_pylist():
                system, name = store.opened(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(1 << 22):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("length"), pa.array(found, pa.string())], names=["file", "length", "sha256"])

    every = files(spark, path)
    out = every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(run, "file string, length long, sha256 string")
    return out if whole else out.withColumn("file", name_in(path, F.col("file")))


def fixity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, ok): length and SHA-256 of each file against a manifest (file, length, sha256); a file that is not there is not ok."""
    own = digests(spark, path).select("file", F.col("length").alias("n"), F.col("sha256").alias("sha"))
    same = (F.col("n") == F.col("length")) & (F.col("sha") == F.col("sha256"))
    return manifest.join(own, "file", "left").select("file", F.coalesce(same, F.lit(False)).alias("ok"))


def line(label: str, data: Column) -> Column:
    """One line without its CR LF."""
    return F.rpad(F.substring(F.concat(F.lit(label + " "), data), 1, DATA_AT - 1 + DATA_WIDTH), WIDTH - 2, " ")


def write(records: DataFrame, path: str) -> None:
    """Writes records (part, text), which come in order of both, as a folder of one file for each part; casting bytes to a string keeps them."""
    rows = records.select("part", F.encode("text", "ISO-8859-1").cast("string").alias("value"))
    rows.write.partitionBy("part").option("lineSep", "\r\n").text(path)
