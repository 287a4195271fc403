"""Card files in one pass: records with their fields and values, parsed where their lines are read.

Files are cut into ranges of whole lines. The records of a range are those that
open in it: a task looks for its first ``$$`` and reads on past the end of the
range to the mark that closes its last record, so records that cross ranges are
whole, and nothing is shuffled. A record's number is its place in its range plus
the records of all ranges before, which a first look at the tags has counted.
Each range is parsed as arrays of lines, not line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.plans.numbering import carried, running_total, scratch
from cardamom.schema import SINGLE_TAGS
from cardamom.sources import store
from cardamom.sources.cards import DATA_AT, DATA_WIDTH, MARKER, RANGE, SEPARATOR, TASK_BYTES, WIDTH, files

#: Lines read at a time past the end of a range.
AHEAD = 1 << 10
_OPEN, _CLOSE, _HEAD, _BLANK, _AN = (int.from_bytes(t, "big") for t in (b"$$", b">>", b"<<", b"  ", b"AN"))
#: White space of trimmed text that Latin-1 can hold.
_TRIMMED = "\t\n\x0b\x0c\r \xa0"

_FIELD = pa.struct([("field_seq", pa.int32()), ("tag", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64())])
_VALUE = pa.struct([("tag", pa.string()), ("field_seq", pa.int32()), ("value_seq", pa.int32()), ("raw_bytes", pa.binary()), ("line", pa.int64()), ("continuation", pa.bool_())])
_RECORD = pa.schema(
    [
        ("ord", pa.int64()), ("file", pa.string()), ("an", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("length", pa.int64()), ("error", pa.string()),
        ("separators", pa.int64()), ("continuations", pa.int64()), ("tags", pa.int64()), ("orphans", pa.list_(pa.int64())), ("fields", pa.list_(_FIELD)), ("vals", pa.list_(_VALUE)),
    ]
)
RECORD = (
    "ord long, file string, an string, first_line long, last_line long, length long, error string, separators long, continuations long, tags long, orphans array<long>,"
    "fields array<struct<field_seq:int,tag:string,line_start:long,line_end:long>>, vals array<struct<tag:string,field_seq:int,value_seq:int,raw_bytes:binary,line:long,continuation:boolean>>"
)
RANGES = "file string, after long, lines long, tail long, records long, marks long, bad_lines long, header_line long, header string, trailer_line long, trailer string"


def _lines(source, after: int, n: int, file: str) -> np.ndarray:
    raw = source.read_at(n * WIDTH, after * WIDTH)
    if len(raw) != n * WIDTH:
        raise OSError(f"{file}: ends before line {after + n}")
    return np.frombuffer(raw, np.uint8).reshape(n, WIDTH)


def _tags(m: np.ndarray) -> np.ndarray:
    return m[:, 0].astype(np.uint16) << 8 | m[:, 1]


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and marks of each range."""
    names = [c.split()[0] for c in RANGES.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            system, name = store.opened(r["file"])
            with system.open_input_file(name) as source:
                m = _lines(source, r["after"], r["lines"], r["file"])
            tags, row = _tags(m), dict(r)
            row["records"] = int((tags == _OPEN).sum())
            row["marks"] = int(((tags == _HEAD) | (tags == _CLOSE)).sum())
            row["bad_lines"] = int(((m[:, 80] != 13) | (m[:, 81] != 10)).sum())
            for mark, what in ((_HEAD, "header"), (_CLOSE, "trailer")):
                at = np.flatnonzero(tags == mark)
                row[f"{what}_line"] = r["after"] + int(at[-1]) + 1 if len(at) else None
                row[what] = m[at[-1], :80].tobytes().decode("latin-1").rstrip(" ") if len(at) else None
            rows.append(row)
        kinds = {"string": pa.string(), "long": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds[c.split()[1]]) for n, c in zip(names, RANGES.split(", "), strict=True)], names=names)


def ranges(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(file, after, lines, tail, records, marks, bad_lines, header_line, header, trailer_line, trailer, before) of the files of a folder.

    A row per range of lines: how many follow which line, the records that open in
    it and before it, << and >> lines and the last of each, lines that do not end in CR LF.
    A file whose length is no whole number of lines is refused; lenient: tail is
    what its last range has left over. A folder without lines has no ranges.
    """
    every = files(spark, path)
    size = every.agg(F.min(F.when(F.col("length") % WIDTH != 0, F.struct("file", "length"))).alias("bad"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size["bad"] and not lenient:
        raise ValueError(f"{size['bad']['file']}: {size['bad']['length']} bytes are no multiple of {WIDTH}")
    n = F.floor(F.col("length") / WIDTH)
    cut = every.where(n > 0).select("file", n.alias("n"), (F.col("length") % WIDTH).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RANGE).cast("long"))).alias("after"))
    left = F.col("n") - F.col("after")
    cut = cut.select("file", "after", F.least(F.lit(RANGE), left).cast("long").alias("lines"), F.when(left <= RANGE, F.col("rest")).otherwise(0).cast("long").alias("tail"))
    seen = cut.repartition(_tasks(spark, size["bytes"])).mapInArrow(_looked_at, RANGES)
    return running_total(seen, [F.col("file"), F.col("after")], "records", "before")


def _tasks(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def tag_names(tags: np.ndarray) -> pa.Array:
    kinds, at = np.unique(tags, return_inverse=True)
    return pa.array([int(k).to_bytes(2, "big").decode("latin-1") for k in kinds], pa.string()).take(pa.array(at.ravel()))


def _list(parts: pa.Array, record: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(record, np.arange(n + 1)).astype(np.int32)), parts)


def records_of(m: np.ndarray, after: int, file: str, first: int, tail: int, marker: int, single: np.ndarray) -> pa.RecordBatch:
    """The records of lines m (those after line ``after``): m begins anywhere and ends where its last record does."""
    tags = _tags(m)
    opens_record, closes = tags == _OPEN, tags == _CLOSE
    last = np.maximum.accumulate(np.where(opens_record | closes, np.arange(len(m)), -1)) if len(m) else np.zeros(0, np.int64)
    inside = np.flatnonzero((last >= 0) & opens_record[last])
    m, tags, opens_record, line = m[inside], tags[inside], opens_record[inside], inside + after + 1
    record, start = np.cumsum(opens_record) - 1, np.flatnonzero(opens_record)
    n = len(start)
    blank = tags == _BLANK
    tagged = ~blank & ~opens_record
    field = np.cumsum(tagged)
    field_seq = field - field[start][record] if n else field
    lost = blank & (field_seq == 0)
    body = np.flatnonzero((tagged | blank) & (field_seq > 0))
    opener = np.flatnonzero(tagged)
    # lines of fields from here on
    b_tagged, b_record, b_line, b_seq = tagged[body], record[body], line[body], field_seq[body]
    b_tag = tags[opener][field[body] - 1] if len(body) else tags[:0]
    marked = ~b_tagged & (m[body, DATA_AT - 1] == marker) & ~single[b_tag]
    begins = np.flatnonzero(b_tagged | marked)
    data = m[body, DATA_AT - 1 : DATA_AT - 1 + DATA_WIDTH]
    keep = np.ones(data.shape, bool)
    keep[marked, 0] = False
    value = np.cumsum(b_tagged | marked) - 1
    if len(body):
        place = np.arange(data.size).reshape(data.shape)
        end = np.maximum.reduceat(np.where(keep & (data != 0x20), place, -1).max(axis=1), begins)
        keep &= place <= end[value][:, None]
        sizes = np.add.reduceat(keep.sum(axis=1), begins)
        more = np.cumsum(marked)
        value_seq = (more - more[np.flatnonzero(b_tagged)][np.cumsum(b_tagged) - 1])[begins]
        field_begins = np.flatnonzero(b_tagged)
        field_ends = np.append(field_begins[1:], len(body)) - 1
    else:
        sizes = value_seq = field_begins = field_ends = np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    values = pa.StructArray.from_arrays([tag_names(b_tag[begins]), pa.array(b_seq[begins].astype(np.int32)), pa.array(value_seq.astype(np.int32)), raw, pa.array(b_line[begins]), pa.array(marked[begins])], fields=list(_VALUE))
    fields = pa.StructArray.from_arrays([pa.array(b_seq[field_begins].astype(np.int32)), tag_names(b_tag[field_begins]), pa.array(b_line[field_begins]), pa.array(b_line[field_ends])], fields=list(_FIELD))
    accession = [""] * n
    for i in np.flatnonzero(tags == _AN)[::-1].tolist():
        accession[record[i]] = m[i, 3:80].tobytes().decode("latin-1").strip(_TRIMMED) or accession[record[i]]
    count = lambda flags: pa.array(np.bincount(record[flags], minlength=n).astype(np.int64))
    first_line = line[start]
    last_line = line[np.append(start[1:], len(line)) - 1] if n else first_line
    length = (last_line - first_line + 1) * WIDTH
    error: list[str | None] = [None] * n
    if tail and n:  # what is left of the file belongs to its last record, unless that is closed
        length[-1] += tail
        error[-1] = f"bytes: {length[-1]}"
    arrays = [
        pa.array(np.arange(first, first + n)), pa.repeat(pa.scalar(file, pa.string()), n), pa.array(accession, pa.string()), pa.array(first_line), pa.array(last_line), pa.array(length), pa.array(error, pa.string()),
        count(opens_record), count(blank), count(tagged), _list(pa.array(line[lost]), record[lost], n), _list(fields, b_record[field_begins], n), _list(values, b_record[begins], n),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_RECORD)


def _parsed(marker: int, singles: tuple[str, ...]):
    single = np.zeros(1 << 16, bool)
    single[[int.from_bytes(t.encode("latin-1"), "big") for t in singles]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, name = store.opened(r["file"])
                with system.open_input_file(name) as source:
                    m = _lines(source, r["after"], r["lines"], r["file"])
                    marks = np.flatnonzero((_tags(m) == _OPEN) | (_tags(m) == _CLOSE))
                    ahead, at, end = [m], r["after"] + r["lines"], r["total"] // WIDTH
                    going = bool(len(marks)) and _tags(m[marks[-1:]])[0] == _OPEN
                    while going and at < end:
                        more = _lines(source, at, min(AHEAD, end - at), r["file"])
                        stops = np.flatnonzero((_tags(more) == _OPEN) | (_tags(more) == _CLOSE))
                        going = not len(stops)
                        ahead.append(more[: stops[0]] if len(stops) else more)
                        at += len(more)
                tail = r["total"] % WIDTH if going else 0
                yield records_of(np.concatenate(ahead) if len(ahead) > 1 else m, r["after"], r["file"], r["before"], tail, marker, single)

    return run


def parsed(spark: SparkSession, path: str, lenient: bool = False, marker: int = MARKER, singles: tuple[str, ...] = SINGLE_TAGS, found: DataFrame | None = None) -> DataFrame:
    """A row for each record of the card files of a folder: its place, and its fields and values as arrays.

    ord counts from 0 by file and line; an is that of the first AN line with
    anything in columns 4-80, or empty; lines before the first and after a closing
    mark belong to no record. orphans: lines of continuations that continue
    nothing. A record that a file's end cuts off inside of a line has an error if
    ``lenient``; otherwise its file is refused. singles: tags in which the marker
    is data. found: what ``ranges`` gave for the folder. Rows of a partition are in
    order of ord, and partitions hold consecutive records.
    """
    cut = found if found is not None else ranges(spark, path, lenient)
    total = files(spark, path).select("file", F.col("length").alias("total"))
    cut = scratch(cut.join(total, "file").select("file", "after", "lines", "before", "records", "total"), "ranges")
    size = cut.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).first()["n"] * WIDTH
    return cut.repartitionByRange(_tasks(spark, size), "before").where("records > 0").sortWithinPartitions("before").mapInArrow(_parsed(marker, singles), RECORD)


_DIRECTORY = "part string, low long, high long, file string, first_line long, last_line long"


def write(recs: DataFrame, path: str) -> DataFrame:
    """Writes parsed records as a table of consecutive records, with a directory of what each of its files holds; gives the table."""
    recs.write.parquet(path)
    stored = opened(recs.sparkSession, path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    held = stored.groupBy(name.alias("part"), "file").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    held.select(*[c.split()[0] for c in _DIRECTORY.split(", ")]).coalesce(1).write.parquet(f"{path}_directory")
    return stored


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def fetched(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The records of a written table that asked names: by ord, or by (file, first_line).

    The directory tells which files of the table hold them, and only these are
    read; their names are what reaches the driver. What no record has is missing
    from the result (``cards.unknown`` tells it).
    """
    directory = spark.read.schema(_DIRECTORY).parquet(f"{path}_directory")
    if "ord" in asked.columns:
        keys = asked.select("ord").distinct()
        # files hold consecutive records: the last file that begins at or before a number is its own
        marks = directory.groupBy("part").agg(F.min("low").alias("ord"), F.max("high").alias("high"))
        both = marks.select("ord", "part", "high").union(keys.select("ord", F.lit(None).cast("string"), F.lit(None).cast("long")))
        parts = carried(both.select(F.lit("").alias("all"), "ord", F.when(F.col("part").isNotNull(), F.struct("part", "high")).alias("held"), F.col("part").isNull().alias("key")), "all", "ord", "held", "into").where("key and ord <= into.high").select("into.part")
    else:
        keys = asked.select("file", "first_line").distinct()
        parts = keys.withColumnRenamed("first_line", "line").join(directory, "file").where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    names = [r["part"] for r in parts.select("part").distinct().collect()]
    table = spark.read.schema(RECORD)
    own = table.parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], RECORD)
    return own.join(keys, keys.columns, "left_semi")


def structure(found: DataFrame) -> DataFrame:
    """(file, header, trailer): the last << and >> line of each file, trimmed, from its ranges."""
    return found.groupBy("file").agg(F.max_by("header", "header_line").alias("header"), F.max_by("trailer", "trailer_line").alias("trailer"))


def trailer_check(found: DataFrame) -> DataFrame:
    """(declared_lines, lines, declared_records, records) from trailers (columns 4-12 and 13-21) and files, by their ranges."""
    declared = lambda at: F.max(F.substring("trailer", at, 9).try_cast("long"))
    return found.agg(declared(4).alias("declared_lines"), F.sum(F.col("lines") - F.col("marks")).alias("lines"), declared(13).alias("declared_records"), F.sum("records").alias("records"))


def spans(recs: DataFrame) -> DataFrame:
    """(ord, file, an, first_line, last_line, offset, length)."""
    return recs.select("ord", "file", "an", "first_line", "last_line", text.line_offset(F.col("first_line")).alias("offset"), "length")


def orphans(recs: DataFrame) -> DataFrame:
    """(ord, line_no) of continuations that continue nothing."""
    return recs.select("ord", F.explode("orphans").alias("line_no"))


def fields(recs: DataFrame) -> DataFrame:
    """(ord, field_seq, tag, line_start, line_end, offset, length)."""
    f = recs.select("ord", F.inline("fields"))
    return f.withColumns({"offset": text.line_offset(F.col("line_start")), "length": (F.col("line_end") - F.col("line_start") + 1) * WIDTH})


def kinds(recs: DataFrame) -> DataFrame:
    """(kind, n) of the lines inside records."""
    total = recs.agg(*[F.coalesce(F.sum(f"{k}s"), F.lit(0)).alias(k) for k in ("separator", "continuation", "tag")])
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in total.columns]))).where("n > 0")


def texts(raw_bytes: Column, percent_in_block: bool = False) -> dict[str, Column]:
    """raw, code, label and percent of a value's bytes."""
    raw = text.trim_end(text.latin1(raw_bytes))
    has, cut = F.contains(raw, F.lit(SEPARATOR)), F.split(raw, SEPARATOR, 3 if percent_in_block else 2)
    third = F.when(has, F.trim(F.get(cut, F.lit(2)))) if percent_in_block else F.lit(None).cast("string")
    return {"raw": raw, "code": F.when(has, text.trim_end(F.get(cut, F.lit(0)))), "label": F.when(has, text.trim_end(F.get(cut, F.lit(1)))), "percent": third}


def values(recs: DataFrame, percent_in_block: bool = False) -> DataFrame:
    """(ord, tag, field_seq, value_seq, raw, raw_bytes, code, label, percent, line, offset, continuation).

    Chunks of a value stand together with nothing between; blanks at its end went
    once. The marker begins a value only in tags that repeat, and is dropped there.
    """
    v = recs.select("ord", F.inline("vals"))
    of = texts(F.col("raw_bytes"), percent_in_block)
    return v.select("ord", "tag", "field_seq", "value_seq", of["raw"].alias("raw"), "raw_bytes", *[of[c].alias(c) for c in ("code", "label", "percent")], "line", text.line_offset(F.col("line")).alias("offset"), "continuation")
