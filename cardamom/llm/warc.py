"""Web archives: records written by tasks, read back, and found through a two-level index.

Archives are files of uncompressed WARC records of bounded size. The capture
index has one line per record: the URL with its host reversed, the page, the
file, the offset and the length. Lines are sorted and cut into blocks; each
block is compressed and kept as one row of a Parquet table, and a sparse
directory holds each block's first line. Lookups are dealt to the parts of the
index by their bounds (a row per part); a task searches its part of the
directory by bisection, another opens the blocks so found and searches in them,
and the byte ranges of the records are read file by file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.llm.common import own_folder, written
from cardamom.sources.store import opened

#: Bytes after which an archive file is closed, and lines in a block of the index, at most.
FILE_BYTES, BLOCK_LINES = 64 << 20, 512
#: Bits of the table that tells payloads with copies from others, in words of 64: 2^20 rows at most.
SUSPECT_BITS = 1 << 26
DATE = "2000-01-01T00:00:00Z"
_LOW = -(1 << 63)  # sorts where a null page does


def surt(url: Column) -> Column:
    """The URL with its host reversed, lower-case, without scheme, www and default port: com,example)/path?query.

    Line ends count as the blank that archives hold for them; other control
    characters, which separate the fields and lines of the index, are percent-encoded.
    """
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    line = _line(url)
    parts = F.split(F.lower(F.regexp_extract(line, pattern, 1)), ":", 2)
    host, port, rest = F.regexp_replace(parts[0], r"^www\d*\.", ""), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.regexp_extract(line, pattern, 2)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(F.startswith(rest, F.lit("/")), "").otherwise("/"), rest)
    escaped = key
    for c in (*range(0x20), 0x7F):
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(key.rlike(r"[\x00-\x1f\x7f]"), escaped).otherwise(key)


def _line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record (url: one line) without the two closing line ends' last: the sink adds it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n"


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of every record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        stop = end + 4 + size + 4
        yield at, stop - at, fields, data[end + 4 : end + 4 + size]
        at = stop


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit(""))


def _suspects(groups: DataFrame, bits: int) -> DataFrame:
    """(word, mask) of a table of ``bits`` bits, in which each digest s of groups sets one; at most bits / 64 rows."""
    at = F.pmod(F.xxhash64("s"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    return groups.select(F.floor(at / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> str:
    """Writes a record per row of pages (page_id, url, html); the folder of the archives.

    Null html is empty. Of records with equal payloads of at least ``least``
    bytes, the one of the smallest page_id is a response, the others revisit it.
    Rows with a null page_id, and repeated rows of one page_id, are responses
    unless another page has the payload.

    Only pages whose payload may have copies, by a broadcast table of bits of
    bounded size, are moved to find the first of them; the others are written where
    they are read. Where so many payloads have copies that all bits are set, all are moved.
    """
    spark = pages.sparkSession
    folder = folder or own_folder(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), _line(F.col("url")).alias("url"), _payload(F.col("html")).alias("html"))
    keyed = p.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("n"))
    groups = keyed.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = written(groups.select(F.col("sha").alias("s"), "first"), "copied")
    at = F.pmod(F.xxhash64("sha"), F.lit(SUSPECT_BITS))
    bits = F.broadcast(_suspects(groups, SUSPECT_BITS))
    p = p.withColumn("sha", F.sha2("html", 256)).withColumn("at", at).join(bits, F.floor(F.col("at") / 64) == F.col("word"), "left")
    may = F.getbit(F.coalesce("mask", F.lit(0).cast("long")), (F.col("at") % 64).cast("int")) == 1
    alone = p.where(~may).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    # a sort-merge join, whatever the sizes: a payload of very many copies may be split, and the number of groups has no bound
    several = p.where(may).join(groups.hint("merge"), F.col("sha") == F.col("s"), "left")
    first = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    p = alone.union(several.select("page_id", "url", "html", first.alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume = held = 0  # a task's archives
        for batch in batches:
            out, volumes = [], []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                out.append(record(page_id, url, payload, base32_sha1(payload), refers_to))
                volumes.append(volume)
                held += len(out[-1])
                if held >= FILE_BYTES:
                    volume, held = volume + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(volumes, pa.int32())], names=["record", "volume"])

    records = p.mapInArrow(run, "record binary, volume int")
    # a record's last line end is the sink's separator; casting bytes to a string keeps them
    records.select(F.col("record").cast("string").alias("value"), "volume").write.partitionBy("volume").option("lineSep", "\r\n").text(folder)
    return folder


_ROW = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
_KIND = "file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _row(file: str, at: int, size: int, f: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """The columns of one record; a payload that is not the one written is refused."""
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
    revisit = f["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or f["WARC-Payload-Digest"] != "sha1:" + base32_sha1(payload)):
        raise ValueError(f"{file}, byte {at}: the payload is not the one written")
    return file, at, size, _page(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], _page(f.get("WARC-Refers-To")), f["WARC-Payload-Digest"].removeprefix("sha1:"), n, None if revisit or not payloads else payload


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) == 256 or size > FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _ROW, strict=True)], names=[c for c, _ in _ROW])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _ROW, strict=True)], names=[c for c, _ in _ROW])


def read(folder: str, spark: SparkSession, payloads: bool = True) -> DataFrame:
    """(file, offset, length, page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of all records.

    payload_bytes is the full payload's, payload what the record itself holds (null for revisits). An archive is read at once: it has FILE_BYTES and one record at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                yield from _batches(_row(file, *r, payloads) for r in parsed(content.as_buffer().to_pybytes()))

    return files.mapInArrow(run, _KIND)


def _entry(key: str, page: int | None) -> tuple[str, int]:
    return key, _LOW if page is None else page


def build_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> None:
    """Writes the two levels under folder: blocks (compressed sorted lines) and directory (first line of each block).

    Lines are range-partitioned by key, page and place, so a URL of very many captures lies in several parts.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()), ("lines", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, seq = 0, 0

        def block(lines: list[tuple]) -> pa.RecordBatch:
            raw = "\n".join("\t".join("" if x is None else str(x) for x in line) for line in lines).encode()
            row = [part, seq, lines[0][0], lines[0][1], len(lines), zlib.compress(raw)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held, seq = held[block_lines:], seq + 1
        if held:
            yield block(held)

    order = ["key", "page_id", "file", "offset"]
    lines = records.select(surt(F.col("url")).alias("key"), "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "part int, seq int, key string, page_id long, lines int, block binary"
    lines.withColumn("part", F.spark_partition_id()).mapInArrow(run, kind).write.parquet(f"{folder}/blocks")
    blocks = records.sparkSession.read.schema(kind).parquet(f"{folder}/blocks")
    blocks.drop("block").repartitionByRange("part", "seq").sortWithinPartitions("part", "seq").write.parquet(f"{folder}/directory")


def _wanted(key: str, page: int | None, any_page: bool) -> tuple[tuple[str, int], tuple[str, int]]:
    """The least and greatest entries asked for."""
    return ((key, _LOW), (key, -_LOW)) if any_page else (_entry(key, page),) * 2


def _spread(first: list[tuple[str, int]], low: tuple[str, int], high: tuple[str, int]) -> range:
    """Of sorted runs that begin with these entries, those that may hold any from low to high."""
    return range(max(0, bisect.bisect_left(first, low) - 1), bisect.bisect_right(first, high))


def located(spark: SparkSession, folder: str, asked: DataFrame, any_page: bool = False) -> DataFrame:
    """(key, page_id, file, offset, length) of the captures of asked (key, page_id), found by directory and blocks.

    Each capture comes once, however often it is asked for. A null page_id is a
    page of its own. any_page: all captures of asked (key), whatever their page.
    """
    directory = spark.read.parquet(f"{folder}/directory")
    bounds = directory.groupBy("part").agg(F.min_by(F.struct("key", "page_id"), "seq").alias("first"))
    bounds = sorted((*_entry(*r["first"]), r["part"]) for r in bounds.collect())  # a row per part
    firsts, parts = [(k, p) for k, p, _ in bounds], [x for _, _, x in bounds]
    own = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("part", pa.int32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            rows = [(k, p, parts[i]) for k, p in zip(keys, pages, strict=True) for i in _spread(firsts, *_wanted(k, p, any_page))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own)], schema=own)

    def search(asked: pa.Table, runs: pa.Table) -> pa.Table:
        entries = sorted((*_entry(k, p), s) for k, p, s in zip(*(runs.column(c).to_pylist() for c in ("key", "page_id", "seq")), strict=True))
        first, seqs = [(k, p) for k, p, _ in entries], [s for _, _, s in entries]
        rows = [(k, p, part, seqs[i]) for k, p, part in zip(*(asked.column(c).to_pylist() for c in ("key", "page_id", "part")), strict=True) for i in _spread(first, *_wanted(k, p, any_page))]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "page_id", "part", "seq"])

    def open_blocks(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows:
            for block in blocks.column("block").to_pylist():
                lines = [x.split("\t") for x in zlib.decompress(block).decode().split("\n")]
                order = [_entry(x[0], int(x[1]) if x[1] else None) for x in lines]
                for k, p in zip(asked.column("key").to_pylist(), asked.column("page_id").to_pylist(), strict=True):
                    low, high = _wanted(k, p, any_page)
                    for at in range(bisect.bisect_left(order, low), bisect.bisect_right(order, high)):
                        rows.append((k, int(lines[at][1]) if lines[at][1] else None, lines[at][2], int(lines[at][3]), int(lines[at][4])))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])

    asked = asked.select("key", F.lit(None).cast("long").alias("page_id") if any_page else F.col("page_id"))
    dealt = asked.distinct().mapInArrow(deal, "key string, page_id long, part int")
    found = dealt.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(search, "key string, page_id long, part int, seq int")
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "seq", "block")
    return found.groupBy("part", "seq").cogroup(blocks.groupBy("part", "seq")).applyInArrow(open_blocks, "key string, page_id long, file string, offset long, length long")


def lookup(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of all captures of urls (url)."""
    return located(spark, folder, urls.select(surt(F.col("url")).alias("key")), any_page=True)


def fetched(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The rows of ``read`` for records at places (file, offset, length): only their bytes are read, a file's in one task.

    Tasks open the archives with pyarrow's file systems (local or mounted, hdfs, s3, gcs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            name, source = None, None
            for batch in batches:
                for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        store, path = opened(file)
                        name, source = file, store.open_input_file(path)
                    source.seek(offset)
                    _, _, f, block = next(parsed(source.read(length)))
                    yield _row(file, offset, length, f, block, payloads)

        yield from _batches(rows())

    dealt = places.select("file", "offset", "length").repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, _KIND)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, from archives written and read back.

    Every page is looked up by its URL and id in the directory, its block is
    opened, and the row is made of the bytes at the place found there. A null html
    is an empty payload, a null url an empty one; rows without a page_id and
    repeated rows of one are responses; each comes back. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = write(pages, least=least)
    lines = written(read(folder, spark, payloads=False).select("url", "page_id", "file", "offset", "length"), "captures")
    build_index(lines, f"{folder}-index")
    asked = pages.select(surt(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return fetched(located(spark, f"{folder}-index", asked), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
