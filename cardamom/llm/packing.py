"""Packing token sequences: large pieces in pairs, small ones best-fit into what is left.

The plan depends only on how many pieces have each length, a table of at most
``capacity`` rows whatever the corpus: bins with equal contents are planned
together. Pieces longer than a third of the capacity are matched greedily, the
longest with the longest that fits beside it, two in a bin at most; smaller
pieces, longest first, go where the gap left is least. Each piece then finds its
place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardamom.llm import bpe
from cardamom.llm.common import written

CAPACITY, END_ID = 4096, 1
_IDS: dict[str, bpe.Remembered] = {}


def token_ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, as the tokenizer file gives them without special tokens added."""
    pieces = bpe.loaded(path)
    seen = _IDS.setdefault(path, bpe.Remembered(pieces.merged_ids))
    special = {i for i, t in enumerate(texts) if "<" in t and pieces.special.search(t)}
    for first, text, code, begin, end, h, at in pieces.words(["" if i in special else t for i, t in enumerate(texts)]):
        if len(h):
            row = seen.rows(text, code, begin, end, h)
            count = seen.count[row]
            sums = np.concatenate([[0], np.cumsum(count)])
            ids = seen.flat[np.repeat(seen.begin[row] - sums[:-1], count) + np.arange(sums[-1])]
        else:
            sums, ids = np.zeros(1, np.int64), np.zeros(0, np.int64)
        for i in range(len(at) - 1):
            yield pieces.library_ids(texts[first + i]) if first + i in special else ids[sums[at[i]] : sums[at[i + 1]]]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut only where longer than capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_ids(path, batch.column("text").fill_null("").to_pylist()), strict=True):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces of it in each of these bins), ...]) that hold all pieces."""
    left = dict(counts)
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(bins: int, items: list[tuple[int, int]], gap: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        by_gap[gap].append((bins, items))

    large = sorted(x for x in left if 3 * x > capacity and left[x])
    while large:
        a = large[-1]
        # the longest that fits beside it; itself if two of it do
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            put(left[a], [(a, 1)], capacity - a)
            left[a] = 0
        elif large[at] == a:
            if left[a] > 1:
                put(left[a] // 2, [(a, 2)], capacity - 2 * a)
            left[a] %= 2
            if left[a] and len(large) > 1:
                b = large[-2]
                put(1, [(a, 1), (b, 1)], capacity - a - b)
                left[a], left[b] = 0, left[b] - 1
            elif left[a]:
                put(1, [(a, 1)], capacity - a)
                left[a] = 0
        else:
            b = large[at]
            n = min(left[a], left[b])
            put(n, [(a, 1), (b, 1)], capacity - a - b)
            left[a], left[b] = left[a] - n, left[b] - n
        large = [x for x in large if left[x]]
    for x in sorted((x for x in left if left[x]), reverse=True):
        n = left[x]
        while n:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):
                most = capacity // x
                if n >= most:
                    put(n // most, [(x, most)], capacity - most * x)
                if n % most:
                    put(1, [(x, n % most)], capacity - n % most * x)
                n = 0
                continue
            gap = gaps[at]
            bins, items = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            each = min(gap // x, n)
            used = min(bins, n // each)
            if used < bins:
                put(bins - used, items, gap)
            put(used, [*items, (x, each)], gap - each * x)
            n -= used * each
    return [entry for gap in sorted(by_gap) for entry in by_gap[gap]]


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Null and empty texts have the end id alone. Rows with a null or repeated
    doc_id are packed like any other; other columns are ignored. Ranks are
    counted in parts of each length, so that no length is numbered in one task.
    An empty table needs no sequence.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    rows, first, rank = [], 0, dict.fromkeys(counts, 0)
    for bins, items in plan(counts, capacity):
        offset = 0
        for length, each in items:
            rows.append((length, rank[length], rank[length] + bins * each, each, first, offset))
            rank[length] += bins * each
            offset += length * each
        first += bins
    # its size follows from capacity, not from the corpus: a broadcast at any scale
    places = F.broadcast(spark.createDataFrame(rows, "l long, low long, high long, each long, first long, base long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.select(F.col("length").alias("l2"), F.col("part").alias("p2"), F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(sizes, (F.col("length") == F.col("l2")) & (F.col("part") == F.col("p2")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1)
    out = ranked.join(places, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
