"""Removal of long byte strings that occur elsewhere, by suffix sorting with a difference cover.

Which bytes lie in a string of ``size`` bytes that also starts elsewhere? Sorting
all suffixes of a corpus would move every byte many times, so a lossless search
for candidates comes first, and only what it cannot decide is sorted.

1. Every string of ``size`` bytes has an anchor: its first ``GRAM``-byte string of
   least hash. Equal strings have equal anchors at equal places. Neighbouring
   strings mostly share one, so a text has about one anchor in 90 bytes; the
   strings of one anchor form a run, the bytes they cover its context.
2. An anchor that occurs once in the corpus has no repeated string. If all
   contexts of an anchor are equal, all of its strings are repeated; so are those
   of a context that occurs twice. Contexts are equal if their bytes have one
   keyed BLAKE2b digest of 128 bits (context and proof). What remains is one
   context of each kind, mostly at the borders of what is repeated.
3. The remaining contexts of an anchor are sorted: suffixes at places 1 and 2 mod
   3 by the names of their triples, recursively; the others from these; both are
   merged; neighbours are compared over ``size`` bytes. Anchors are dealt out to
   tasks in bins of bounded size. An anchor with very many different contexts is
   not sorted in one task: they are split by hashes of halved blocks instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.llm.common import written
from cardamom.llm.wordhash import mix

SIZE, GRAM = 200, 24
#: Bytes whose strings are placed at a time, bytes sorted in one task's bin, contexts of an anchor that are sorted in one bin, places in the first blocks of others.
TILE, BIN_BYTES, MOST_CONTEXTS, WIDEST = 1 << 20, 1 << 20, 2048, 64
_POSITION = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: What tells one context from another.
_KIND = ["anchor", "context", "proof"]


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16, key=b"contexts").digest()


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 at least) from each place on."""
    eight = np.ndarray((len(raw) - 7,), np.uint64, np.ascontiguousarray(raw), strides=(1,))
    n = len(raw) - gram + 1
    h = eight[:n].copy()
    for o in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = (h ^ (h >> np.uint64(32))) * _STEP + eight[o : o + n]
    return mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(offs: np.ndarray, raw: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, place of the anchor, first and last start of each run, hash of the anchor, and both halves of the context's digest."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    if len(raw) < size:
        return none
    grams = _grams(raw, gram)
    order = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(order, size - gram + 1) & _POSITION).astype(np.int64)  # of the string at each start
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    valid = np.arange(len(anchor)) + size <= offs[text + 1]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return none
    stop = np.append(np.flatnonzero(change), len(anchor))
    last = stop[np.searchsorted(stop, first, "right")] - 1
    # a run ends where its text has no more strings
    last = np.minimum(last, offs[text[first] + 1] - size)
    place = anchor[first]
    view = memoryview(np.ascontiguousarray(raw))
    digests = b"".join([_digest(view[a:b]) for a, b in zip(first.tolist(), (last + size).tolist(), strict=True)])
    context, proof = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    # the same bytes at another distance from the anchor are another context
    context = mix(context ^ (place - first).astype(np.uint64)).view(np.int64)
    return text[first], place, first, last, grams[place], context, np.ascontiguousarray(proof).view(np.int64)


def _tiles(texts: list[bytes], size: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """([(row, start in its text), ...], offsets, bytes) of texts, a longer text in overlapping tiles."""
    held, n = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - size + 1), TILE):
            part = text[at : at + TILE + size - 1]
            if n and n + len(part) > TILE + size:
                yield _joined(held)
                held, n = [], 0
            held.append((row, at, part))
            n += len(part)
    if held:
        yield _joined(held)


def _joined(held):
    offs = np.concatenate([[0], np.cumsum([len(p) for _, _, p in held])]).astype(np.int64)
    return [(r, a) for r, a, _ in held], offs, np.frombuffer(b"".join(p for _, _, p in held), np.uint8)


_MARKS = "row_id long, doc_id long, digest string, anchor array<long>, context array<long>, proof array<long>, place array<long>, before array<int>, after array<int>"


def _mark(size: int, gram: int):
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), *((c, pa.list_(t)) for c, t in (("anchor", pa.int64()), ("context", pa.int64()), ("proof", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("after", pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [t.as_buffer().to_pybytes() for t in part.column("text").cast(pa.binary())]
                cols: list[list[np.ndarray]] = [[] for _ in range(7)]
                for own, offs, raw in _tiles(texts, size):
                    text, place, first, last, g, c, d = runs(offs, raw, size, gram)
                    row = np.array([r for r, _ in own])[text] if len(text) else text
                    shift = (np.array([x for _, x in own])[text] if len(text) else text) - offs[text]
                    for held, x in zip(cols, (row, g.view(np.int64), c, d, place + shift, place - first, last - place), strict=True):
                        held.append(x)
                row, g, c, d, place, before, after = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in cols)
                cuts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, t)) for x, t in ((g, pa.int64()), (c, pa.int64()), (d, pa.int64()), (place, pa.int64()), (before.astype(np.int32), pa.int32()), (after.astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("row_id", "doc_id", "digest")), *lists], schema=schema)

    return run


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of non-negative integers, sorted; a shorter suffix before a longer one it begins."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    top = int(s.max()) + 1
    every = np.arange(n + (n % 3 == 1))  # with n = 1 mod 3, the empty suffix closes the first class
    one, two = every[every % 3 == 1], every[every % 3 == 2]
    cover = np.concatenate([one, two])
    pair = s[:-1] * top + s[1:]  # of each place
    if top > 1 << 20:  # then names of pairs keep the products below 2 ** 63
        pair = np.unique(pair, return_inverse=True)[1]
    names, name = np.unique(pair[cover] * top + s[cover + 2], return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    if len(names) == len(cover):
        rank[cover] = name + 1
    else:
        order = suffix_order(name)
        rank[cover[order]] = np.arange(1, len(cover) + 1)
    sorted_cover = np.empty(len(cover), np.int64)
    sorted_cover[rank[cover] - 1] = cover
    sorted_cover = sorted_cover[sorted_cover < n]
    zero = np.arange(0, n, 3)
    wide = len(cover) + 2
    zero = zero[np.argsort(s[zero] * wide + rank[zero + 1], kind="stable")]
    one, two = sorted_cover[sorted_cover % 3 == 1], sorted_cover[sorted_cover % 3 == 2]
    ahead = np.searchsorted(s[one] * wide + rank[one + 1], s[zero] * wide + rank[zero + 1])
    ahead += np.searchsorted(pair[two] * wide + rank[two + 2], pair[zero] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = ahead + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted_cover
    return out


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the size bytes from each a equal those from its b."""
    eight = np.zeros(len(raw), np.uint64)  # the bytes from each place on, as one number
    for k in range(8):
        eight[: len(raw) - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(len(a))
    for o in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        at = at[eight[a[at] + o] == eight[b[at] + o]]
    same = np.zeros(len(a), bool)
    same[at] = True
    return same


def _sorted(size: int):
    """Of a bin of contexts: the runs of starts (as distance before the anchor) whose strings another context has too."""
    schema = pa.schema([*((c, pa.int64()) for c in _KIND), ("high", pa.int32()), ("low", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        texts = [x.as_buffer().to_pybytes() for x in t.column("bytes").combine_chunks()]
        before, after = t.column("before").to_numpy(), t.column("after").to_numpy()
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        own = np.repeat(np.arange(len(texts)), np.diff(begin))
        order = suffix_order(raw)
        eligible = order - begin[own[order]] <= (before + after)[own[order]]
        order = order[eligible]
        same = _same(raw, order[:-1], order[1:], size)
        found = np.zeros(len(raw) + 1, bool)
        found[order[:-1][same]] = True
        found[order[1:][same]] = True
        # the last size - 1 places of a context are no starts: no run of found ones goes on into the next
        edge = np.flatnonzero(found[:-1] & ~np.concatenate([[False], found[:-2]]))
        rows = own[edge]
        gaps = np.flatnonzero(~found)
        stop = gaps[np.searchsorted(gaps, edge)] - 1
        high = before[rows] - (edge - begin[rows])
        low = before[rows] - (stop - begin[rows])
        pick = pa.array(rows)
        return pa.table([*(t.column(c).take(pick).combine_chunks() for c in _KIND), pa.array(high, pa.int32()), pa.array(low, pa.int32())], schema=schema)

    return run


def _cut_contexts(size: int):
    """The bytes of the contexts asked of each text."""
    schema = pa.schema([*((c, pa.int64()) for c in _KIND), ("before", pa.int32()), ("after", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for w in wanted:
                    a = w["place"] - w["before"]
                    rows.append((w["anchor"], w["context"], w["proof"], w["before"], w["after"], raw[a : w["place"] + w["after"] + size]))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _blocks(size: int, width: int):
    """Of contexts, the blocks of ``width`` distances before the anchor that are asked for.

    Each with the digest of the bytes that all strings of the block have in common
    and that of all bytes of its strings.
    """
    schema = pa.schema([*((c, pa.int64()) for c in _KIND), ("block", pa.int32()), ("common", pa.binary()), ("whole", pa.binary()), ("high", pa.int32()), ("low", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for anchor, context, proof, before, after, raw, asked in zip(*(batch.column(c).to_pylist() for c in (*_KIND, "before", "after", "bytes", "asked")), strict=True):
                for block in range(-after // width, before // width + 1) if asked is None else asked:
                    low, high = max(block * width, -after), min(block * width + width - 1, before)
                    if low > high:
                        continue
                    common = _digest(raw[before - block * width : before - (block * width + width - 1) + size])
                    whole = _digest(raw[before - high : before - low + size] + bytes([low & 255, high & 255]))
                    rows.append((anchor, context, proof, block, common, whole, high, low))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _by_halves(contexts: DataFrame, size: int) -> DataFrame:
    """(anchor, context, proof, high, low) as the sorted bins give it, for anchors with too many contexts for one of them.

    Contexts that share what all strings of a block have in common are told
    apart in blocks of half the width, until they are equal or differ; a context
    has a few open blocks in each round, however many others the anchor has.
    """
    found, asked, width = [], contexts.withColumn("asked", F.lit(None).cast("array<int>")), WIDEST
    kind = "anchor long, context long, proof long, block int, common binary, whole binary, high int, low int"
    while True:
        rows = written(asked.mapInArrow(_blocks(size, width), kind), "blocks")
        key = ["anchor", "block", "common"]
        met = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("n > 1")
        met = written(met.select(*key, (F.col("w0") == F.col("w1")).alias("alike")), "blocks")
        rows = rows.join(met, key)
        found.append(rows.where("alike").select(*_KIND, "high", "low"))
        open_ = rows.where("not alike")
        if width == 1:
            break
        width //= 2
        halves = open_.select(*_KIND, F.explode(F.array(F.col("block") * 2, F.col("block") * 2 + 1)).alias("b"))
        halves = written(halves.groupBy(*_KIND).agg(F.collect_set("b").alias("asked")), "asked")  # size at most
        asked = contexts.join(halves, _KIND)
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest): rows of one doc_id and digest have equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("digest", F.sha2("text", 256))


def repeated(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(marks, spans): a row per document, and (row_id, start, stop) of all bytes in repeated strings, overlaps included."""
    spark = docs.sparkSession
    marks = written(_keyed(docs).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "digest", "text").mapInArrow(_mark(size, gram), _MARKS), "marks")
    zipped = F.explode(F.arrays_zip(*_KIND, "place", "before", "after")).alias("x")
    each = marks.select("row_id", zipped).select("row_id", "x.*")
    shared = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("proof").alias("p0"), F.max("proof").alias("p1")).where("n > 1")
    shared = written(shared.select("anchor", F.expr("c0 = c1 and p0 = p1").alias("alike")), "shared")
    met = written(each.join(shared, "anchor"), "met")
    # one of each different context, where an anchor has several
    kinds = met.where("not alike").groupBy(*_KIND).agg(F.count("*").alias("copies"), F.min(F.struct("row_id", "place", "before", "after")).alias("x"))
    kinds = written(kinds.select(*_KIND, "copies", "x.*"), "kinds")

    wanted = kinds.groupBy("row_id").agg(F.collect_list(F.struct(*_KIND, "place", "before", "after")).alias("wanted"))  # of one text
    wanted = written(wanted.join(marks.select("row_id", "doc_id", "digest"), "row_id").withColumn("id", F.coalesce("doc_id", F.lit(-1))).select("id", "digest", "wanted"), "wanted")
    texts = _keyed(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1))).select("id", "digest", "text")
    contexts = texts.join(wanted, ["id", "digest"]).select("text", "wanted").mapInArrow(_cut_contexts(size), "anchor long, context long, proof long, before int, after int, bytes binary")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    crowded = written(many.where(F.col("kinds") > MOST_CONTEXTS).select("anchor"), "crowded")
    contexts = written(contexts, "contexts")

    total = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BIN_BYTES))
    few = contexts.join(crowded, "anchor", "left_anti").dropDuplicates(_KIND)
    by_order = few.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(bins)).alias("bin")).applyInArrow(_sorted(size), "anchor long, context long, proof long, high int, low int")

    if not crowded.isEmpty():
        by_order = by_order.union(_by_halves(written(contexts.join(crowded, "anchor", "left_semi").dropDuplicates(_KIND), "crowded_contexts"), size))
    found = by_order.groupBy(*_KIND).agg(F.collect_set(F.struct("high", "low")).alias("parts"))  # size at most
    found = written(found, "found")
    sure = F.array(F.struct(F.col("before").alias("high"), (-F.col("after")).alias("low")))
    own = met.where("alike").select("row_id", "place", sure.alias("parts"))
    copied = kinds.where("copies > 1").select(*_KIND, F.lit(True).alias("copied"))
    verdict = written(found.join(copied, _KIND, "full_outer"), "verdicts")
    rest = met.where("not alike").join(verdict, _KIND).select("row_id", "place", F.when(F.col("copied"), sure).otherwise(F.col("parts")).alias("parts"))
    spans = own.union(rest).select("row_id", "place", F.explode("parts").alias("p"))
    return marks, spans.select("row_id", (F.col("place") - F.col("p.high")).alias("start"), (F.col("place") - F.col("p.low") + size).alias("stop"))


def without_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Texts are UTF-8 bytes, null is empty; matches do not cross documents. Rows
    that repeat a document repeat its strings. Texts under ``size`` bytes lose
    nothing. Rows with a null doc_id are texts of their own; an empty table stays
    empty. Other columns are ignored.
    """
    marks, spans = repeated(docs, size, gram)
    every = spans.groupBy("row_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one text
    cut = every.join(marks.select("row_id", "doc_id", "digest"), "row_id")
    # equal texts of one id have equal spans
    cut = written(cut.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("digest").alias("of")).agg(F.first("spans").alias("spans")), "cuts")
    rows = _keyed(docs)
    rows = rows.join(cut, (F.coalesce("doc_id", F.lit(-1)) == F.col("id")) & (F.col("digest") == F.col("of")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                at, kept, gone, n = 0, hashlib.sha256(), 0, 0
                for start, stop in sorted((s["start"], s["stop"]) for s in own or ()):
                    if start > at or not n:  # not joined to the one before
                        kept.update(raw[at:start])
                        n += 1
                    gone += max(0, stop - max(at, start))
                    at = max(at, stop)
                kept.update(raw[at:])
                out.append((doc_id, len(raw), gone, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, schema, strict=True)], schema=schema)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
