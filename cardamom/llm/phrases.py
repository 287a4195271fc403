"""Collocations: phrases that occur more often than their parts would let one expect.

Frequent phrases are found level by level. At each level a text is a sequence of
numbers, the ranks by frequency of what counts as frequent there, with gaps where
it is not or where a piece ends. Adjacent numbers are a pair; frequent pairs are
ranked in turn, and the ranks at adjacent places, which overlap by all but one
word, are the pairs of the next level: words, two words, three words.

* Texts are gathered into chunks of one language and about ``CHUNK_WORDS`` words.
  A chunk is coded once with its own dictionary; what goes back to it later are the
  ranks of its own entries. No task holds the vocabulary or all pairs.
* Within a chunk, ids in order of rank split the pairs into tiles of ``TILE`` squared
  cells. A tile that is filled well is counted by one bincount over its cells, which
  are then addressed directly; the pairs of all others are sorted.
* The counts of a chunk go out as one row of arrays for each bucket of keys. A
  bucket is summed in one task; a key has one entry for each chunk at most, however
  frequent it is. The number of buckets grows with the number of words.

Keys are equal by comparison (words as strings, pairs as numbers); hashes only
choose buckets. Scores are exact decimals.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardamom.llm.common import written
from cardamom.llm.wordhash import mix, slices
from cardamom.llm.words import coded
from cardamom.plans.numbering import sorted_ranks

#: Bytes that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
CHUNK_WORDS, BUCKET_WORDS = 1 << 20, 1 << 21
#: Ids on a side of a tile, and the part of its cells that must be met for it to be counted densely.
TILE, FILLED = 1 << 10, 1 / 16
#: Groups of candidates of a language that are cut to the number wanted one after the other.
SALTS = (1024, 32, 1)

_CODED = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("counts", pa.binary()), ("keys", pa.list_(pa.string()))])
_PAIRS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("bucket", pa.int64()), ("data", pa.binary()), ("counts", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
_RANKS = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("ranks", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def packed(a: np.ndarray) -> bytes:
    """Numbers as differences, compressed; its own inverse is ``unpacked``."""
    a = np.diff(a.astype(np.int64), prepend=0)
    small = not len(a) or (a.min() >= -(1 << 31) and a.max() < 1 << 31)
    raw = a.astype(np.int32 if small else np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + (b"\x04" if small else b"\x08") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[9:], size, "zstd", asbytes=True) if size else b""
    return np.cumsum(np.frombuffer(raw, np.int32 if data[8] == 4 else np.int64), dtype=np.int64)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places that have it), places ascending."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for here in np.split(order, cuts[1:]) if len(order) else ():
        yield int(bucket[here[0]]), here


def _chunked(buckets: int):
    """Texts into chunks: a row without a bucket has a chunk's ids (0 before each piece); a row of a bucket has words with their ids and counts."""

    def out(chunk: int, lang: str, parts: list) -> pa.RecordBatch:
        both = pa.concat_arrays([v for _, v in parts]).dictionary_encode()
        to, values = both.indices.to_numpy(zero_copy_only=False) + 1, both.dictionary.to_pylist()
        seqs, before = [], 0
        for seq, v in parts:
            seqs.append(np.where(seq < 0, 0, to[before + np.maximum(seq, 0)] if len(v) else 0))
            before += len(v)
        seq = np.concatenate(seqs)
        n = np.bincount(seq, minlength=len(values) + 1)[1:]
        rows = [(chunk, lang, None, int(n.sum()), packed(seq), None, None)]
        crc = np.array([zlib.crc32(w) for w in values], np.int64) % buckets
        for bucket, at in _dealt(crc):
            rows.append((chunk, lang, bucket, None, packed(at + 1), packed(n[at]), [values[i].decode() for i in at.tolist()]))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CODED, strict=True)], schema=_CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        kept: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("_lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("_text").filter(pc.equal(langs.indices, i))
                for _, offs, raw in slices(texts):
                    words = coded(offs, raw, lower=True, breaks=BREAKS)
                    if not len(words.ids):
                        continue
                    at = np.flatnonzero(words.broken)
                    kept.setdefault(lang, []).append((np.insert(words.ids.astype(np.int32), at, -1), words.values))
                    sizes[lang] = sizes.get(lang, 0) + len(words.ids)
                    full = list(sizes) if sum(sizes.values()) >= 2 * CHUNK_WORDS else [lang] if sizes[lang] >= CHUNK_WORDS else []
                    for name in full:
                        yield out(chunk, name, kept.pop(name))
                        chunk, _ = chunk + 1, sizes.pop(name)
        for name, parts in kept.items():
            yield out(chunk, name, parts)
            chunk += 1

    return run


def tile_counts(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (x, y) of ids up to ``most``, their counts, and for each pair given its place among them."""
    side = most // TILE + 1
    tile = (x // TILE) * side + y // TILE
    if side * side <= max(1 << 20, 8 * len(x)):
        filled = np.flatnonzero(np.bincount(tile, minlength=1) >= FILLED * TILE * TILE)
    else:
        met, n = np.unique(tile, return_counts=True)
        filled = met[n >= FILLED * TILE * TILE]
    place, left = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    xs, ys, counts, done = [], [], [], 0
    for t in filled.tolist():
        here = np.flatnonzero(tile == t)
        cell = (x[here] % TILE) * TILE + y[here] % TILE
        n = np.bincount(cell, minlength=TILE * TILE)
        met = np.flatnonzero(n)
        number = np.zeros(TILE * TILE, np.int64)
        number[met] = done + np.arange(len(met))
        place[here], left[here] = number[cell], False
        xs.append(met // TILE + t // side * TILE)
        ys.append(met % TILE + t % side * TILE)
        counts.append(n[met])
        done += len(met)
    rest = np.flatnonzero(left)
    code, number, n = np.unique(x[rest] * (most + 1) + y[rest], return_inverse=True, return_counts=True)
    place[rest] = done + number.ravel()
    xs.append(code // (most + 1))
    ys.append(code % (most + 1))
    counts.append(n)
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(counts), place


def _paired(buckets: int, further: bool):
    """A chunk's ids and the ranks of some of them: its pairs by bucket and, if wanted, the ids of its pairs by place."""

    def run(chunks: pa.Table, ranks: pa.Table) -> pa.Table:
        rows = []
        for chunk, lang, data in zip(*(chunks.column(c).to_pylist() for c in ("chunk", "lang", "data")), strict=True):
            seq = unpacked(data)
            ids = np.concatenate([np.zeros(0, np.int64), *(unpacked(d) for d in ranks.column("data").to_pylist())])
            rank = np.concatenate([np.zeros(0, np.int64), *(unpacked(r) for r in ranks.column("ranks").to_pylist())])
            order = np.argsort(rank)
            by_rank = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
            by_rank[ids[order]] = np.arange(1, len(ids) + 1)
            rank, seq = rank[order], by_rank[seq]
            at = np.flatnonzero((seq[1:] > 0) & (seq[:-1] > 0))
            x, y, n, place = tile_counts(seq[at] - 1, seq[at + 1] - 1, max(0, len(ids) - 1))
            if further and len(at):
                pairs = np.zeros(len(seq), np.int64)
                pairs[at] = place + 1
                rows.append((chunk, lang, None, packed(pairs), None, None, None))
            x, y = rank[x], rank[y]
            bucket = (mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(y.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            for b, here in _dealt(bucket):
                rows.append((chunk, lang, b, packed(here + 1), packed(n[here]), packed(x[here]), packed(y[here])))
        columns = zip(*rows, strict=True) if rows else [[]] * len(_PAIRS)
        return pa.table([pa.array(list(c), t.type) for c, t in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return run


def _word_totals(least: int):
    schema = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        keys = t.column("keys").combine_chunks()
        lang = t.column("lang").combine_chunks().take(pc.list_parent_indices(keys))
        counts = np.concatenate([unpacked(c) for c in t.column("counts").to_pylist()])
        sums = pa.table({"lang": lang, "word": pc.list_flatten(keys), "f": counts}).group_by(["lang", "word"]).aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("f_sum"), least))
        return pa.table([pa.array(np.full(len(sums), t.column("bucket")[0].as_py())), sums.column("lang"), sums.column("word"), sums.column("f_sum")], schema=schema)

    return run


def _numbers(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each different pair (x, y), also of a second list; numbers rise with x, then y."""
    _, a = np.unique(np.concatenate([x, x2]), return_inverse=True)
    _, b = np.unique(np.concatenate([y, y2]), return_inverse=True)
    code = a.ravel() * (int(b.max(initial=0)) + 1) + b.ravel()
    return code[: len(x)], code[len(x) :]


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(unpacked(c) for c in t.column(n).to_pylist())]) for n in names]


def _pair_totals(least: int):
    schema = pa.schema([("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        x, y, n = _columns(t, "x", "y", "counts")
        code, _ = _numbers(x, y, x[:0], y[:0])
        order = np.argsort(code, kind="stable")
        begins = np.flatnonzero(np.diff(code[order], prepend=-1))
        total = np.add.reduceat(n[order], begins) if len(begins) else n
        often = np.flatnonzero(total >= least)
        first = order[begins[often]]
        return pa.table([pa.array(np.full(len(often), t.column("bucket")[0].as_py())), pa.array(x[first]), pa.array(y[first]), pa.array(total[often])], schema=schema)

    return run


def _back(rows: list) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_RANKS)
    return pa.table([pa.array(list(c), t.type) for c, t in zip(columns, _RANKS, strict=True)], schema=_RANKS)


def _word_ranks(parts: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the ids of its frequent words and their ranks."""
    rows, by_lang = [], {}
    for lang in pc.unique(vocabulary.column("lang")).to_pylist():
        mine = vocabulary.filter(pc.equal(vocabulary.column("lang"), lang))
        by_lang[lang] = mine.column("word").combine_chunks(), mine.column("rank").to_numpy()
    keys = parts.column("keys").combine_chunks()
    for i, (chunk, lang, data) in enumerate(zip(*(parts.column(c).to_pylist() for c in ("chunk", "lang", "data")), strict=True)):
        if lang in by_lang:
            words, rank = by_lang[lang]
            at = pc.index_in(keys[i].values, words).fill_null(-1).to_numpy(zero_copy_only=False)
            if (at >= 0).any():
                rows.append((chunk, packed(unpacked(data)[at >= 0]), packed(rank[at[at >= 0]])))
    return _back(rows)


def _pair_ranks(parts: pa.Table, often: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the ids of its frequent pairs and their ranks."""
    if not len(often) or not len(parts):
        return _back([])
    sizes = [len(unpacked(c)) for c in parts.column("x").to_pylist()]
    x, y, ids = _columns(parts, "x", "y", "data")
    code, known = _numbers(x, y, often.column("x").to_numpy(), often.column("y").to_numpy())
    order = np.argsort(known)
    known, rank = known[order], often.column("rank").to_numpy()[order]
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit, rows, a = known[at] == code, [], 0
    for chunk, n in zip(parts.column("chunk").to_pylist(), sizes, strict=True):
        here = np.flatnonzero(hit[a : a + n]) + a
        if len(here):
            rows.append((chunk, packed(ids[here]), packed(rank[at[here]])))
        a += n
    return _back(rows)


def _scored(x: str, y: str, a: str, words: int) -> Column:
    """The cut of least score, of those the first: (score, k, l, r)."""
    cuts = []
    for k in range(1, words):
        first, rest = F.element_at(f"{x}.before", k), F.element_at(f"{y}.after", words - k)
        whole = lambda c: c.cast("decimal(16,0)")
        product, parts = whole(F.col(a)) * whole(F.col(a)) * F.lit(1_000_000).cast("decimal(7,0)"), whole(first) * whole(rest)
        cuts.append(F.struct(F.call_function("div", product, parts).alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def frequent_phrases(docs: DataFrame, words: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1 to ``words`` words that occur ``least`` times, and (lang, n).

    A table has rank, lang, words, f, and the counts of the phrase's beginnings
    (before) and ends (after) by length; those of two words and more also x and y,
    the ranks of the phrases without the last and without the first word, and cut
    (score, k, l, r).
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("_lang"), docs["text"].cast("string").alias("_text")).where("_text is not null")
    table = written(base.mapInArrow(_chunked(buckets), _ddl(_CODED)), "chunks")
    chunks, parts = table.where("bucket is null"), table.where("bucket is not null")
    sizes = written(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    buckets = max(buckets, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / BUCKET_WORDS))
    often = parts.select("bucket", "lang", "keys", "counts").groupBy("bucket").applyInArrow(_word_totals(least), "bucket long, lang string, word string, f long")
    often = written(sorted_ranks(often, F.desc("f"), F.asc("lang"), F.asc("word")), "words")
    level = often.select("rank", "lang", F.array("word").alias("words"), "f", F.array("f").alias("before"), F.array("f").alias("after"))
    levels = [level]
    back = parts.select("bucket", "chunk", "lang", "data", "keys").groupBy("bucket").cogroup(often.select("bucket", "lang", "word", "rank").groupBy("bucket")).applyInArrow(_word_ranks, _ddl(_RANKS))
    for size in range(2, words + 1):
        ids = chunks.select("chunk", "lang", "data")
        table = written(ids.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_paired(buckets, size < words), _ddl(_PAIRS)), "pairs")
        chunks, parts = table.where("bucket is null"), table.where("bucket is not null")
        pairs = parts.select("bucket", "x", "y", "counts").groupBy("bucket").applyInArrow(_pair_totals(least), "bucket long, x long, y long, a long")
        pairs = written(sorted_ranks(pairs, F.desc("a"), F.asc("x"), F.asc("y")), "phrases")
        x, y = (level.select(F.col("rank").alias(c), F.struct("lang", "words", "before", "after").alias(f"{c}_")) for c in "xy")
        found = pairs.select("rank", "x", "y", "a").join(x, "x").join(y, "y")
        found = found.select(
            "rank",
            F.col("x_.lang").alias("lang"),
            F.concat("x_.words", F.slice("y_.words", -1, 1)).alias("words"),
            F.col("a").alias("f"),
            F.concat("x_.before", F.array("a")).alias("before"),
            F.concat("y_.after", F.array("a")).alias("after"),
            "x",
            "y",
            _scored("x_", "y_", "a", size).alias("cut"),
        )
        level = written(found, "level")
        levels.append(level)
        if size < words:
            back = parts.select("bucket", "chunk", "x", "y", "data").groupBy("bucket").cogroup(pairs.select("bucket", "x", "y", "rank").groupBy("bucket")).applyInArrow(_pair_ranks, _ddl(_RANKS))
    return levels, sizes


def collocations(docs: DataFrame, words: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of greatest score.

    Texts, A-Z lower-cased, are split into pieces at . , ; : ! ? and 0x0A-0x0D, and
    these into words at 0x20 and 0x09. n counts all words of the language, a the
    occurrences of the phrase within pieces, l and r those of its two parts at the
    cut of least score floor(1000000 * a * a / (l * r)), ties to the first. Phrases of
    2 to ``words`` words and ``least`` occurrences are candidates; one that lies in a
    longer candidate with at least ``covered`` percent of its occurrences goes.
    top=None ranks all.

    A null lang is `und`; null and empty texts, and texts without words, count
    nothing; repeated rows count each; other columns are ignored; an empty table
    has no phrases. Counts must stay below 10^16, or the decimals overflow with an
    error.
    """
    levels, sizes = frequent_phrases(docs, words, least)
    kept = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            # a longer phrase is no more frequent than the ones of one word more, so these decide
            within = longer.select(F.col("x").alias("rank"), F.col("f").alias("more")).union(longer.select("y", "f"))
            gone = level.select("rank", "f").join(within.groupBy("rank").agg(F.max("more").alias("more")), "rank").where(F.lit(100) * F.col("more") >= F.lit(covered) * F.col("f"))
            level = level.join(written(gone.select("rank"), "covered"), "rank", "left_anti")
        kept.append(level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    every = kept[0]
    for more in kept[1:]:
        every = every.union(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is None:
        every = sorted_ranks(every, F.asc("lang"), *order, name="at")
        first = every.groupBy("lang").agg(F.min("at").alias("first"))
        every = every.join(first, "lang").withColumn("rank", F.col("at") - F.col("first") + 1)
    else:
        for n in SALTS:  # no task ranks all candidates of a language
            mine = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
            every = every.withColumn("rank", F.row_number().over(mine).cast("long")).where(F.col("rank") <= top)
    return every.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
