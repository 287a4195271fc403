"""Runs of repeated words in texts: maximal stretches that repeat a shortest period at least four times.

A stretch of period q that no neighbouring word extends is found from pairs of
places with equal contexts:

1. Periods up to ``SMALL`` are read off directly: words equal to the one q places on.
2. For each scale L = 16, 32, ... the periods from L/2 + 1 to L. The context of a
   place is the L words from it on. Its hash selects places: those whose context
   is least among the next or the last L/4 places. Selection looks at contents
   only, so that places one period apart are both selected; any L/2 places in a row
   hold one. A context of L >= q words recurs within such a stretch only after q
   words, so neighbours among the selected places of one context propose q.
3. Contexts with a period up to L/4 would be selected all over. They lie in
   stretches that smaller scales have found, which supply those periods; they are
   left out of the selection. L/2 places in a row cannot all be left out in a
   stretch whose shortest period is over L/2: that would have the small period.
4. A proposal is compared word by word and extended to both sides. Words are
   numbers that Arrow's dictionary gave, so that equality is exact; where contexts
   with one hash turn out to differ, the scale is done again with contexts named by
   comparison.

A stretch of length >= 4q holds the 2 * (L/4) + L + q words that step 2 looks at,
since L < 2q. The work is a few passes over the words for each scale that a text
is long enough for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardamom.llm.words import coded
from cardamom.llm.wordhash import mix, slices

TIMES, SHORTEST, SMALL = 4, 6, 8
_MOST = np.uint64(2**64 - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words compared at a time when proposals of one scale are checked.
_CHECKED = 1 << 22


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of True of at least ``least`` begin and end."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _lowest(h: np.ndarray, n: int) -> np.ndarray:
    """The least of h[i : i + n] for each i; beyond the end counts as greatest."""
    out, width = h.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out


def _context_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """From hashes of ``size`` words those of twice as many; contexts that pass the end get any value."""
    after = np.zeros_like(h)
    after[:-size] = h[size:]
    return mix((h ^ (h >> np.uint64(31))) * _STEP + after)


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether s[a:a+size] equals s[b:b+size], for each pair of places (both inside of s)."""
    out, here = np.zeros(len(a), bool), np.arange(size)
    for i in range(0, len(a), max(1, _CHECKED // size)):
        part = slice(i, i + max(1, _CHECKED // size))
        out[part] = (s[a[part, None] + here] == s[b[part, None] + here]).all(axis=1)
    return out


def _neighbours(s: np.ndarray, h: np.ndarray, omitted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, distance up to size) of neighbours among the selected places of one context."""
    width = size // 4
    h = np.where(omitted, _MOST, np.minimum(h, _MOST - np.uint64(1)))
    ahead = _lowest(h, width + 1)
    behind = _lowest(h[::-1], width + 1)[::-1]
    at = np.flatnonzero(((h == ahead) | (h == behind)) & ~omitted)
    at = at[at + size <= len(s)]
    order = np.argsort(h[at], kind="stable")
    near, key = at[order], h[at[order]]
    for exact in (False, True):
        gap = np.diff(near)
        pair = np.flatnonzero((key[1:] == key[:-1]) & (gap <= size) & (near[1:] + size <= len(s)))
        a, d = near[pair], gap[pair]
        if exact or _equal(s, a, a + d, size).all():
            return a, d
        _, name = np.unique(np.lib.stride_tricks.sliding_window_view(s, size)[at], axis=0, return_inverse=True)
        order = np.argsort(name.ravel(), kind="stable")
        near, key = at[order], name.ravel()[order]
    raise AssertionError


def _reach(s: np.ndarray, x: int, d: int, by: int) -> int:
    """How many places from x on (by = 1) or back (by = -1) equal those d after them."""
    n, width = 0, 32
    while True:
        a = s[x + n : x + n + width] if by > 0 else s[max(0, x - n - width + 1) : max(0, x - n + 1)]
        b = s[x + n + d : x + n + d + width] if by > 0 else s[max(0, x - n - width + 1) + d : max(0, x - n + 1) + d]
        size = min(len(a), len(b))
        if not size:
            return n
        other = (a[:size] != b[:size]) if by > 0 else (a != b)[::-1]
        if other.any():
            return n + int(other.argmax())
        n, width = n + size, width * 2


def runs(s: np.ndarray, longest: int) -> np.ndarray:
    """(begin, end, period) of all runs in s, by begin and period. ``longest``: words between two separators at most.

    Separators are numbers that occur once; s begins and ends with one.
    """
    found = []
    for q in range(1, min(SMALL, longest // TIMES) + 1):
        begin, end = _stretches(s[q:] == s[:-q], max(SHORTEST, TIMES * q) - q)
        found.append(np.stack([begin, end + q, np.full(len(begin), q)], axis=1))
    size = 2 * SMALL
    h = mix(s.astype(np.uint64) * _STEP)
    for k in (1, 2, 4, 8):
        h = _context_hashes(h, k) if longest > 2 * size and len(h) > k else h
    while longest > 2 * size:  # periods over size / 2, four times
        known = np.concatenate(found)
        known = known[(known[:, 2] <= size // 4) & (known[:, 1] - known[:, 0] >= size)]
        marks = np.zeros(len(s) + 1, np.int64)
        np.add.at(marks, known[:, 0], 1)
        np.add.at(marks, known[:, 1] - size + 1, -1)
        place, gap = _neighbours(s, h, np.cumsum(marks)[:-1] > 0, size)
        here = np.flatnonzero(gap > size // 2)
        here = here[np.lexsort((place[here], gap[here]))]
        new, last, until = [], 0, 0
        for x, d in zip(place[here].tolist(), gap[here].tolist(), strict=True):
            if d == last and x < until:
                continue
            begin, end = x + 1 - _reach(s, x, d, -1), x + _reach(s, x, d, 1) + d
            last, until = d, end - d
            if end - begin >= max(SHORTEST, TIMES * d):
                new.append((begin, end, d))
        if new:
            found.append(np.array(new, np.int64))
        h = _context_hashes(h, size) if size < len(h) else h
        size *= 2
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # a stretch with a period also has its multiples; the least is its own
    own = np.ones(len(every), bool)
    own[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[own]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _runs_by_length(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(row, begin, end, period) for rows of words ids[at[i]:at[i + 1]]. Rows of like length are looked through together."""
    size, out = np.diff(at), []
    scale = np.where(size < SHORTEST, -1, np.ceil(np.log2(np.maximum(size, 1) / (4.0 * SMALL)))).astype(np.int64)
    for k in np.unique(np.maximum(scale, 0)[size >= SHORTEST]).tolist():
        rows = np.flatnonzero((size >= SHORTEST) & (np.maximum(scale, 0) == k))
        n = size[rows]
        begins = np.concatenate([[1], np.cumsum(n + 1) + 1])  # a separator before each row and at the end
        s = np.empty(begins[-1], np.int64)
        s[begins - 1] = -1 - np.arange(len(begins))
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s[np.repeat(begins[:-1], n) + within] = ids[np.repeat(at[rows], n) + within]
        got = runs(s, int(n.max()))
        row = np.searchsorted(begins, got[:, 0], "right") - 1
        out.append(np.column_stack([rows[row], got[:, 0] - begins[row], got[:, 1] - begins[row], got[:, 2]]))
    every = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return every[np.argsort(every[:, 0], kind="stable")]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
    for batch in batches:
        for first, offs, raw in slices(batch.column("_text")):
            words = coded(offs, raw)
            got = _runs_by_length(words.ids, words.at)
            rows = len(offs) - 1
            marks = np.zeros(len(words.ids) + 1, np.int64)
            np.add.at(marks, words.at[got[:, 0]] + got[:, 1] + got[:, 3], 1)
            np.add.at(marks, words.at[got[:, 0]] + got[:, 2], -1)
            kept = np.cumsum(marks)[:-1] == 0
            value = np.array([*words.values.to_pylist(), None], object)[:-1]
            texts = [b" ".join(value[words.ids[a:b][kept[a:b]]].tolist()).decode() for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)]
            flat = pa.StructArray.from_arrays([pa.array(got[:, 1]), pa.array(got[:, 2] - got[:, 1]), pa.array(got[:, 3])], fields=list(_RUN))
            bounds = pa.array(np.searchsorted(got[:, 0], np.arange(rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(bounds, flat)
            yield pa.RecordBatch.from_arrays([batch.column("_doc_id").slice(first, rows), pa.array(np.diff(words.at)), lists, pa.array(texts, pa.string())], schema=schema)


def periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs.

    runs: array of (start, length, period) in words from 0, by start and period,
    of the maximal stretches with a shortest period q and at least max(6, 4q)
    words. collapsed: the words joined by one space, without those that stand in
    a run after its first q words. Null or empty texts, and texts without words,
    have no runs and an empty collapsed text. Rows with a null or repeated doc_id
    are looked through like any other; an empty table stays empty; other columns
    are ignored. A text is one row of one task, however long.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("_doc_id"), docs["text"].cast("string").alias("_text"))
    kind = "_doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return base.mapInArrow(_marked, kind).withColumnRenamed("_doc_id", "doc_id")


def longest(runs: Column) -> Column:
    """The run of greatest length, of those the one of least start, then period; null if there is none."""
    r = F.array_max(F.transform(runs, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    return F.when(r.isNotNull(), F.struct((-r["s"]).alias("start"), r["length"].alias("length"), (-r["p"]).alias("period")))


def listed(runs: Column) -> Column:
    """A line `start,length,period` for each run, each with its line end."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """docs in which a tenth of the texts is made periodic from some word on, chosen and shaped by the CRC-32 of the doc_id.

    With g = floor(crc / 10), n words, a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)),
    word i >= a becomes word a + (i - a) mod p, where crc mod 10 is 0 and n > 0.
    Rows without a doc_id stay as they are, and so do texts without words.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("w_").cast("long"), F.floor(crc / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w_", F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")))
    df = docs.withColumn("w_", F.when(F.pmod(crc, F.lit(10)) == 0, words))
    return df.withColumn("text", F.when(F.size("w_") > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("w_")
