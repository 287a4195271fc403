"""Token counts of whole texts, without making ids.

Byte-pair merging with a heap of adjacent pairs and a linked list of symbols:
the count of a word is its symbols less its merges. A worker counts each
different word once while it remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.llm import bpe

LIMIT = 2048
_COUNTED: dict[str, bpe.Remembered] = {}


def _remembered(path: str) -> bpe.Remembered:
    if path not in _COUNTED:
        pieces = bpe.loaded(path)

        def make(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return np.array([pieces.heap_merges(w) for w in words], np.int64), np.ones(len(words), np.int64)

        _COUNTED[path] = bpe.Remembered(make)
    return _COUNTED[path]


def count_texts(path: str, texts: list[str]) -> np.ndarray:
    """The number of tokens of each text."""
    pieces, seen = bpe.loaded(path), _remembered(path)
    out = np.zeros(len(texts), np.int64)
    special = [i for i, t in enumerate(texts) if "<" in t and pieces.special.search(t)]
    plain = list(texts)
    for i in special:
        plain[i] = ""
    for first, text, code, begin, end, h, at in pieces.words(plain):
        sums = np.zeros(len(h) + 1, np.int64)
        if len(h):
            row = seen.rows(text, code, begin, end, h)
            np.cumsum(seen.flat[seen.begin[row]], out=sums[1:])
        out[first : first + len(at) - 1] = np.diff(sums[at])
    for i in special:
        # the strings of special tokens are one token each; what is between them is merged like any text
        at, parts = 0, []
        for m in pieces.special.finditer(texts[i]):
            parts.append(texts[i][at : m.start()])
            at = m.end()
        out[i] = len(parts) + sum(count_texts(path, [*parts, texts[i][at:]]))
    return out


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Null counts as empty: 0 bytes, 0 tokens. Rows with a null or repeated
    doc_id are counted like any other; other columns are ignored. An empty table
    stays empty.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            n = count_texts(path, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
