"""Hashes of words and word shingles, vectorised over an Arrow batch of texts.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased, all
other bytes stay. Words are identified by keyed 128-bit BLAKE2b digests, shingles
by 128 bits made of these in two lanes that share nothing, with fixed parameters,
so that every executor and every rerun gives the same values. ``span_hashes`` is a
quick 64-bit hash for callers that compare what it finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cardamom.llm.words import coded

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LANES = np.array([0xD6E8FEB86659FD93, 0xCF1BBCDCBFA56301], np.uint64)
#: The first n bytes of eight, as they lie in a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are digested one by one.
CHAINED_BYTES = 64

#: Bytes of text hashed at a time; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCF1BBCDCBFA56301)
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about SLICE_BYTES; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, offs[a : b + 1] - offs[a], raw[offs[a] : offs[b]]
        a = b


def span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span raw[start:stop]; different spans may be made to share one."""
    size = stop - start
    h = mix(size.astype(np.uint64) * _ODD)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero((size > 0) & (size <= CHAINED_BYTES))
    done = 0
    while len(at):
        part = eight[start[at] + done] & FIRST[np.minimum(size[at] - done, 8)]
        h[at] = mix((h[at] ^ part) * _STEP + _ODD)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > CHAINED_BYTES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8, key=b"words").digest(), "little")
    return h


def word_digests(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests (two numbers each) of all lower-cased words in order, and for each row where its words begin (one more at the end).

    Words are told apart by comparison within a slice; each different one is digested once.
    """
    words = coded(offs, raw, lower=True)
    each = b"".join(hashlib.blake2b(w, digest_size=16, key=b"words").digest() for w in words.values.to_pylist())
    return np.frombuffer(each, np.uint64).reshape(-1, 2)[words.ids], words.at


def shingle_digests(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests (two numbers each) of all runs of k words within rows, and where each row's begin.

    A row of 1 to k-1 words has one shingle, its whole sequence; a row without words none.
    """
    n = np.diff(at)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(at[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    out = np.zeros((len(first), 2), np.uint64)
    short = np.repeat(n < k, per)
    full = first[~short]
    h = np.zeros((len(full), 2), np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _LANES + words[full + j]
    out[~short] = h
    for row in np.flatnonzero((n > 0) & (n < k)):
        whole = words[at[row] : at[row + 1]].tobytes()
        out[bounds[row]] = np.frombuffer(hashlib.blake2b(whole, digest_size=16, key=b"short").digest(), np.uint64)
    return mix(out), bounds


def distinct(h: np.ndarray) -> np.ndarray:
    """The different rows of two numbers, in ascending order."""
    s = h[np.argsort(h[:, 0], kind="stable")]
    new = s[1:, 0] != s[:-1, 0]
    if (s[1:, 1] != s[:-1, 1])[~new].any():  # first numbers alone do not tell them apart
        s = h[np.lexsort((h[:, 1], h[:, 0]))]
        new = (s[1:] != s[:-1]).any(axis=1)
    return s[np.concatenate([np.ones(min(1, len(s)), bool), new])]


def numbered(h: np.ndarray) -> np.ndarray:
    """A number from 0 for each row of two numbers, equal where both are."""
    _, first, number = np.unique(h[:, 0], return_index=True, return_inverse=True)
    number = number.ravel()
    if (h[first, 1][number] != h[:, 1]).any():
        _, number = np.unique(h, axis=0, return_inverse=True)
    return number.ravel()


def sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending different shingle digests) for every row."""
    for first, offs, raw in slices(texts):
        h, at = shingle_digests(*word_digests(offs, raw), k)
        for i in range(len(offs) - 1):
            yield first + i, distinct(h[at[i] : at[i + 1]])
