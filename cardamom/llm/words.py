"""The words of an Arrow batch of texts as numbers: equal numbers are equal bytes, decided by comparison.

Texts are cut with numpy and numbered by Arrow's dictionary, a slice of about a
megabyte at a time, so that nothing is decided by a hash and no word passes
through the interpreter by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space between words: 0x20 and 0x09-0x0D.
SPACE = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Coded:
    """ids of all words in order; at: where each row's begin (one more at the end); values: the bytes of each id; broken: whether a break lies before a word."""

    ids: np.ndarray
    at: np.ndarray
    values: pa.Array
    broken: np.ndarray | None


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def coded(offs: np.ndarray, raw: np.ndarray, lower: bool = False, breaks: bytes = b"") -> Coded:
    """The words of rows raw[offs[i]:offs[i + 1]]: runs of bytes that are neither white space nor one of ``breaks``.

    With ``breaks``, ``broken`` tells for each word whether its row begins or a
    break lies between it and the word before.
    """
    raw = _LOWER[raw] if lower else raw
    word = ~_table(SPACE + breaks)[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = word[begins]
    start = np.flatnonzero(first)
    bounds = np.append(np.cumsum(word)[start] - 1 if len(start) else start, np.count_nonzero(word)).astype(np.int64)
    both = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[word]))]).dictionary_encode()
    at = np.searchsorted(start, offs)
    broken = None
    if breaks:
        passed = np.concatenate([[0], np.cumsum(_table(breaks)[raw])])[start]
        broken = np.diff(passed, prepend=-1) > 0
        broken[at[:-1][at[:-1] < at[1:]]] = True
    return Coded(both.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, both.dictionary, broken)
