"""Word-piece boundaries and byte-pair merges of a tokenizer file (.json, byte-level, with word ends).

Texts are cut into words by table look-ups over their code points, many texts at
a time. A hash only finds longer words that may be equal; their characters are
compared. Each different word is merged once per worker. ``heap_merges`` counts merges with a heap and a linked list;
``merged_ids`` gives the ids of many words at once. A text that contains a
special token's string goes to the tokenizer library itself.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex

from cardamom.llm import wordhash

_LETTER, _NUMBER, _OTHER = 1, 2, 3
_HASHED = np.uint64(1 << 63)
#: Characters of text cut at a time, and words remembered by a worker, at most.
SLICE_CHARS, REMEMBERED = 1 << 20, 250_000
_QUOTE = ord("'")
_LOADED: dict[str, WordPieces] = {}


def loaded(path: str) -> WordPieces:
    """The tokenizer of this file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = WordPieces(path)
    return _LOADED[path]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else 256 and up."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def _classes() -> np.ndarray:
    """The class of each code point as the library's own patterns see it (Unicode versions differ)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((0, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        found = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(every))
        for text, _ in found:
            table[[ord(c) for c in text]] = kind
    return table


def _newer() -> dict[int, str]:
    """Capitals whose small letters the library knows and this Python does not yet."""
    from tokenizers.normalizers import Lowercase

    every = [c for c in map(chr, range(0x80, 0xD800))] + [chr(c) for c in range(0xE000, 0x110000)]
    theirs = Lowercase().normalize_str("\n".join(every)).split("\n")
    return {ord(c): t for c, t in zip(every, theirs, strict=True) if t != c.lower()}


class WordPieces:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.rank = {}
        for r, (a, b, c) in enumerate(pairs):
            self.rank.setdefault((a, b), (r, c))
        key = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(key)
        self.keys = key[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.made = np.array([c for _, c in self.rank.values()], np.int64)[order]
        self.table, self.newer = _classes(), _newer()
        self.newer_from = min(self.newer, default=0x110000)
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library().encode(text, add_special_tokens=False).ids, np.int64)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return text.lower()

    def words(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of texts: first text, the normalised slice and its code points, starts, ends and hashes of its words, and where each text's words begin."""
        a = 0
        while a < len(texts):
            part, n = [], 0
            while a + len(part) < len(texts) and (not part or n < SLICE_CHARS):
                part.append(self.normal(texts[a + len(part)]))
                n += len(part[-1])
            yield (a, *self._cut(part))
            a += len(part)

    def _cut(self, part: list[str]):
        text = "\n".join(part) + "\n"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if code.max() >= self.newer_from:
            text = text.translate(self.newer)
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.table[code]
        start = np.empty(len(kind), bool)
        start[0] = kind[0] != 0
        start[1:] = (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER))
        quotes = np.flatnonzero((code == _QUOTE) & start)
        for q in quotes.tolist():
            size = 2 if text[q + 1] in "stmd" else 3 if text[q + 1 : q + 3] in ("re", "ve", "ll") else 0
            if size:
                start[q + 1] = False
                start[q + size] = kind[q + size] != 0
        bounds = np.flatnonzero(start | (kind == 0))
        is_word = start[bounds]
        begin, end = bounds[is_word], bounds[1:][is_word[:-1]]  # the last bound is the closing line end
        h = _word_keys(text, code, begin, end)
        rows = np.concatenate([[0], np.cumsum([len(p) + 1 for p in part])])
        return text, code, begin, end, h, np.searchsorted(begin, rows)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return [*self.inner[list(raw[:-1])].tolist(), int(self.last[raw[-1]])]

    def heap_merges(self, word: str) -> int:
        """Tokens of a word: its symbols less the merges, lowest rank first, leftmost among equals."""
        sym = self.symbols(word)
        n = left = len(sym)
        if n == 1:
            return 1
        rank = self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((made, sym[k])):
                    heapq.heappush(heap, (r[0], i, made, sym[k], r[1]))
            p = before[i]
            if p >= 0 and (r := rank.get((sym[p], made))):
                heapq.heappush(heap, (r[0], p, sym[p], made, r[1]))
        return left

    def merged_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has); every round merges each word's lowest pair."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(n) - 1
        sym[ends] = self.last[flat[ends]]
        done_ids: list[np.ndarray] = []
        done_of: list[np.ndarray] = []
        of = np.repeat(np.arange(len(words)), n)
        while len(sym):
            same = of[1:] == of[:-1]
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            firsts = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, firsts)
            counts = np.diff(np.append(firsts, len(sym)))
            least_at = np.repeat(least, counts)
            open_ = least_at != np.iinfo(np.int64).max
            if not open_.all():
                done_ids.append(sym[~open_])
                done_of.append(of[~open_])
            # the leftmost of overlapping pairs goes first: every other one in a run of hits
            hit = open_ & (rank == least_at)
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
            hit &= (place - run_start) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[at[where]]
            keep = open_.copy()
            keep[where + 1] = False
            sym, of = sym[keep], of[keep]
        if not done_ids:
            return np.zeros(0, np.int64), n
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))


def _word_keys(text: str, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word: its own eight bytes if it is ASCII and that short, else a hash with the first bit set."""
    size = end - begin
    short = size <= 8
    odd = (code == 0) | (code > 127)
    if odd.any():
        before = np.concatenate([[0], np.cumsum(odd)])
        short &= before[end] == before[begin]
    eight = np.ndarray((len(code) + 1,), np.uint64, np.concatenate([code.astype(np.uint8), np.zeros(8, np.uint8)]), strides=(1,))
    keys = eight[begin] & wordhash.FIRST[np.minimum(size, 8)]
    rest = np.flatnonzero(~short)
    keys[rest] = wordhash.span_hashes(code.view(np.uint8), 4 * begin[rest], 4 * end[rest]) | _HASHED
    return keys


def _equal_words(code: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the characters of each word are those from ``other`` on; both have one length."""
    size = end - begin
    same = np.ones(len(begin), bool)
    at = np.flatnonzero(other != begin)
    done = 0
    while len(at) and done < 16:  # most words are short
        same[at] = code[begin[at] + done] == code[other[at] + done]
        done += 1
        at = at[same[at] & (size[at] > done)]
    for i in at.tolist():
        same[i] = np.array_equal(code[begin[i] + done : end[i]], code[other[i] + done : other[i] + size[i]])
    return same


class Remembered:
    """Rows of values by word, made for words not met before; emptied when it holds too many."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.begin, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64), 0

    def rows(self, text: str, code: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For each word its row: begin and count point into flat."""
        codes, unique = pd.factorize(h)
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        of = first[codes]
        same = end - begin == end[of] - begin[of]
        hashed = np.flatnonzero(same & (h >= _HASHED))
        same[hashed] = _equal_words(code, begin[hashed], end[hashed], begin[of[hashed]])
        words = [text[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        # words whose hash is that of another one in this slice
        odd = np.flatnonzero(~same)
        if len(odd):
            number = {w: i for i, w in enumerate(dict.fromkeys(text[begin[i] : end[i]] for i in odd))}
            codes = codes.copy()
            codes[odd] = [len(words) + number[text[begin[i] : end[i]]] for i in odd]
            words += number
        if len(self.row) + len(words) > REMEMBERED:
            self.clear()
        row = self.row
        new = [w for w in words if w not in row]  # no word is there twice
        if new:
            flat, count = self.make(new)
            size = len(row)
            self._fit(size + len(new), self.used + len(flat))
            self.count[size : size + len(new)] = count
            self.begin[size : size + len(new)] = self.used + np.cumsum(count) - count
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            row.update(zip(new, range(size, size + len(new)), strict=True))
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))[codes]

    def _fit(self, rows: int, values: int) -> None:
        while rows > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while values > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
