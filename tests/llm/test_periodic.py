"""Runs against all periods of all places, digests against the contract's words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from cardamom.llm import periodic, queries


def brute(words):
    """Every maximal stretch with a shortest period q and at least max(6, 4q) words: (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def sequences(rng):
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], list(range(300)))
    for _ in range(150):
        kind, words = rng.randrange(4), []
        while len(words) < rng.choice((20, 120, 700)):
            root = [rng.randrange((2, 3, 50, 1000)[kind]) for _ in range(rng.choice((1, 2, 3, 7, 9, 16, 17, 31, 40, 64)))]
            if rng.random() < 0.3:  # a root with small periods inside
                root = root[:2] * rng.randrange(1, 30) + root
            words += root * rng.choice((1, 2, 3, 4, 5, 9)) + root[: rng.randrange(len(root) + 1)]
        yield words
    words = [0]
    while len(words) < 600:  # Thue-Morse has no cubes, Fibonacci words have some
        words += [1 - w for w in words]
    yield words
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    yield b


def expected(seqs):
    return [(i, a, n, q) for i, s in enumerate(seqs) for a, n, q in brute(s)]


def found(seqs):
    ids = np.array([w for s in seqs for w in s], np.int64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    return [(r, a, b - a, q) for r, a, b, q in periodic._runs_by_length(ids, at).tolist()]


def test_runs_are_those_of_all_periods():
    seqs = list(sequences(random.Random(5)))
    assert found(seqs) == expected(seqs)


def test_runs_survive_equal_hashes_of_different_contexts(monkeypatch):
    seqs = list(sequences(random.Random(6)))[:80]
    monkeypatch.setattr(periodic, "mix", lambda x: x & np.uint64(7))
    assert found(seqs) == expected(seqs)


def test_a_long_text_of_one_long_period():
    rng = np.random.Generator(np.random.PCG64(1))
    root = rng.integers(0, 1000, 7000).tolist()
    words = rng.integers(0, 1000, 500).tolist() + root * 5 + rng.integers(0, 1000, 500).tolist()
    (only,) = found([words])
    assert only[3] == 7000 and only[2] >= 35000


def digests(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(collapsed(words, runs)))


def table(spark, tmp_path, rows):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, runs string, w_ int, collapsed string").write.parquet(path)
    return str(tmp_path)


def test_query_on_odd_rows(spark, tmp_path):
    odd = ["", None, " \t\n ", "a", "a a a a a a", "b b b b " * 9, "x y z " * 40, "Ein Wört\x1fchen \x0b\x0c" * 30, "lang " * 3000 + "kurz " * 7]
    rows = [(i, odd[i % len(odd)], "r", 1, None) for i in range(60)] + [(None, "u v " * 8, None, None, ""), (7, "doppelt " * 6, None, None, ""), (7, "doppelt " * 6, None, None, "")]
    sf = table(spark, tmp_path, rows)
    got = queries.op11_periodic(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((digests(i, t) for i, t, *_ in rows), key=repr)
    assert queries.op11_periodic(spark, sf).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_empty_table(spark, tmp_path):
    assert queries.op11_periodic(spark, table(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_the_supplied_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 6000)
    want = {digests(r.doc_id, r.text) for r in docs.collect()}
    got = {tuple(r) for r in queries.op11_periodic(spark, sf).join(docs.select("doc_id"), "doc_id", "left_semi").collect()}
    assert got == want and any(r[1] for r in want)
