"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from cardamom.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            seq = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(seq)
            for k in range(1, words + 1):
                for i in range(len(seq) - k + 1):
                    f.setdefault(lang, Counter())[tuple(seq[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, more in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * more >= covered * cands[p[i : i + k]]:
                        gone.add(p[i : i + k])
        mine = []
        for p, a in cands.items():
            if p not in gone:
                score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "ab", "Äther", "é", "x\x1fy", "..", "a-b", "$5", *(f"w{i}" for i in range(40))]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(words[: rng.choice((5, 13, 53))]))
            parts.append(rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; ")))
        rows.append((("en", "de", None, "und")[rng.randrange(4)], "".join(parts)))
    return [*rows, ("en", ""), ("en", None), ("fr", " \t ,,"), ("en", "the the " * 5000), ("xx", "only once here")]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "c", 7) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, chunk string, n int")


def test_phrases_are_those_of_plain_counting(spark):
    rows = texts(1)
    want = brute(rows)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == want and len(want) > 40
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), top=5).collect())) == brute(rows, top=5)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), top=None).collect())) == brute(rows, top=10**9)


def test_longer_phrases_by_one_more_level(spark):
    rows = texts(2, 200)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), words=4, least=4, covered=70).collect())) == brute(rows, 4, 4, 70)


def test_small_chunks_tiles_and_buckets_give_the_same(spark, monkeypatch):
    rows = texts(3)
    for name, value in (("CHUNK_WORDS", 500), ("BUCKET_WORDS", 100), ("TILE", 4), ("FILLED", 0.2)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_tiles_counted_densely_and_by_sorting():
    rng = np.random.Generator(np.random.PCG64(3))
    x, y = (np.minimum(rng.geometric(0.002, 400_000), 5000) for _ in "xy")
    xs, ys, n, place = phrases.tile_counts(x, y, 5000)
    assert Counter(zip(x.tolist(), y.tolist(), strict=True)) == dict(zip(zip(xs.tolist(), ys.tolist(), strict=True), n.tolist(), strict=True))
    assert (xs[place] == x).all() and (ys[place] == y).all()


def test_arrays_survive_packing():
    for a in ([], [0], [5, 3, 9], [2**62, -(2**62), 7], list(range(1000))):
        assert phrases.unpacked(phrases.packed(np.array(a, np.int64))).tolist() == a


def test_empty_tables_and_texts_without_candidates(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("en", None), (None, ""), ("de", "kein Wort zweimal")])).collect() == []


def test_query_on_the_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    got = queries.op12_phrases(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs.collect()])
