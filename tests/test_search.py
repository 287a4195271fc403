import pytest
from pyspark.sql import functions as F

from cardamom.operators import browse, checks, index, kwic, search, sets
from cardamom.operators.search import And, Near, Not, Or, Prefix, Refs, SetOf, Term, Word
from cardamom import corpora
from cardamom.operators.search import PhrasePrefix
from cardamom.plans.numbering import carried, own_folder, sorted_ranks

VALS = [
    (1, "TI", 1, 0, "Fresh water fish"), (1, "OB", 1, 0, "Water, the fresh kind"), (2, "TI", 1, 0, "Fresh the water"), (2, "TI", 2, 0, "fish"),
    (3, "TI", 1, 0, "Fresh-water fish"), (3, "CY", 1, 0, "Beltsville "), (4, "CY", 1, 0, "BELTSVILLE"), (4, "TI", 1, 0, ""), (5, "OB", 1, 0, "water water fresh"),
]
WORDS = {"/TI": ("TI",), "/OB": ("OB",), "/TX": ("OB", "TI")}


@pytest.fixture(scope="module")
def vals(spark):
    return spark.createDataFrame(VALS, "ord long, tag string, field_seq int, value_seq int, raw string")


@pytest.fixture(scope="module")
def idx(vals):
    return search.built(vals, {"CY": ("CY",)}, WORDS, ("/TI", "/OB"))


def ords(e, idx):
    return sorted(r["ord"] for r in search.found(e, idx).collect())


def test_operands(idx):
    assert ords(Term("CY", "beltsville"), idx) == [3, 4]
    assert ords(Term("CY", "nowhere"), idx) == []
    assert ords(Word("water", ("/TI",)), idx) == [1, 2, 3]
    assert ords(Word("fresh water", ("/TI",)), idx) == []  # keyed, not cut
    assert ords(Word("THE", ("/TI",)), idx) == []
    assert ords(Prefix("FR"), idx) == [1, 2, 3, 5]
    assert ords(And(Word("FISH"), Not(Word("FRESH"), Term("CY", "BELTSVILLE"))), idx) == [1, 2]
    assert ords(Or(SetOf(search.found(Term("CY", "BELTSVILLE"), idx)), Word("FISH")), idx) == [1, 2, 3, 4]


def test_proximity(idx):
    fresh, water = Word("FRESH", ("/TI",)), Word("WATER", ("/TI",))
    assert ords(Near("W", fresh, water), idx) == [1]  # a stop word between counts; parts of one word share its place
    assert ords(Near("W", fresh, water, 2), idx) == [1, 2]
    assert ords(Near("N", water, fresh, 2), idx) == [1, 2]
    assert ords(Near("F", water, fresh), idx) == [1, 2, 3]
    assert ords(Near("F", Word("FRESH", ("/TI",)), Word("FISH", ("/TI",))), idx) == [1, 3]
    assert ords(Near("F", Word("KIND", ("/TX",)), Word("FISH", ("/TX",))), idx) == []  # two tags are two fields
    got = search.operand_counts(Near("W", fresh, water), idx).orderBy("seq").collect()
    assert [(r["seq"], r["items"]) for r in got] == [(1, 3), (2, 3), (3, 1)]


def test_unknown_codes_are_refused(idx):
    for e in (Term("QQ", "X"), PhrasePrefix("QQ", "X"), Word("X", ("/QQ",)), And(Word("FISH"), Prefix("X", ("/QQ",))), Near("W", Word("X", ("/QQ",)), Word("FISH")), Refs(idx.word_terms, ("/QQ",))):
        with pytest.raises(ValueError, match="unknown"):
            search.found(e, idx)
    for e in (Term("ZP", "X"), Word("X", ("/PB",)), Word("X", ("/DF",)), Near("F", Prefix("X", ("/AP",)), Word("FISH"))):
        with pytest.raises(ValueError, match="not in this index"):
            search.found(e, idx)
    assert ords(PhrasePrefix("CY", "bel"), idx) == [3, 4] and ords(Prefix("", ("/OB",)), idx) == [1, 5]


def test_written_index_gives_the_same_sets_from_few_folders(spark, idx, data):
    folder = own_folder(spark, "test")
    search.write(idx, folder)
    own = search.opened(spark, folder, ("CY",), tuple(WORDS), ("/TI", "/OB"))
    fresh, water = Word("FRESH", ("/TI",)), Word("WATER", ("/TI",))
    for e in (Term("CY", "beltsville"), water, Prefix("FR"), Near("N", water, fresh, 2), Near("F", water, fresh), Not(fresh, Term("CY", "BELTSVILLE")), Prefix("")):
        assert ords(e, own) == ords(e, idx)
    assert sorted(map(tuple, own.word_terms.collect())) == sorted(map(tuple, idx.word_terms.collect()))
    own.word_terms.withColumnRenamed("items", "n").write.parquet(f"{folder}/other")
    with pytest.raises(ValueError, match="items: None instead of bigint"):
        checks.loaded(spark, f"{folder}/other", "code string, term string, items long")
    index.write_index(idx.words.where("false").drop("shard"), f"{folder}/none")
    assert index.open_index(spark, f"{folder}/none").count() == 0
    docs = corpora.doc_index(spark, data)
    assert corpora.doc_index(spark, data).words.inputFiles() == docs.words.inputFiles()  # written once
    for e, shard in ((And(Word("THIS", ("/TX",)), Term("LA", "EN")), "T"), (Prefix("TION", ("/TX",)), "T"), (Near("W", Word("ON"), Word("IN"), 3), "I"), (PhrasePrefix("SO", "SRC"), "S")):
        plan = search.found(e, docs)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and plan.count("Scan parquet") == plan.count("PartitionFilters: [isnotnull(code") + plan.count("PartitionFilters: [isnotnull(shard")
        assert f"(shard#" in plan and f"= {shard})" in plan
    page = browse.browse(docs.word_terms.where("code = '/TX'").select("term", "items"), "TION")
    assert "documents.parquet" not in page._jdf.queryExecution().executedPlan().toString()


def test_wide_proximity_in_long_values(spark):
    rows = [(1, "TI", 1, 0, "a " * 3000 + "b " * 3000), (2, "TI", 1, 0, "b x a"), (3, "TI", 1, 0, "a x x x x b")]
    own = search.built(spark.createDataFrame(rows, "ord long, tag string, field_seq int, value_seq int, raw string"), {}, {"/TI": ("TI",)}, ("/TI",))
    for kind, within, want in (("W", 3, [1]), ("N", 2, [1, 2]), ("W", 5, [1, 3]), ("N", 1, [1])):
        assert ords(Near(kind, Word("A"), Word("B"), within), own) == want


def test_previous_page(spark):
    terms = spark.createDataFrame([(f"T{i:02}", i) for i in range(60)], "term string, items long")
    got = lambda last: [(r["ref"], r["term"]) for r in browse.previous_page(terms, last, 37).orderBy("term").collect()]
    assert got("T35")[0] == (13, "T12") and got("T35")[-1] == (24, "T23") and got("T17")[0][1] == "T00" and len(got("T05")) == 6


def test_kwic_terms():
    a, b, c = Word("a"), Prefix("b"), Word("c")
    assert kwic.terms_of(And(Near("W", a, b), c)) == (["C"], []) and kwic.terms_of(Near("W", a, b)) == ([], [])
    assert kwic.terms_of(Or(And(a, Term("CY", "x")), b)) == (["A"], ["B"])


def test_kwic_without_words_shows_nothing(vals, idx):
    assert kwic.of_set(vals, sets.result(search.found(Term("CY", "BELTSVILLE"), idx)), Term("CY", "BELTSVILLE")).count() == 0


def test_steps_and_counts(idx):
    e = And(Word("FISH"), Term("CY", "BELTSVILLE"))
    assert {r["step"]: r["n"] for r in search.steps(e, idx).groupBy("step").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 2, 3: 1}
    with pytest.raises(ValueError):
        search.found("x", idx)


def test_sets(spark):
    s = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 7), (3, 6), (3, 5)], "set_id int, ord long")
    got = lambda op, a=1, b=3: sorted(r["ord"] for r in sets.combine(s, a, b, op).collect())
    assert got("AND") == [6] and got("OR", 1, 2) == [5, 6, 7] and got("NOT", 1, 2) == [5] and got("NOT") == []
    with pytest.raises(ValueError):
        sets.combine(s, 3, 1, "AND")
    with pytest.raises(ValueError):
        sets.parse_items("5-3")


def test_sort_is_stable(spark):
    current = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4)], "ord long, rank long")
    phrases = spark.createDataFrame([("ST", "MD", 10), ("ST", "CA", 20), ("ST", "MD", 30), ("ST", "AL", 30)], "code string, term string, ord long")
    got = lambda d: [r["ord"] for r in sets.sorted_set(current, phrases, [("ST", d)]).orderBy("rank").collect()]
    assert got(False) == [40, 30, 20, 10]
    assert got(True) == [10, 20, 30, 40]
    with pytest.raises(ValueError):
        sets.sorted_set(current, phrases, [("XX", False)])


def test_browse_windows(spark):
    terms = spark.createDataFrame([(f"T{i:02}", i) for i in range(1, 15)], "term string, items long")
    page = lambda x: [(r["ref"], r["term"], r["items"], r["starred"]) for r in browse.browse(terms, x).orderBy("term").collect()]
    assert page("T06")[0] == (1, "T03", 3, False) or page("T06")[0][1] == "T03"
    middle = page("T03")
    assert middle[0][1] == "T01" and middle[2] == (3, "T03", 3, True) and len(middle) == 12
    assert page("A")[0] == (1, "A", 0, True)
    last = page("Z")
    assert last[-1] == (12, "Z", 0, True) and last[0][1] == "T04"
    assert [r["ref"] for r in browse.next_page(terms, "T02", 49).orderBy("term").collect()][:3] == [49, 50, 1]
    few = spark.createDataFrame([("A", 1), ("B", 2)], "term string, items long")
    assert browse.browse(few, "B").count() == 2 and browse.browse(few.limit(0), "B").count() == 1


def brute_windows(text, words, size):
    ws = text.split()
    n, out = len(ws), []
    for i, w in enumerate(ws):
        if "".join(c for c in w.upper() if c.isascii() and c.isalnum()) in words:
            a, b = i - size // 2, i + (size - 1) // 2
            if a < 0:
                a, b = 0, b - a
            if b > n - 1:
                a, b = a - (b - n + 1), n - 1
            out.append((max(0, a), b))
    merged = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [("... " if a else "") + " ".join(ws[a : b + 1]) + (" ..." if b < n - 1 else "") for a, b in merged]


@pytest.mark.parametrize("size", [2, 3, 4, 7, 30])
def test_kwic_against_brute_force(spark, data, size):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).select(F.col("doc_id").alias("ord"), F.lit("TI").alias("tag"), F.lit(1).alias("field_seq"), F.lit(0).alias("value_seq"), F.col("text").alias("raw"))
    rows = {r["ord"]: r["raw"] for r in docs.collect()}
    got = {}
    for r in kwic.windows(docs, ["THAT", "LA", "DE"], [], size).orderBy("ord", "start").collect():
        got.setdefault(r["ord"], []).append(r["window"])
    assert got == {k: w for k, v in rows.items() if (w := brute_windows(v, {"THAT", "LA", "DE"}, size))}
    with pytest.raises(ValueError):
        kwic.windows(docs, ["X"], [], 51)


def test_numbering(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "ord")
    got = [r["rank"] for r in sets.result(ids).orderBy("ord").collect()]
    assert got == list(range(1, len(got) + 1))
    got = [(r["rank"], r["k"]) for r in sorted_ranks(ids.withColumn("k", -F.col("ord")), F.col("k")).orderBy("rank").collect()]
    assert [r for r, _ in got] == list(range(1, len(got) + 1)) and [k for _, k in got] == sorted(k for _, k in got)
    marks = spark.range(1, 1000).select(F.lit("f").alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 137 == 5, F.col("id")).alias("m"))
    for r in carried(marks, "g", "n", "m", "last", chunk=10).collect():
        want = max((x for x in range(1, r["n"] + 1) if x % 137 == 5), default=None)
        assert r["last"] == want


def test_checks(spark, idx):
    t = spark.createDataFrame([("A", 2), ("B", 3)], "code string, terms long")
    m = spark.createDataFrame([("A", 2), ("C", 1)], "code string, expected long")
    assert [r["code"] for r in checks.manifest_faults(t, m).collect()] == ["C"]
    assert sorted(r["code"] for r in checks.manifest_faults(t, m, strict=True).collect()) == ["B", "C"]
    assert checks.drifted(index.term_list(idx.words), idx.words).isEmpty()
    assert checks.schema_faults(t, {"code": "string", "terms": "bigint"}) == []
    assert ords(Refs(spark.createDataFrame([("FISH",)], "term string"), ("/TI",)), idx) == [1, 2, 3]
