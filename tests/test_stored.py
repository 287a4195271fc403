"""What is written and found again: posting lists, lists of terms, places in context, records; and checks of two readings."""

import re

import pytest
from pyspark.sql import functions as F

from cardamom import corpora, queries
from cardamom.operators import browse, checks, display, index, kwic, rules, search, sets
from cardamom.operators.search import Near, Prefix, Term, Word
from cardamom.plans.numbering import own_folder
from cardamom.sources import cards, parse
from tests.test_cards import folder, line

VALS = "ord long, tag string, field_seq int, value_seq int, raw string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_posting_lists_hold_every_occurrence(spark, data):
    codes = {"/US": ("US",), "/TX": ("US", "AS")}
    lists = index.posting_lists(corpora.chat(spark, data), codes)
    want = index.positions(corpora.chat(spark, data), codes)
    assert sorted(map(tuple, index.occurrences(lists).collect())) == sorted(map(tuple, want.select("code", "term", "ord", "field_ord", "pos").collect()))
    assert lists.count() == want.select("code", "term", "ord").distinct().count()
    # occurrences are gathered where values were numbered
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan(lists))) == 1


def test_a_frequent_word_is_compared_by_hash(spark):
    rows = [(1, "TI", 1, 0, "the-x " * 100_000 + "end"), (2, "TI", 1, 0, "end " + "a " * 100_000 + "x")]
    own = search.built(spark.createDataFrame(rows, VALS), {}, {"/TI": ("TI",)}, ("/TI",))
    ords = lambda e: [r["ord"] for r in search.found(e, own).orderBy("ord").collect()]
    assert ords(Near("W", Word("X"), Word("END"))) == [1]
    assert ords(Near("N", Word("A"), Prefix("END"), 2)) == [2]
    assert ords(Near("F", Prefix("X"), Prefix("E"))) == [1, 2]


def test_an_index_is_refused_unless_complete_and_current(spark):
    vals = spark.createDataFrame([(1, "TI", 1, 0, "one two")], VALS)
    path = own_folder(spark, "marked")
    own = search.built(vals, {}, {"/TI": ("TI",)}, ("/TI",))
    with pytest.raises(ValueError, match="no complete index"):
        search.opened(spark, path, (), ("/TI",), ())
    search.write(own, path, (("file:/a", 10, 77),))
    assert search.opened(spark, path, (), ("/TI",), (), (("file:/a", 10, 77),)).words.count() == 2
    with pytest.raises(ValueError, match="have changed"):
        search.opened(spark, path, (), ("/TI",), (), (("file:/a", 10, 78),))


def test_answers_follow_a_table_that_changes(spark, tmp_path):
    docs = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.lit("this is it").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    for n in (3, 8, 3):
        docs(n).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert queries.s1_phrase_and_word(spark, str(tmp_path)).count() == n
        assert queries.x10_kwic(spark, str(tmp_path)).count() == 0


def test_browsing_reads_the_files_around_a_term(spark):
    terms = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "/TI").otherwise("/TX").alias("code"), F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("term"), F.col("id").alias("items"))
    path = own_folder(spark, "terms")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        browse.write_list(terms, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for code in ("/TX", "/TI", "/NO"):
        own, plain = browse.Listing(spark, path, code), terms.where(F.col("code") == code).select("term", "items")
        for term in (None, "A", "T00000", "T00001", "T02503", "T02505X", "T04999", "Z"):
            assert rows(browse.browse(own, term)) == rows(browse.browse(plain, term))
            assert term is None or browse.window(own, term) == browse.window(plain, term)
        for last in ("T00003", "T02503", "T04998"):
            assert rows(browse.next_page(own, last, 49)) == rows(browse.next_page(plain, last, 49))
            assert rows(browse.previous_page(own, last, 37)) == rows(browse.previous_page(plain, last, 37))
    whole = spark.read.parquet(path).inputFiles()
    near = browse.Listing(spark, path, "/TX").around("T02503")[0]
    assert len(whole) > 3 and len(near.inputFiles()) < len(whole)


def test_sets_are_sorted_and_ranked_without_moving_the_phrases(spark, data, monkeypatch):
    p = index.phrase_postings(corpora.orders(spark, data), corpora.ORDER_PHRASES)
    own = corpora.order_index(spark, data)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(own.forward.select("code", "term", "ord")) == rows(p.select("code", "term", "ord"))
    again = search.opened(spark, own.folder, own.phrase_codes, (), ())
    found = search.found(Term("OS", "O"), own)
    current = sets.result(found)
    by = [("OP", True), ("RF", False), ("LS", False)]
    sortable = ("OP", "RF", "LS")
    for forward in (own.forward, again.forward):
        assert rows(sets.sorted_set(current, forward, by, sortable)) == rows(sets.sorted_set(current, p, by, sortable))
        assert rows(sets.first_keys(forward, "RF")) == rows(sets.first_keys(p, "RF"))
        assert rows(sets.value_counts(forward, "OP", found)) == rows(sets.value_counts(p, "OP", found))
    joined = []
    monkeypatch.setattr(sets, "sorted_ranks", lambda df, *order: joined.append(df) or df.withColumn("rank", F.lit(1)))
    moved = lambda df: len(re.findall(r"(?<!Broadcast)Exchange ", plan(df)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written = spark.read.parquet(own.folder + "/phrase_terms").select(F.col("items").alias("ord"), F.col("items").alias("rank"))
        sets.sorted_set(written, own.forward, by, sortable)
        assert moved(joined[0]) == 1 and moved(written.select("ord")) == 0  # the set's own
        assert moved(sets.first_keys(own.forward, "RF")) == 0
        assert moved(sets.value_counts(own.forward, "OP", written)) == 2  # the set's own and that of the sums
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_from_stored_places(spark, data):
    vals = corpora.docs(spark, data).where("tag = 'TX'")
    path = own_folder(spark, "contexts")
    kwic.write(kwic.places(vals), path)
    stored = kwic.opened(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for words, stems in ((["THAT"], []), (["THAT", "LA"], ["CI"]), ([], ["Z"]), ([], []), (["NOWHERE"], [])):
        assert rows(kwic.windows(vals, words, stems, 9, stored)) == rows(kwic.windows(vals, words, stems, 9))
    hits = stored.where(kwic._meant(["THAT"], [], True))
    assert "(shard#" in plan(hits) and "= T)" in plan(hits)


def test_windows_of_odd_values(spark):
    texts = ["", " \u00a0\t", "-- that's, \u2003 a -- THATS  b\n", "thats", None, "\u00df thats \u0085 x" + " w" * 9]
    vals = spark.createDataFrame([(i, "TX", 1, 0, x) for i, x in enumerate(texts)], "ord long, tag string, field_seq int, value_seq int, raw string")
    got = [(r["ord"], r["start"], r["window"]) for r in kwic.windows(vals, ["THATS"], [], 3).orderBy("ord", "start").collect()]
    assert got == [(2, 0, "-- that's, a -- THATS b"), (3, 0, "thats"), (5, 0, "\u00df thats \u0085 ...")]


def test_records_are_fetched_from_the_files_that_hold_them(spark, monkeypatch):
    monkeypatch.setattr(parse, "RANGE", 40)
    names = [folder([x for i in range(300) for x in (line(b"$$"), line(b"AN", b"%07d" % (1000 * f + i)), line(b"TI", b"t"))]) for f in (1, 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = own_folder(spark, "fetched")
        stored = parse.write(parse.parsed(spark, names[0]), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = parse.fetched(spark, path, spark.createDataFrame([(5,), (6,), (5,), (9999,), (-1,)], "ord long"))
    assert sorted(r["an"] for r in got.collect()) == ["0001005", "0001006"]
    assert len(stored.inputFiles()) > 3 and len(got.inputFiles()) <= 2
    file = stored.first()["file"]
    got = parse.fetched(spark, path, spark.createDataFrame([(file, 1), (file, 4), (file, 5), ("file:/none", 1)], "file string, first_line long"))
    assert sorted(r["an"] for r in got.collect()) == ["0001000", "0001001"]  # line 5 begins no record
    assert parse.fetched(spark, path, spark.createDataFrame([], "ord long")).count() == 0


def test_an_audit_has_few_exchanges(spark, data):
    f = corpora.card_files(spark, data)
    audit = rules.audited(f.values, f.spans.select("ord"), f.orphans, queries._rp_vocabulary(spark, data), 94)
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan(audit))) <= 3
    ids = f.spans.select("ord")
    graded = {tuple(r) for r in rules.graded(audit).collect()}
    assert graded == {tuple(r) for r in rules.tiers(ids, rules.listed(audit), f.values).collect()}


def readings(spark, first, second):
    kinds = VALS + ", raw_bytes binary, code string, label string, percent string, line long, offset long, continuation boolean"
    vals = lambda rows: spark.createDataFrame([(1, t, f, v, raw, raw.encode("latin-1"), None, None, None, at, 82 * at, c) for t, f, v, raw, at, c in rows], kinds)
    spans = lambda an: spark.createDataFrame([(1, an, 1)], "ord long, an string, first_line long")
    got = checks.parity(spans("1"), vals(first), spans("1"), vals(second), ("TI",), "¬")
    return sorted((r["what"], r["first"], r["second"]) for r in got.collect())


def test_parity_permits_one_correction_and_nothing_else(spark):
    one, two = ("TI", 1, 0, "a   ¬b", 5, False), [("TI", 1, 0, "a", 5, False), ("TI", 1, 1, "b", 6, True)]
    assert readings(spark, [one], two) == []
    assert readings(spark, [one], two[:1]) != []  # not split
    assert readings(spark, [("TI", 1, 0, "a   ¬c", 5, False)], two) != []  # other characters
    assert readings(spark, [("TI", 1, 0, "a   ¬b", 6, False)], two) != []  # another line
    assert readings(spark, [("TI", 1, 0, "a   ¬b", 5, True)], two) != []  # a continuation
    assert readings(spark, two, [one]) != []  # the other way round
    assert readings(spark, [("SF", 1, 0, "a   ¬b", 5, False)], [("SF", *x[1:]) for x in two]) != []  # a tag that repeats
    assert readings(spark, two, [*two, ("SF", 2, 0, "x", 7, False)]) == [("SF", "null", "x")]
    gone = checks.parity(spark.createDataFrame([(1, "1"), (2, "2")], "ord long, an string"), spark.createDataFrame([], VALS + ", raw_bytes binary, code string, label string, percent string, line long, offset long, continuation boolean"), spark.createDataFrame([(1, "9"), (3, "3")], "ord long, an string"), spark.createDataFrame([], VALS + ", raw_bytes binary, code string, label string, percent string, line long, offset long, continuation boolean"))
    assert sorted((r["ord"], r["what"], r["first"], r["second"]) for r in gone.collect()) == [(1, "an", "1", "9"), (2, "record", "there", "null"), (3, "record", "null", "there")]


def test_lineage_names_the_file_and_its_digest(spark):
    import hashlib

    content = [line(b"$$"), line(b"AN", b"0000001"), line(b"TI", b"t")]
    path = folder(content)
    recs = parse.parsed(spark, path)
    lines = spark.createDataFrame([(7, 0), (8, 1)], "line_id long, ord long")
    got = {r["line_id"]: (r["file"], r["sha256"]) for r in display.with_files(lines, parse.spans(recs), cards.digests(spark, path, whole=True)).collect()}
    assert got[7] == (recs.first()["file"], hashlib.sha256(b"".join(content)).hexdigest()) and got[8] == (None, None)


def test_lineage_moves_only_values_of_its_sources(spark, data):
    lines = queries.j10_card_lineage(spark, data)
    text = lines._jdf.queryExecution().optimizedPlan().toString()
    above = text.split("Generate inline", 1)[0].rsplit("Join ", 1)[1]
    assert re.search(r"Filter \(*tag#\d+ IN \(TI,IN\)", above)  # dropped where they are read
    assert text.count("Relation [ord#") == 4  # what is shown, values, records, and their files
    got = {(r["an"], r["tag"]): r for r in lines.collect()}
    assert len(got) == 2 * corpora.table(spark, data, "part").count() == lines.count()
    assert got["0000007", "IN"]["raw"] == "SMITH 7" and all(r["same"] for r in got.values())


def test_sizes_of_folders_are_those_of_their_files(spark):
    path = own_folder(spark, "sizes")
    search.write(search.built(spark.createDataFrame([(1, "TI", 1, 0, "one two 3 -")], VALS), {"TI": ("TI",)}, {"/TI": ("TI",)}, ("/TI",)), path)
    got = {(r["part"], r["code"], r["shard"]): r["bytes"] for r in index.stored_sizes(spark, path).collect()}
    assert {k for k in got if k[0] == "places"} == {("places", "/TI", s) for s in "OT3"} and ("phrases", "TI", "O") in got
    assert all(n > 0 for n in got.values()) and ("word_terms", None, None) in got


def test_card_files_hold_the_same_records_whenever_they_are_written(spark, data, monkeypatch):
    monkeypatch.setattr(corpora, "FILE_RECORDS", 64, raising=False)
    held = []
    for edited in (False, True):
        f = corpora.CardFiles(spark, data, marked=True, edited=edited)
        held.append([(r["n"], r["low"], r["high"]) for r in f.spans.groupBy("file").agg(F.count("*").alias("n"), F.min("an").alias("low"), F.max("an").alias("high")).orderBy("file").collect()])
    assert held[0] == held[1] and [n for n, _, _ in held[0]] == [64, 64, 64, 8]


def test_texts_are_dealt_out_by_their_size(spark, data, monkeypatch):
    want = corpora._tasks(spark, (("a", corpora.TASK_BYTES * 6 + 1, 0),))
    assert want == 7 and corpora._tasks(spark, (("a", 1, 0),)) is None  # four shuffle partitions
    lists = index.posting_lists(corpora.docs(spark, data), corpora.DOC_WORDS, want)
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan(lists))) == 1 and "hashpartitioning(code" in plan(lists) and ", 7), REPARTITION_BY_NUM" in plan(lists)
    path = own_folder(spark, "sized")
    index.write_index(lists, path, want)
    assert len({f.rsplit("/", 1)[-1][:10] for f in spark.read.parquet(path).inputFiles()}) == 7


def test_card_lines_are_made_after_rows_are_dealt_out(spark, data):
    text = corpora.card_records(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("RepartitionByExpression", 1)
    assert "LOST" in above and "LOST" not in below  # no exchange and no sample sees a line


def test_card_files_are_dealt_out_without_a_sample(spark, data, monkeypatch):
    monkeypatch.setattr(corpora, "FILE_RECORDS", 64)  # of 200
    assert "rangepartitioning(part" not in plan(corpora.card_records(spark, data))


def test_an_audit_gathers_only_what_is_wrong(spark, data):
    f = corpora.card_files(spark, data)
    audit = rules.audited(f.values, f.spans.select("ord"), f.orphans, queries._rp_vocabulary(spark, data), 94)
    text = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in text and text.count("collect_list") == 1  # counts and sums need no lists
    # all values are dealt out by tag and field alone
    assert "raw" not in text.split("RepartitionByExpression", 1)[1].split("Generate", 1)[0]


def test_a_full_record_is_gathered_once(spark):
    rows = [(1, "RP", 1, 0, "a"), (1, "RP", 3, 0, "c"), (1, "RP", 1, 1, "b"), (1, "AC", 2, 0, "x"), (1, "TI", 4, 0, "t"), (2, "TI", 5, 0, "late"), (2, "TI", 2, 1, "early"), (2, "ZZ", 1, 0, "z"), (3, "ZZ", 1, 0, "z")]
    r = display.full_record(spark.createDataFrame(rows, VALS), ("RP", "AC"), ("RP", "ZZ"), ("TI",), ("RP",), parts={"more": ("ZZ", "AC")})
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan(r))) == 1 and "Join" not in plan(r)
    got = {x["ord"]: x.asDict(recursive=True) for x in r.collect()}
    row = lambda i, a, b, tags=("RP", "AC"): {"pos": i, tags[0]: a, tags[1]: b, "complete": a is not None and b is not None}
    assert got[1] == {"ord": 1, "TI": "t", "rp_all": ["a", "b", "c"], "grid": [row(0, "a", "x"), row(1, "b", None), row(2, "c", None)], "pairs": [row(i, x, None, ("RP", "ZZ")) for i, x in enumerate("abc")], "more": {"AC": "x"}}
    assert got[2] == {"ord": 2, "TI": "early", "rp_all": [], "grid": None, "pairs": [row(0, None, "z", ("RP", "ZZ"))], "more": {"ZZ": "z"}}
    assert got[3]["TI"] == "" and got[3]["grid"] is None


def test_posting_lists_are_made_without_sorting_occurrences(spark, monkeypatch):
    texts = ["", "the -- a-b-a ßıx", None, "X1 x1éx1 -the- AND-a", "ſt ﬁ -", "to"]
    rows = [(i % 7, "US" if i % 3 else "AS", 1, i, texts[i % 6]) for i in range(80)]
    vals, codes = spark.createDataFrame(rows, VALS), {"/US": ("US",), "/TX": ("US", "AS")}
    want = sorted(map(tuple, index.positions(vals, codes).select("code", "term", "ord", "field_ord", "pos").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # records go on in the next batch
    try:
        lists = index.posting_lists(vals, codes)
        assert "Aggregate" not in plan(lists) and "Window" not in plan(lists)
        assert sorted(map(tuple, index.occurrences(lists).collect())) == want
        assert lists.count() == lists.select("code", "term", "ord").distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers_of_values_are_compared_in_one_exchange(spark):
    rows = [(1, "AC", 1, 0, "a"), (1, "AC", 1, 1, "b"), (1, "CM", 2, 0, "c"), (2, "AC", 1, 0, "a"), (2, "CM", 2, 0, "c"), (3, "CT", 1, 0, "x"), (3, "ZZ", 2, 0, "z"), (4, "ZZ", 1, 0, "z"), (4, None, 2, 0, "z")]
    vals = spark.createDataFrame(rows, VALS)
    own = index.count_mismatches(vals, {"columns": ("AC", "CM"), "three": ("CT", "AC", "CM"), "one": ("AC",)})
    assert len(re.findall("Exchange ", plan(own))) == 1 and "Join" not in plan(own)
    assert sorted(map(tuple, own.collect())) == [("columns", 1), ("three", 1), ("three", 2), ("three", 3)]
    assert index.count_mismatches(vals, {}).collect() == []


def test_searches_by_phrase_build_no_words(spark, data, monkeypatch):
    monkeypatch.setattr(corpora, "_KEPT", {})
    assert queries.b4_order(spark, data).count() > 0
    assert [k[-1] for k in corpora._KEPT] == ["doc_phrases"] and corpora.doc_phrases(spark, data).places.count() == 0
    assert queries.s8_proximity_counts(spark, data).count() == 3
    assert sorted(k[-1] for k in corpora._KEPT) == ["doc_phrases", "doc_words"]
