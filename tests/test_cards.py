import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cardamom.operators import rules
from cardamom.sources import cards


def line(tag, data=b"", end=b"\r\n"):
    return (tag + b" " + data).ljust(80)[:80] + end


def folder(*files):
    d = tempfile.mkdtemp(prefix="spark-")
    for i, content in enumerate(files):
        with open(os.path.join(d, f"RG{i}64.CARDS.FY9{i}.txt"), "wb") as f:
            f.write(b"".join(content))
    return "file://" + d


FILE = [
    line(b"<<", b"head"), line(b"XX", b"outside"), line(b"$$"), line(b"  ", b"lost"), line(b"AN"), line(b"AN", b"9049442"), line(b"TI", b"a" * 69), line(b"  ", b"\xacb"),
    line(b"SF", b"one"), line(b"  ", b"\xactwo"), line(b"  ", b"more  "), line(b"PH", b"R1\xa0\x02LABEL"), line(b"$$"), line(b"<<", b"inside"), line(b"AN", b"12", b"??"), line(b">>", b"tail"), line(b"ZZ", b"after"),
]


def test_card_reading(spark):
    path = folder(FILE)
    lines = cards.lines(spark, path)
    assert lines.count() == len(FILE) and cards.bad_lines(lines).first()[0] == 1
    s = cards.structure(lines).first()
    assert (s["header"], s["trailer"]) == ("<< inside", ">> tail")
    recs = cards.records(lines)
    spans = {r["ord"]: (r["an"], r["first_line"], r["last_line"], r["offset"], r["length"]) for r in cards.spans(recs).collect()}
    assert spans == {0: ("9049442", 3, 12, 164, 820), 1: ("12", 13, 15, 984, 246)}
    cl = cards.classified(recs)
    assert [(r["ord"], r["line_no"]) for r in cards.orphans(cl).collect()] == [(0, 4)]
    v = {(r["ord"], r["tag"], r["field_seq"], r["value_seq"]): r for r in cards.values(cl).collect()}
    assert v[0, "TI", 3, 0]["raw"] == "a" * 69 + "¬b"  # one value: the marker is data
    assert v[0, "SF", 4, 0]["raw"] == "one" + " " * 66 + "" or v[0, "SF", 4, 0]["raw"] == "one"
    assert v[0, "SF", 4, 1]["raw"] == "two" + " " * 65 + "more"
    assert (v[0, "PH", 5, 0]["code"], v[0, "PH", 5, 0]["label"]) == ("R1", "LABEL")
    assert bytes(v[0, "PH", 5, 0]["raw_bytes"]) == b"R1\xa0\x02LABEL"
    assert v[1, "<<", 1, 0]["raw"] == "inside"
    assert cards.lines(spark, path, most=3).count() == 3


def test_ranges_give_all_lines_of_all_files(spark, monkeypatch):
    path = folder(FILE, FILE[:7], [])
    monkeypatch.setattr(cards, "RANGE", 3)
    for most in (None, 4, 100):
        rows = cards.lines(spark, path, most).collect()
        got = [[bytes(r["bytes"]) for r in sorted(rows, key=lambda r: r["line_no"]) if r["file"] == f] for f in sorted({r["file"] for r in rows})]
        assert got == [FILE[:most], FILE[:7][:most]]
    assert cards.lines(spark, folder([])).count() == 0


def test_misaligned_is_refused(spark):
    with pytest.raises(ValueError):
        cards.lines(spark, folder([b"short"]))


def test_two_files_and_provenance(spark):
    path = folder([line(b"$$"), line(b"AN", b"1")], [line(b"$$"), line(b"AN", b"2"), line(b"$$"), line(b"AN", b"3")])
    recs = cards.records(cards.lines(spark, path))
    assert [r["an"] for r in cards.spans(recs).orderBy("ord").collect()] == ["1", "2", "3"]
    p = spark.createDataFrame([("/x/RG164.CARDS.FY94.txt",), ("/FY88/y.txt",), ("/RG1.FY1994.txt",)], "f string").select(cards.provenance(F.col("f")).alias("p")).collect()
    assert [(r["p"]["record_group"], r["p"]["fiscal_year"]) for r in p] == [("RG164", 94), (None, None), (None, None)]


def test_strict_headings(spark):
    rows = spark.createDataFrame([("A \u0002B",), ("A\u0002B",), ("A \u0002B \u0002C",), ("A",)], "raw string")
    got = [(r["h"]["parts"], r["h"]["problem"]) for r in rows.select(cards.strict_heading(F.col("raw")).alias("h")).collect()]
    assert got[0] == (["A", "B"], None) and [g[0] for g in got[1:]] == [None] * 3
    three = rows.select(cards.strict_heading(F.col("raw"), 3).alias("h")).collect()[2]["h"]
    assert three["parts"] == ["A", "B", "C"]


def vals_of(spark, rows):
    df = spark.createDataFrame(rows, "ord long, tag string, field_seq int, value_seq int, raw string")
    return df.withColumn("raw_bytes", F.encode("raw", "ISO-8859-1"))


GOOD = [("AN", "1234567"), ("PN", "P"), ("TI", "T"), ("PI", "I"), ("CY", "C"), ("ST", "S"), ("IN", "N"), ("SF", "MAIN")]


def kinds(spark, extra, drop=()):
    rows = [(1, t, i, 0, v) for i, (t, v) in enumerate(GOOD) if t not in drop]
    rows += [(1, *x) for x in extra]
    vals = vals_of(spark, rows)
    return sorted((r["kind"], r["tag"]) for r in rules.problems(vals, spark.createDataFrame([(1,)], "ord long")).collect())


def test_rules(spark):
    assert kinds(spark, []) == []
    assert kinds(spark, [], drop=("CY", "SF")) == [("missing", "CY"), ("missing", "SF")]
    assert kinds(spark, [("TI", 90, 0, "again")]) == [("repeated", "TI")]
    assert kinds(spark, [("AS", 90, 0, "")]) == []  # empty and optional: absent
    assert kinds(spark, [("FY", 90, 0, "")]) == [("length", "FY")]
    assert kinds(spark, [("FY", 90, 0, "199")]) == [("length", "FY")]
    assert kinds(spark, [("CT", 90, 0, "050%"), ("CT", 90, 1, "040%")])[-1] == ("percent_sum", "CT")
    assert ("percent_number", "CT") in kinds(spark, [("CT", 90, 0, "5.0%")])
    assert kinds(spark, [("SN", 90, 0, "1")]) == [("pair_counts", "SN")]
    assert kinds(spark, [("QQ", 90, 0, "1")]) == [("not_modeled", "QQ")]
    assert kinds(spark, [("éQ", 90, 0, "1")]) == [("tag_not_ascii", "éQ")]
    assert kinds(spark, [("PT", 90, 0, "ÿ")]) == [("not_utf8", "PT")]
    assert kinds(spark, [("DE", 90, 0, "x" * 61 + " y")]) == [("long_keyword", "DE")]
    assert kinds(spark, [("AC", 90, 0, "A"), ("CT", 91, 0, "9%"), ("CT", 91, 1, "050%")]) == [("length", "AC"), ("length", "CT")]  # not compared
    assert kinds(spark, [("SC", 90, 0, "x"), ("SN", 91, 0, "1"), ("SN", 91, 1, "2")]) == [("heading_parts", "SC")]
    for value in (" 50%", "50 %", "+-5%", "5%%%"):
        assert ("percent_number", "CT") in kinds(spark, [("CT", 90, 0, value)])
    assert ("percent_sum", "CT") in kinds(spark, [("CT", 90, 0, "9" * 20 + "%")]) and ("percent_sum", "CT") not in kinds(spark, [("CT", 90, 0, "+100%")])
    assert kinds(spark, [("PH", 90, 0, "noparts")]) == [("heading_parts", "PH")]


def test_unreadable_records(spark):
    spans = spark.createDataFrame([(1, "RG164.FY94.txt", "a", 1, 2, 0, 164), (2, "RG164.FY94.txt", "b", 3, 4, 164, 163)], "ord long, file string, an string, first_line long, last_line long, offset long, length long")
    vals = vals_of(spark, [(o, t, i, 0, v) for o in (1, 2) for i, (t, v) in enumerate(GOOD)])
    ids = spans.select("ord")
    found = rules.problems(vals, ids)
    tiers = rules.tiers(ids, found, vals, rules.unreadable(spans))
    assert {r["ord"]: r["tier"] for r in tiers.collect()} == {1: "certified", 2: "unreadable"}
    rows = {r["ord"]: r for r in rules.wide(spans, vals, found, tiers).collect()}
    assert rows[1]["title"] == "T" and rows[1]["fiscal_year"] == 94 and rows[2]["record_group"] == "RG164"
    assert rows[2]["an"] is None and rows[2]["title"] is None and rows[2]["subfiles"] is None and rows[2]["length"] == 163
    assert rows[2]["validation"].asDict() == {"certified": False, "tier": "unreadable", "problems": []}


def test_fixity(spark):
    import hashlib

    path = folder([b"abc"], [b"x" * 10_000_000], [b""])
    right = [("RG064.CARDS.FY90.txt", 3, hashlib.sha256(b"abc").hexdigest()), ("RG164.CARDS.FY91.txt", 10_000_000, hashlib.sha256(b"x" * 10_000_000).hexdigest())]
    wrong = [("RG264.CARDS.FY92.txt", 1, hashlib.sha256(b"").hexdigest()), ("gone.txt", 0, "")]
    manifest = spark.createDataFrame(right + wrong, "file string, length long, sha256 string")
    assert {r["file"]: r["ok"] for r in cards.fixity(spark, path, manifest).collect()} == {**{f: True for f, _, _ in right}, **{f: False for f, _, _ in wrong}}


def test_stamp_is_utc_whatever_the_session_says(spark):
    from cardamom.functions import text

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp_micros(0) as ts").select(text.stamp(F.col("ts")).alias("s"))
        assert df.first()["s"] == "01jan70 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
