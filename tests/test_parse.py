"""The one-pass reader against the reader by windows, over borders of ranges and files."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cardamom.schema import SINGLE_TAGS
from cardamom.sources import cards, format, parse, store
from tests.test_cards import FILE, folder, line


def noise(seed, n):
    """Lines in which marks, tags, continuations, markers and blanks fall anywhere."""
    rng = random.Random(seed)
    tags = [b"$$", b"  ", b"  ", b"  ", b"AN", b"TI", b"SF", b"CT", b"PH", b"<<", b">>", b"\xc91", b"$ ", b"IN"]
    weights = [3, 8, 8, 8, 3, 3, 4, 4, 3, 1, 1, 1, 1, 3]
    data = [b"", b" ", b"\xac", b"\xacvalue", b"x" * 69, b" \xa0 ", b"A1\xa0\x02LABEL\xa0\x02 5 ", b"\xe9\xac", b"1234567", b"a b  "]
    return [line(*[(t, d) for t, d in [(rng.choices(tags, weights)[0], rng.choice(data))]][0], rng.choice([b"\r\n"] * 9 + [b"??"])) for _ in range(n)]


def rows(df, *by):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [3, 7, 1 << 15])
@pytest.mark.parametrize("files", [(FILE, FILE[:7], []), (noise(1, 160), noise(2, 91), noise(3, 1)), ([line(b"$$")] * 9,), ([line(b"XX")] * 20, FILE)])
def test_both_readers_agree(spark, monkeypatch, size, files):
    path = folder(*files)
    monkeypatch.setattr(parse, "RANGE", size)
    monkeypatch.setattr(parse, "AHEAD", 4)
    lines = cards.lines(spark, path)
    recs = cards.records(lines)
    cl = cards.classified(recs).persist()
    got = parse.parsed(spark, path).persist()
    own = rows(cards.spans(recs).select("ord", "file", "an", "first_line", "last_line", "offset", "length"))
    assert rows(parse.spans(got)) == own
    assert rows(parse.orphans(got)) == rows(cards.orphans(cl))
    assert rows(parse.fields(got)) == rows(cards.fields(cl).select(*parse.fields(got).columns))
    assert rows(parse.kinds(got)) == rows(cl.groupBy("kind").agg(F.count("*").alias("n")))
    for block in (False, True):
        first = parse.values(got, block)
        assert rows(first) == rows(cards.values(cl, block).select(*first.columns))
    found = parse.ranges(spark, path)
    assert rows(parse.structure(found).where("header is not null or trailer is not null")) == rows(cards.structure(lines))
    assert (found.agg(F.sum("bad_lines")).first()[0] or 0) == cards.bad_lines(lines).first()[0]


def test_records_are_numbered_alike_over_any_chunks(spark):
    path = folder(noise(1, 160), [line(b">>")] * 5, noise(2, 91), FILE)
    lines = cards.lines(spark, path)
    whole = rows(cards.records(lines))
    assert {r[3] for r in whole} == {r["ord"] for r in parse.parsed(spark, path).collect()}
    assert rows(cards.records(lines, 1)) == whole and rows(cards.records(lines, 7)) == whole


def test_records_are_not_numbered_by_broadcasts(spark):
    """Spark counts ranges of lines where it plans joins; of 3 of them come 40,000 records here."""
    lines = cards.lines(spark, folder([line(b"$$"), line(b"AN", b"1")] * 40_000))
    n = cards.records(lines).agg(F.count("*").alias("n"), F.countDistinct("ord").alias("records"))
    assert tuple(n.collect()[0]) == (80_000, 40_000)
    text = n._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text and "Broadcast" not in text


def test_files_are_listed_in_few_tasks(spark):
    path = folder(*[[line(b"$$")]] * 9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "82b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    try:
        assert cards.files(spark, path).rdd.getNumPartitions() <= 4  # shuffle partitions
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert cards.files(spark, path).count() == 9


def test_other_markers_and_tags(spark):
    path = folder([line(b"$$"), line(b"TI", b"one"), line(b"  ", b"\xactwo"), line(b"SF", b"x"), line(b"  ", b"#y")])
    texts = lambda recs: [(r["tag"], r["raw"]) for r in parse.values(recs).orderBy("line", "value_seq").collect()]
    assert texts(parse.parsed(spark, path)) == [("TI", "one" + " " * 66 + "¬two"), ("SF", "x" + " " * 68 + "#y")]
    assert texts(parse.parsed(spark, path, singles=())) == [("TI", "one"), ("TI", "two"), ("SF", "x" + " " * 68 + "#y")]
    assert texts(parse.parsed(spark, path, marker=ord("#")))[1:] == [("SF", "x"), ("SF", "y")] and len(SINGLE_TAGS) == 35


def test_records_are_parsed_without_a_shuffle(spark):
    got = parse.parsed(spark, folder(FILE))
    plan = parse.values(got)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    assert plan.count("Exchange") == 1  # of the descriptions of ranges, before anything is read


def test_files_cut_off_inside_a_line(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    whole = [line(b"$$"), line(b"AN", b"1"), line(b"$$"), line(b"AN", b"2")]
    for name, content in (("a", b"".join(whole) + b"SF rest"), ("b", b"".join([*whole, line(b">>")]) + b"!"), ("c", b"short"), ("d", b"".join(whole))):
        with open(os.path.join(d, name), "wb") as f:
            f.write(content)
    with pytest.raises(ValueError):
        parse.parsed(spark, f"file://{d}")
    got = parse.parsed(spark, f"file://{d}", lenient=True).orderBy("ord").collect()
    assert [(r["ord"], r["file"][-1], r["an"], r["length"], r["error"]) for r in got] == [
        (0, "a", "1", 164, None), (1, "a", "2", 171, "bytes: 171"), (2, "b", "1", 164, None), (3, "b", "2", 164, None), (4, "d", "1", 164, None), (5, "d", "2", 164, None),
    ]
    assert parse.parsed(spark, folder([])).collect() == []


@pytest.mark.parametrize(
    ("uri", "found"),
    [
        ("s3a://bucket/a/b.txt", "s3://bucket/a/b.txt"), ("s3n://bucket/a", "s3://bucket/a"), ("dbfs:/mnt/x/y", "/dbfs/mnt/x/y"), ("dbfs://mnt/x", "/dbfs/x"),
        ("file:/tmp/a b", "file:/tmp/a b"), ("hdfs://n:8020/x", "hdfs://n:8020/x"), ("gs://b/o", "gs://b/o"), ("/tmp/x", "/tmp/x"), ("wasbs://c@a/x", "abfss://c@a/x"),
    ],
)
def test_schemes(uri, found):
    assert store.located(uri) == found


def test_unknown_schemes_say_what_would_do():
    with pytest.raises(OSError, match="oss://x/y"):
        store.opened("oss://x/y")
    assert store.opened("file:///tmp/x")[1] == "/tmp/x"


def test_format_reads_lines_and_takes_filters(spark, monkeypatch):
    format.register(spark)
    path = folder(FILE, FILE[:7], [])
    df = spark.read.format("cards").load(path)
    whole = {(r["file"], r["line_no"], bytes(r["bytes"])) for r in cards.lines(spark, path).collect()}
    got = df.collect()
    assert {(r["file"].replace("file:///", "file:/"), r["line_no"], bytes(r["bytes"])) for r in got} == {(f.replace("file:///", "file:/"), n, b) for f, n, b in whole}
    assert all(r["tag"] == bytes(r["bytes"])[:2].decode("latin-1") for r in got)
    one = got[0]["file"]
    for where in ("tag = 'AN'", "tag in ('TI', '  ')", "line_no <= 3", "line_no > 4 and line_no < 9 and tag = '$$'", "line_no = 3", f"file = '{one}' and tag = 'AN'", "tag = 'long'", "tag = 'AN' and tag = 'TI'", "bytes is not null and line_no >= 6", "line_no > 900"):
        assert {tuple(map(str, r)) for r in df.where(where).collect()} == {tuple(map(str, r)) for r in spark.createDataFrame(got, df.schema).where(where).collect()}, where
    reader = format.CardReader(path, False)
    left = list(reader.pushFilters([format.EqualTo(("file",), one), format.LessThanOrEqual(("line_no",), 3), format.In(("tag",), ("AN", "TI"))]))
    (part,) = reader.partitions()
    assert left == [] and (part.file, part.first, part.last, part.tags) == (one, 1, 3, ("AN", "TI"))
    with pytest.raises(Exception, match="no multiple of 82"):
        spark.read.format("cards").load(folder([b"short"])).collect()
    assert spark.read.format("cards").option("lenient", "true").load(folder([b"short"])).collect() == []
