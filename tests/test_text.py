from pyspark.sql import functions as F

from cardamom.functions import text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, text.tokens(F.lit("the gene-transfer -x- of A.B cété")))
    assert got == ["GENE-TRANSFER", "GENE", "TRANSFER", "X", "A", "B", "C", "T"]
    assert one(spark, text.tokens(F.lit("-- the AND -of- a--b"))) == ["A--B", "A", "B"]
    assert one(spark, text.tokens(F.lit(""))) == []


def test_keys_and_spaces(spark):
    assert one(spark, text.phrase_key(F.lit(" a  b  \t"))) == " A  B"
    assert one(spark, text.phrase_key(F.lit("a\u0085"))) == "A\u0085"
    assert one(spark, text.trim(F.lit("  x ﻿"))) == "x"
    assert one(spark, text.phrase_key(F.lit("straße"))) == "STRASSE"


def test_codes_and_numbers(spark):
    codes = {"R101": "101", "101": "101", "RR101": None, "R10": None, "1010": None, "": None, "R101\n": None}
    for value, want in codes.items():
        assert one(spark, text.canonical_code(F.lit(value))) == want
    assert one(spark, text.percent(F.lit("042%"))) == 42
    assert one(spark, text.percent(F.lit("4.2%"))) is None
    assert one(spark, text.percent(F.lit("42%%"))) is None
    assert one(spark, text.shown_accession(F.lit("123456789"))) == " 123456789"
    assert one(spark, text.shown_accession(F.lit("9049442"))) == " 09049442"
    assert one(spark, text.shard(F.lit("-X"))) == "_"
    assert one(spark, text.excerpt(F.lit(bytes([0xFF, 0x41])))) == "FF41"
    assert one(spark, text.stamp(F.lit("1994-02-03 04:05:06").cast("timestamp"))) == "03feb94 04:05:06"
