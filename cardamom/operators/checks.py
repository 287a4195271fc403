"""Checks of what was built: counts against a manifest, indexes against term lists, two readers against each other."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def manifest_faults(counts: DataFrame, manifest: DataFrame, strict: bool = False) -> DataFrame:
    """(code, terms, expected) where (code, terms) and (code, expected) differ; codes the manifest omits count only if strict."""
    df = counts.join(manifest, "code", "full_outer")
    wrong = F.coalesce(F.col("terms"), F.lit(0)) != F.col("expected")
    return df.where(wrong | F.col("expected").isNull() if strict else wrong).select("code", "terms", "expected")


def drifted(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(code, term) of the term list without any posting."""
    return terms.join(postings, ["code", "term"], "left_anti").select("code", "term")


def differences(a: DataFrame, b: DataFrame, permitted=None) -> DataFrame:
    """Rows of only one of two readings, with side; those that ``permitted`` (a condition) allows are left out."""
    only = a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))
    return only if permitted is None else only.where(~permitted)


def parity(spans: DataFrame, vals: DataFrame, other_spans: DataFrame, other_vals: DataFrame, singles: tuple[str, ...] = (), marker: str = "") -> DataFrame:
    """(ord, what, field_seq, value_seq, first, second): where two readings of records differ, field by field.

    spans: a row per record (ord, ...), compared column by column (what is the
    column). vals: (ord, tag, field_seq, value_seq, raw, raw_bytes, code, label,
    percent, line, offset, continuation); what is the tag, and first and second are
    the texts, or all parts where only others differ. One difference is permitted:
    the second reading may split at the marker what the first, in tags of one
    value, keeps as one value with the marker in it, if that value begins at the
    same line, is no continuation, and has the same characters but for blanks.
    """
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    columns = [c for c in spans.columns if c != "ord"]
    a, b = spans.select("ord", F.struct(*columns).alias("a")), other_spans.select("ord", F.struct(*columns).alias("b"))
    each = F.array(*[F.struct(F.lit(c).alias("what"), shown(F.col(f"a.{c}")).alias("first"), shown(F.col(f"b.{c}")).alias("second")) for c in columns])
    gone = F.array(F.struct(F.lit("record").alias("what"), F.when(F.col("a").isNull(), "null").otherwise("there").alias("first"), F.when(F.col("b").isNull(), "null").otherwise("there").alias("second")))
    rows = F.when(F.col("a").isNull() | F.col("b").isNull(), gone).otherwise(F.filter(each, lambda x: x["first"] != x["second"]))
    none = F.lit(None).cast("int")
    records = a.join(b, "ord", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("ord", F.inline(rows)).select("ord", "what", none.alias("field_seq"), none.alias("value_seq"), "first", "second")

    parts = ("tag", "raw", "raw_bytes", "code", "label", "percent", "line", "offset", "continuation")
    of = lambda df, name: df.groupBy("ord", "field_seq").agg(F.array_sort(F.collect_list(F.struct(F.col("value_seq").cast("int").alias("value_seq"), *[F.col(c) for c in parts]))).alias(name))
    f = of(vals, "x").join(of(other_vals, "y"), ["ord", "field_seq"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    f = f.withColumns({c: F.coalesce(c, F.slice(other, 1, 0)) for c, other in (("x", "y"), ("y", "x"))})  # a field that one reading lacks
    one, first, bare = F.get("x", F.lit(0)), F.get("y", F.lit(0)), lambda c: F.translate(c, " ", "")
    joined = F.array_join(F.transform("y", lambda v: v["raw"]), marker)
    permitted = one["tag"].isin(*singles) & (F.size("x") == 1) & (F.size("y") > 1) & (one["tag"] == first["tag"]) & ~one["continuation"] & (one["line"] == first["line"]) & (bare(one["raw"]) == bare(joined))
    f = f.where(~F.coalesce(permitted, F.lit(False))) if singles else f
    pairs = F.filter(F.transform(F.arrays_zip("x", "y"), lambda z, i: F.struct(z["x"].alias("x"), z["y"].alias("y"), i.alias("i"))), lambda z: ~z["x"].eqNullSafe(z["y"]))
    d = f.select("ord", F.col("field_seq").cast("int").alias("field_seq"), F.explode(pairs).alias("z"))
    whole = lambda v: F.when(F.col(v).isNull(), "null").when(F.col("z.x.raw").eqNullSafe(F.col("z.y.raw")), F.to_json(v)).otherwise(F.col(f"{v}.raw"))
    values = d.select("ord", F.coalesce("z.x.tag", "z.y.tag").alias("what"), "field_seq", F.col("z.i").alias("value_seq"), whole("z.x").alias("first"), whole("z.y").alias("second"))
    return records.union(values)


def missing_artifacts(codes: DataFrame, **tables: DataFrame) -> DataFrame:
    """(code, artifact) for every code that a table (with a code column) has no row of."""
    out = None
    for name, df in tables.items():
        gone = codes.select("code").join(df.select("code").distinct(), "code", "left_anti").select("code", F.lit(name).alias("artifact"))
        out = gone if out is None else out.union(gone)
    return out


def schema_faults(df: DataFrame, expected: dict[str, str]) -> list[str]:
    own = dict(df.dtypes)
    return [f"{c}: {own.get(c)} instead of {t}" for c, t in expected.items() if own.get(c) != t] + [f"{c}: unexpected" for c in own if c not in expected]


def shapes(spark: SparkSession, tables: dict[str, str], expected: dict[str, str]) -> DataFrame:
    """(name, rows, faults): stored Parquet tables (paths by name) against the columns (as DDL) that each has to have."""
    out = None
    for name, path in tables.items():
        df = spark.read.parquet(path)
        faults = schema_faults(df, {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected[name])})
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit("; ".join(faults)).alias("faults"))
        out = row if out is None else out.union(row)
    return out


def loaded(spark: SparkSession, path: str, columns: str, folders: str = "") -> DataFrame:
    """A stored Parquet table with the columns and folders (as DDL) that it has to have; another shape is refused. A table without files is empty."""
    expected = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(columns)}
    parts = [f.name for f in StructType.fromDDL(folders)] if folders else []
    try:
        wrong = schema_faults(spark.read.parquet(path).drop(*parts), expected)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        wrong = []
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return spark.read.schema(f"{columns}, {folders}" if folders else columns).parquet(path)


def repeated_keys(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def uncovered(records: DataFrame, vals: DataFrame) -> DataFrame:
    """(ord) of records without any value."""
    return records.select("ord").join(vals.select("ord"), "ord", "left_anti")


def repeated_postings(postings: DataFrame) -> DataFrame:
    """(code, term) whose postings name a record twice."""
    return postings.groupBy("code", "term", "ord").agg(F.count("*").alias("n")).where("n > 1").select("code", "term").distinct()
