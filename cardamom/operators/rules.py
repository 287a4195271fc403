"""Auditing values against a table of field rules: problems, tiers, tallies, the wide row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.sources import cards

# Tag, group, required, values at most, least and most bytes, bytes only (not decoded).
RULES = (
    ("AN", "identity", True, 1, 7, 7, False),
    ("PN", "identity", True, 1, 1, 20, False),
    ("TI", "title", True, 1, 1, 100, False),
    ("PI", "institution", True, 1, 1, 40, False),
    ("CY", "institution", True, 1, 1, 20, False),
    ("ST", "institution", True, 1, 1, 20, False),
    ("AS", "institution", False, 1, 0, 4, False),
    ("DS", "institution", False, 1, 0, 4, False),
    ("ZP", "institution", False, 1, 0, 10, False),
    ("CG", "institution", False, 1, 0, 20, False),
    ("RG", "institution", False, 1, 0, 2, False),
    ("PT", "title", False, 1, 0, 20, False),
    ("RE", "institution", False, 1, 1, 1, False),
    ("RN", "institution", False, 1, 5, 5, False),
    ("PD", "chronology", False, 1, 6, 6, False),
    ("SD", "chronology", False, 1, 6, 6, False),
    ("SX", "chronology", False, 1, 9, 9, False),
    ("TD", "chronology", False, 1, 6, 6, False),
    ("TX", "chronology", False, 1, 9, 9, False),
    ("UP", "chronology", False, 1, 6, 6, False),
    ("PP", "chronology", False, 1, 4, 4, False),
    ("PX", "chronology", False, 1, 12, 12, False),
    ("BP", "classification", False, 1, 12, 12, False),
    ("BT", "classification", False, 1, 4, 4, False),
    ("AT", "classification", False, 1, 4, 4, False),
    ("DT", "classification", False, 1, 4, 4, False),
    ("IC", "institution", False, 1, 4, 6, False),
    ("OC", "institution", False, 1, 4, 6, False),
    ("FY", "chronology", False, 1, 2, 4, False),
    ("GY", "chronology", False, 1, 2, 4, False),
    ("PF", "institution", False, 9999, 0, 80, False),
    ("IN", "investigators", True, 6, 0, 30, True),
    ("SF", "title", True, 9999, 4, 11, False),
    ("AC", "classification", False, 15, 5, 89, False),
    ("CM", "classification", False, 15, 5, 89, False),
    ("FS", "classification", False, 15, 5, 89, False),
    ("PA", "classification", False, 15, 5, 89, False),
    ("RP", "classification", False, 15, 4, 74, False),
    ("CT", "classification", False, 15, 4, 74, False),
    ("JC", "classification", False, 15, 3, 59, False),
    ("PH", "classification", False, 60, 0, 9999, True),
    ("GH", "classification", False, 60, 0, 9999, True),
    ("SC", "classification", False, 50, 0, 9999, True),
    ("OB", "narrative", False, 1, 0, 1600, True),
    ("AP", "narrative", False, 1, 0, 1600, True),
    ("PR", "narrative", False, 1, 0, 3200, True),
    ("PB", "narrative", False, 1, 0, 3200, True),
    ("DE", "narrative", False, 1, 0, 2400, True),
    ("PS", "title", False, 1, 0, 9999, False),
)
UNCHECKED = ("SN",)  # kept, never checked
UNMODELED = ("HP",)
YEARS = ("FY", "GY")
HEADING_PARTS = {"PH": 2, "GH": 2, "SC": 3}
FIVE = ("AC", "CM", "FS", "RP", "CT")
COLUMNS = (*FIVE, "PA", "JC")
NARRATIVES = ("OB", "AP", "DE", "PR", "PB")
KEYWORD_BYTES = 60
#: Kinds of problems that do not show a record to differ from its documentation.
MISS, NOT_MODELED = "rpa_not_attested", "not_modeled"
TIERS = ("certified", "certified_undocumented", "certified_rpa_absence", "unmodeled_only", "failed", "unreadable")


def rule_table(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RULES, "tag string, grp string, required boolean, most_values int, least int, most int, raw boolean"))


def attested(codes: DataFrame, vocabulary: DataFrame, year: Column) -> DataFrame:
    """codes (value, ...) with state and label: attested, not_attested, no_warrant_set, not_applicable.

    vocabulary: (warrant_set, code, label). Files of 88 and 89 use the fourth revision, 94 its own table.
    """
    warrant = F.when(year.isin(88, 89), "rev_iv").when(year == 94, "fy94")
    df = codes.withColumns({"warrant_set": warrant, "code": text.canonical_code(F.col("value"))})
    df = df.join(vocabulary.withColumn("known", F.lit(True)), ["warrant_set", "code"], "left")
    state = F.when(F.col("warrant_set").isNull(), "no_warrant_set").when(F.col("code").isNull(), "not_applicable").when(F.col("known"), "attested").otherwise("not_attested")
    return df.withColumn("state", state).drop("known")


_PROBLEM = "array<struct<kind:string,tag:string,grp:string,message:string>>"
_REQUIRED = tuple((t, g) for t, g, required, *_ in RULES if required)


def _problem(kind: str | Column, message: Column, tag: str | Column = "tag", grp: str | Column = "grp") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), col(tag).alias("tag"), col(grp).alias("grp"), message.alias("message"))


def _present(*problems: Column) -> Column:
    return F.array_compact(F.array(*problems)).cast(_PROBLEM)


def _of_value() -> tuple[Column, Column]:
    """Whether one value has problems under the rule of its tag (columns of the rule, raw, raw_bytes, size), and which; the second is dear and only for values of the first."""
    tag, size = F.col("tag"), F.col("size")
    absent = (F.col("most_values") == 1) & ~F.col("required") & (size == 0) & ~tag.isin(*YEARS)
    wrong = ~F.when(tag.isin(*YEARS), size.isin(2, 4)).otherwise(size.between(F.col("least"), F.col("most")))
    bounds = F.concat(F.lit("bytes: "), size.cast("string"), F.lit(", allowed "), F.col("least").cast("string"), F.lit("-"), F.col("most").cast("string"))
    # two parts, of SC also three, all but the last ending in U+00A0
    head, last = "[^\\x02]*\\xA0\\x02", "[^\\x02]*\\z"
    whole = F.when(tag == "SC", F.col("raw").rlike(rf"\A{head}(?:{head})?{last}")).otherwise(F.col("raw").rlike(rf"\A{head}{last}"))
    excerpt, n_parts = text.excerpt(F.col("raw_bytes")), F.size(F.split("raw", "\u0002", -1))
    faults = [
        (wrong & ~absent & (tag != "AN"), _problem("length", bounds)),
        ((tag == "AN") & ~text.is_accession(F.col("raw")), _problem("accession", excerpt)),
        (~F.col("raw_is") & ~F.is_valid_utf8(F.col("raw_bytes").cast("string")), _problem("not_utf8", excerpt)),
        (tag.isin(*HEADING_PARTS) & ~whole, _problem("heading_parts", F.concat(F.lit("parts: "), n_parts.cast("string")))),
    ]
    long_word = (tag == "DE") & F.col("raw").rlike(f"[^ ]{{{KEYWORD_BYTES + 1}}}")
    words = F.when(tag == "DE", F.transform(text.long_words(F.col("raw"), KEYWORD_BYTES), lambda w: _problem("long_keyword", w))).otherwise(F.array()).cast(_PROBLEM)
    some = reduce(lambda a, b: a | b, [F.coalesce(when, F.lit(False)) for when in (*[f[0] for f in faults], long_word)])
    has = F.col("grp").isNotNull() & some
    return has, F.when(has, F.concat(_present(*[F.when(when, p) for when, p in faults]), words)).otherwise(F.array().cast(_PROBLEM))


def _single_values(vals: DataFrame, rule: DataFrame, vocabulary: DataFrame | None, year: int | None) -> DataFrame:
    """(ord, found, percent, odd): the values that have something wrong, with their problems, and those of CT with their percent, or as they are if that is no number."""
    v = vals.select("ord", "tag", "raw", "raw_bytes").join(rule, "tag", "left").withColumn("size", F.octet_length("raw_bytes"))
    has, own = _of_value()
    code = (F.col("tag") == "RP") & (F.col("size") >= 4) if vocabulary is not None and year is not None else F.lit(False)
    v = v.where(has | code | (F.col("tag") == "CT"))  # most values need no more than this
    missed = F.array().cast(_PROBLEM)
    if vocabulary is not None and year is not None:
        v = attested(v.withColumn("value", F.when(code, F.col("raw"))), vocabulary, F.lit(year))
        missed = F.when(F.col("value").isNotNull() & (F.col("state") == "not_attested"), F.array(_problem(MISS, F.col("code"), F.lit("RP"), F.lit("classification")))).otherwise(missed).cast(_PROBLEM)
    percent = F.when(F.col("tag") == "CT", text.percent(F.col("raw")))
    odd = F.when((F.col("tag") == "CT") & percent.isNull(), F.col("raw"))
    return v.select("ord", F.concat(own, missed).alias("found"), percent.alias("percent"), odd.alias("odd"))


def audited(vals: DataFrame, ids: DataFrame, orphans: DataFrame | None = None, vocabulary: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """(ord, problems, undocumented): a row per record of ids (ord) with all of its problems (kind, tag, grp, message).

    vals: (ord, tag, field_seq, value_seq, raw, raw_bytes). Of all values only tag and
    field are dealt out by record, and counted by field, tag and record where they
    lie; no list is made of them. What is wrong with single values, tags and lines is
    gathered by record apart from that. Rules that compare fields look only at records
    in which each of these fields is sound by itself. undocumented: whether a tag is
    there that is never checked.
    """
    rule = rule_table(vals.sparkSession).withColumnRenamed("raw", "raw_is")
    none = F.array().cast(_PROBLEM)
    # a record is there by a row without a tag
    flat = vals.select("ord", "tag", F.col("field_seq").cast("int").alias("field_seq")).union(ids.select("ord", F.lit(None).cast("string"), F.lit(None).cast("int")))
    flat = flat.where("ord is not null").repartition("ord")
    per = flat.groupBy("ord", "tag", "field_seq").agg(F.count("*").alias("n")).groupBy("ord", "tag").agg(F.sum("n").alias("n"), F.count("*").alias("occurrences"))
    per = per.join(rule.select("tag", "grp", "most_values"), "tag", "left")
    tag, n, occurrences, single = F.col("tag"), F.col("n"), F.col("occurrences"), F.col("most_values") == 1
    repeated, too_many = F.coalesce(single & (occurrences > 1), F.lit(False)), F.coalesce(~single & (n > F.col("most_values")), F.lit(False))
    kind = F.when(text.not_ascii(tag), "tag_not_ascii").otherwise(NOT_MODELED)
    of_tag = (
        F.when(repeated, F.array(_problem("repeated", F.concat(F.lit("occurrences: "), occurrences.cast("string")))).cast(_PROBLEM))
        .when(too_many, F.array(_problem("too_many", F.concat(F.lit("values: "), n.cast("string")))).cast(_PROBLEM))
        .otherwise(F.array_repeat(_problem(kind, F.lit(""), "tag", F.lit("none")), occurrences.cast("int")).cast(_PROBLEM))
    )
    of_tags = per.where(repeated | too_many | (F.col("grp").isNull() & tag.isNotNull() & ~tag.isin(*UNCHECKED))).select("ord", of_tag)
    here = lambda *tags: F.coalesce(F.bool_or(tag.isin(*tags)), F.lit(False))
    count = lambda t: F.coalesce(F.max(F.when(tag == t, n)), F.lit(0)).alias(f"n_{t}")
    rec = per.groupBy("ord").agg(F.bool_or(tag.isNull()).alias("asked"), here(*UNCHECKED).alias("undocumented"), *[here(t).alias(f"has_{t}") for t, _ in _REQUIRED], *[count(t) for t in (*FIVE, "SC", "SN")])

    found = _single_values(vals, rule, vocabulary, year)
    without = [F.lit(None).cast(found.schema[c].dataType) for c in ("percent", "odd")]
    found = found.union(of_tags.select("*", *without))
    if orphans is not None:
        lost = _problem(NOT_MODELED, F.concat(F.lit("line "), F.col("line_no").cast("string")), F.lit("<unassigned>"), F.lit("none"))
        found = found.union(orphans.select("ord", F.array(lost).cast(_PROBLEM), *without))
    listed = F.flatten(F.collect_list(F.when(F.size("found") > 0, F.col("found"))))
    found = found.groupBy("ord").agg(listed.alias("found"), F.sum("percent").alias("total"), F.min("odd").alias("odd"))
    df = rec.where("asked").join(found, "ord", "left").withColumn("found", F.coalesce("found", none))
    missing = _present(*[F.when(~F.col(f"has_{t}"), _problem("missing", F.lit("required"), F.lit(t), F.lit(g))) for t, g in _REQUIRED])
    # not attested is no fault of the field itself
    sound = lambda *tags: ~F.exists("found", lambda x: x["tag"].isin(*tags) & (x["grp"] != "none") & ~((x["kind"] == MISS) & (x["tag"] == "RP")))
    five, counted = [F.col(f"n_{t}") for t in FIVE], lambda *c: F.array_join(F.array(*[x.cast("string") for x in c]), ",")
    group = F.lit("classification")
    compared = _present(
        F.when((F.greatest(*five) != F.least(*five)) & sound(*FIVE), _problem("column_counts", counted(*five), F.lit("RP"), group)),
        F.when((F.col("n_SN") > 0) & (F.col("n_SN") != F.col("n_SC")) & sound("SC"), _problem("pair_counts", counted(F.col("n_SC"), F.col("n_SN")), F.lit("SN"), group)),
        F.when(
            (F.col("odd").isNotNull() | (F.col("total") != 100)) & sound("CT"),
            _problem(F.when(F.col("odd").isNotNull(), "percent_number").otherwise("percent_sum"), F.coalesce("odd", F.col("total").cast("string")), F.lit("CT"), group),
        ),
    )
    return df.select("ord", F.concat("found", missing, compared).alias("problems"), "undocumented")


def listed(audit: DataFrame) -> DataFrame:
    """(ord, kind, tag, grp, message) of all problems of an audit."""
    return audit.select("ord", F.inline("problems"))


def problems(vals: DataFrame, ids: DataFrame, orphans: DataFrame | None = None, vocabulary: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """(ord, kind, tag, grp, message) of all problems of the records ids (ord); nothing stops at the first."""
    return listed(audited(vals, ids, orphans, vocabulary, year))


def _counts(vals: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    return vals.where(F.col("tag").isin(*tags)).groupBy("ord").agg(*[F.count(F.when(F.col("tag") == t, 1)).alias(t) for t in tags])


def _sound_in(df: DataFrame, alone: DataFrame | None, *tags: str) -> DataFrame:
    """The rows of df (ord, ...) whose record has no problem of its own in the tags."""
    return df if alone is None else df.join(alone.where(F.col("tag").isin(*tags)).select("ord").distinct(), "ord", "left_anti")


def cross_counts(vals: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """The five columns must be of one length; SN, if there, as long as SC. alone: problems of single fields, which come first."""
    c = _counts(vals, (*FIVE, "SC", "SN"))
    five = _sound_in(c.where(F.greatest(*FIVE) != F.least(*FIVE)), alone, *FIVE).select("ord", F.lit("column_counts").alias("kind"), F.lit("RP").alias("tag"), F.lit("classification").alias("grp"), F.array_join(F.array(*[F.col(t).cast("string") for t in FIVE]), ",").alias("message"))
    pair = _sound_in(c.where((F.col("SN") > 0) & (F.col("SN") != F.col("SC"))), alone, "SC")
    return five.union(pair.select("ord", F.lit("pair_counts"), F.lit("SN"), F.lit("classification"), F.concat_ws(",", F.col("SC").cast("string"), F.col("SN").cast("string"))))


def percent_sums(vals: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """CT must add up to 100; a value that is no whole number is named instead."""
    p = text.percent(F.col("raw"))
    c = vals.where("tag = 'CT'").groupBy("ord").agg(F.sum(p).alias("total"), F.min(F.when(p.isNull(), F.col("raw"))).alias("odd"))
    bad = _sound_in(c.where("odd is not null or total <> 100"), alone, "CT")
    return bad.select("ord", F.when(F.col("odd").isNotNull(), "percent_number").otherwise("percent_sum").alias("kind"), F.lit("CT").alias("tag"), F.lit("classification").alias("grp"), F.coalesce("odd", F.col("total").cast("string")).alias("message"))


def unreadable(spans: DataFrame) -> DataFrame:
    """(ord, error) of records (spans, or records as parsed) whose bytes are no whole number of lines: they cannot be read into fields."""
    return spans.where(F.col("length") % cards.WIDTH != 0).select("ord", F.concat(F.lit("bytes: "), F.col("length").cast("string")).alias("error"))


def graded(audit: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(ord, tier) of every record of an audit; an unreadable one has that tier whatever else is known of it."""
    every = lambda kind: F.forall("problems", lambda x: x["kind"] == kind)
    tier = F.when(F.size("problems") == 0, F.when(F.col("undocumented"), TIERS[1]).otherwise(TIERS[0])).when(every(MISS), TIERS[2]).when(every(NOT_MODELED), TIERS[3]).otherwise(TIERS[4])
    if unreadable is not None:
        audit = audit.join(unreadable.select("ord").withColumn("lost", F.lit(True)), "ord", "left")
        tier = F.when(F.col("lost"), TIERS[5]).otherwise(tier)
    return audit.select("ord", tier.alias("tier"))


def tiers(ids: DataFrame, found: DataFrame, vals: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(ord, tier) of every record; an unreadable one has that tier whatever else is known of it."""
    per = found.groupBy("ord").agg(F.bool_and(F.col("kind") == MISS).alias("misses"), F.bool_and(F.col("kind") == NOT_MODELED).alias("unmodeled"))
    extra = vals.where(F.col("tag").isin(*UNCHECKED)).select("ord").distinct().withColumn("extra", F.lit(True))
    df = ids.select("ord").join(per, "ord", "left").join(extra, "ord", "left")
    tier = F.when(F.col("misses").isNull(), F.when(F.col("extra"), TIERS[1]).otherwise(TIERS[0])).when(F.col("misses"), TIERS[2]).when(F.col("unmodeled"), TIERS[3]).otherwise(TIERS[4])
    if unreadable is not None:
        df = df.join(unreadable.select("ord").withColumn("lost", F.lit(True)), "ord", "left")
        tier = F.when(F.col("lost"), TIERS[5]).otherwise(tier)
    return df.select("ord", tier.alias("tier"))


def tally(t: DataFrame) -> DataFrame:
    """(total, certified, certified_undocumented, certified_rpa_absence, failed, unreadable, unmodeled_only); certified includes its two kinds."""
    n = lambda *names: F.count(F.when(F.col("tier").isin(*names), 1))
    return t.agg(F.count("*").alias("total"), n(*TIERS[:3]).alias("certified"), n(TIERS[1]).alias(TIERS[1]), n(TIERS[2]).alias(TIERS[2]), n(TIERS[4]).alias("failed"), n(TIERS[5]).alias("unreadable"), n(TIERS[3]).alias("unmodeled_only"))


def histogram(found: DataFrame) -> DataFrame:
    """(bucket, n) of problems by tag and kind; show by n descending, then bucket."""
    return found.groupBy(F.concat_ws(" ", "tag", "kind").alias("bucket")).agg(F.count("*").alias("n"))


def wide(spans: DataFrame, vals: DataFrame, found: DataFrame, tier: DataFrame) -> DataFrame:
    """One row per record with nested columns; a group with a problem is null in all of its columns, an unreadable record in all groups."""
    of = lambda t: F.filter("own", lambda x: x["tag"] == t)
    one = lambda t: F.array_min(F.transform(of(t), lambda x: F.struct(x["value_seq"], x["field_seq"], x["raw"].alias("raw"))))["raw"]
    many = lambda t: F.transform(of(t), lambda x: x["raw"])
    single = {"accession": ("AN", "identity"), "project_number": ("PN", "identity"), "title": ("TI", "title"), "institution": ("PI", "institution"), "city": ("CY", "institution"), "state": ("ST", "institution")}
    lists = {"subfiles": ("SF", "title"), "performing": ("PF", "institution"), "investigators": ("IN", "investigators"), "rp_codes": ("RP", "classification"), "primary_headings": ("PH", "classification"), "subcommodities": ("SC", "classification")}
    shown = F.col("tag").isin(*[t for t, _ in (*single.values(), *lists.values())])
    per = vals.groupBy("ord").agg(F.sort_array(F.collect_list(F.when(shown, F.struct("field_seq", "value_seq", "tag", "raw")))).alias("own"))  # once for all columns
    per = per.select("ord", *[one(t).alias(c) for c, (t, _) in single.items()], *[many(t).alias(c) for c, (t, _) in lists.items()])
    failed = found.groupBy("ord").agg(F.collect_set("grp").alias("bad"), F.array_sort(F.collect_list(F.struct("kind", "tag", "message"))).alias("problems"))
    df = spans.join(per, "ord", "left").join(failed, "ord", "left").join(tier, "ord")
    for c, (_, g) in {**single, **lists}.items():
        df = df.withColumn(c, F.when(~F.coalesce(F.array_contains("bad", g), F.lit(False)) & (F.col("tier") != TIERS[5]), F.col(c)))
    empty = F.array().cast("array<struct<kind:string,tag:string,message:string>>")
    validation = F.struct(F.col("tier").startswith("certified").alias("certified"), "tier", F.when(F.col("tier") == TIERS[5], empty).otherwise(F.coalesce("problems", empty)).alias("problems"))
    an = F.when(F.col("tier") != TIERS[5], F.col("an")).alias("an")
    return df.withColumn("from", cards.provenance(F.col("file"))).select("ord", "from.*", an, "first_line", "offset", "length", *single, *lists, validation.alias("validation"))


def write_rows(rows: DataFrame, path: str) -> None:
    """The wide rows as lines of JSON in order of their records; nulls are written."""
    rows.repartitionByRange("ord").sortWithinPartitions("ord").write.option("ignoreNullFields", "false").json(path)


def census(vals: DataFrame, total: int | Column) -> DataFrame:
    """(tag, records, presence, n, least, most, not_utf8) of every tag."""
    bad = F.count(F.when(~F.is_valid_utf8(F.col("raw_bytes").cast("string")), 1))
    size = F.octet_length("raw_bytes")
    return vals.groupBy("tag").agg(F.countDistinct("ord").alias("records"), (F.countDistinct("ord") / total).alias("presence"), F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), bad.alias("not_utf8"))



def _sound(ids: DataFrame, found: DataFrame, *groups: str) -> DataFrame:
    """(ord, and a boolean per group: no problem in it)."""
    of = found.groupBy("ord").agg(*[F.bool_or(F.col("grp") == g).alias(g) for g in groups])
    return ids.select("ord").join(of, "ord", "left").select("ord", *[(~F.coalesce(F.col(g), F.lit(False))).alias(g) for g in groups])


def summary(ids: DataFrame, found: DataFrame) -> DataFrame:
    """(records, identified, with_problems): records in all, with a sound identity, and the others."""
    ok = _sound(ids, found, "identity")
    return ok.agg(F.count("*").alias("records"), F.count_if("identity").alias("identified"), F.count_if(~F.col("identity")).alias("with_problems"))


def overview(ids: DataFrame, vals: DataFrame, found: DataFrame) -> DataFrame:
    """(ord, column_codes, SC, PH, GH, and whether each narrative is there); null for a group with a problem."""
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    counts = {"column_codes": n(*COLUMNS), **{t: n(t) for t in HEADING_PARTS}}
    per = vals.groupBy("ord").agg(*[c.alias(name) for name, c in counts.items()], *[F.bool_or((F.col("tag") == t) & (F.octet_length("raw_bytes") > 0)).alias(t) for t in NARRATIVES])
    df = _sound(ids, found, "classification", "narrative").join(per, "ord", "left")
    return df.select(
        "ord",
        *[F.when(F.col("classification"), F.coalesce(name, F.lit(0))).alias(name) for name in counts],
        *[F.when(F.col("narrative"), F.coalesce(t, F.lit(False))).alias(t) for t in NARRATIVES],
    )
