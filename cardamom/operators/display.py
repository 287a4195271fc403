"""Records as rows to show: first values, chosen fields, paired columns, and where each shown value comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.plans.numbering import sorted_ranks
from cardamom.schema import display_tags

#: From weakest to strongest.
STATUSES = ("chosen", "inferred", "documented")


def first_value(tag: str):
    own = F.col("tag") == tag
    return F.coalesce(F.min_by(F.when(own, F.col("raw")), F.when(own, F.struct("field_seq", "value_seq"))), F.lit(""))


def accession_lines(vals: DataFrame) -> DataFrame:
    """(ord, line): the accession alone."""
    return vals.groupBy("ord").agg(text.shown_accession(first_value("AN")).alias("line"))


def brief(vals: DataFrame) -> DataFrame:
    """(ord, accession, agency, project, period, investigator, organization, location, title)."""
    tags = ("AN", "AS", "DS", "PN", "SX", "TX", "IN", "PF", "PI", "TI")
    f = vals.where(F.col("tag").isin(*tags)).groupBy("ord").agg(*[first_value(t).alias(t) for t in tags])
    agency = F.concat_ws(" ", F.nullif("AS", F.lit("")), F.nullif("DS", F.lit("")))
    return f.select("ord", text.shown_accession(F.col("AN")).alias("accession"), agency.alias("agency"), F.col("PN").alias("project"), F.concat_ws(" TO ", "SX", "TX").alias("period"), F.col("IN").alias("investigator"), F.col("PF").alias("organization"), F.col("PI").alias("location"), F.col("TI").alias("title"))


def chosen_fields(vals: DataFrame, codes: list[str], tags_of=display_tags) -> DataFrame:
    """(ord, code_seq, tag_seq, field_seq, value_seq, tag, raw): every value of the codes asked for, in their order."""
    rows = [(i, j, tag) for i, code in enumerate(codes) for j, tag in enumerate(tags_of(code))]
    order = F.broadcast(vals.sparkSession.createDataFrame(rows, "code_seq int, tag_seq int, tag string"))
    return vals.join(order, "tag").select("ord", "code_seq", "tag_seq", "field_seq", "value_seq", "tag", "raw")


def placed(vals: DataFrame, tag: str) -> DataFrame:
    """(ord, pos, tag's values): the values of a tag numbered over its fields."""
    by = Window.partitionBy("ord").orderBy("field_seq", "value_seq")
    return vals.where(F.col("tag") == tag).select("ord", (F.row_number().over(by) - 1).alias("pos"), F.col("raw").alias(tag))


def zipped(vals: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(ord, pos, a column per tag, complete): side by side by place; rows past the shortest tag are surplus (complete is false)."""
    df = reduce(lambda a, b: a.join(b, ["ord", "pos"], "full_outer"), [placed(vals, t) for t in tags])
    return df.withColumn("complete", reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in tags]))


def zipped_strict(vals: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(ord, pos, a column per tag), only of records in which all tags have as many values."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("field_seq", "value_seq", "raw")))), lambda x: x["raw"]).alias(t) for t in tags]
    per = vals.where(F.col("tag").isin(*tags)).groupBy("ord").agg(*lists)  # of one record
    same = reduce(lambda a, b: a & b, [F.size(tags[0]) == F.size(t) for t in tags[1:]])
    return per.where(same).select("ord", F.posexplode(F.arrays_zip(*tags)).alias("pos", "x")).select("ord", "pos", *[F.col(f"x.{t}").alias(t) for t in tags])


def decoded(codes: DataFrame, headings: DataFrame) -> DataFrame:
    """codes (ord, code, ...) with the label of the record's own heading of that code; the last of several wins, a miss is null."""
    own = headings.groupBy("ord", "code").agg(F.max_by("label", "seq").alias("label"))
    return codes.join(own, ["ord", "code"], "left")


def full_record(vals: DataFrame, grid: tuple[str, ...], pair: tuple[str, ...], scalars: tuple[str, ...], lists: tuple[str, ...], headings: tuple[str, ...] = (), parts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One nested row per record: scalars, lists, the grid with its surplus, the pairs.

    headings: tags whose values (with code and label) are joined, in order, as
    code and label; null where there are none. parts: named groups of tags, such
    as narratives or supplementary data, each a map of the first values that the
    record has of them.
    """
    shown = {t for tags in (grid, pair, scalars, lists, headings, *(parts or {}).values()) for t in tags}
    head = F.concat_ws(" ", "code", "label") if headings else F.lit(None).cast("string")
    value = F.struct("field_seq", "value_seq", "tag", "raw", head.alias("head"))
    own = vals.groupBy("ord").agg(F.sort_array(F.collect_list(F.when(F.col("tag").isin(*sorted(shown)), value))).alias("_own"))  # once for all columns
    of = lambda t, what="raw": F.transform(F.filter("_own", lambda x: x["tag"] == t), lambda x: x[what])
    own = own.select("ord", *[of(t).alias(f"_{t}") for t in sorted(shown)], *[of(t, "head").alias(f"_{t}_heads") for t in headings])
    all_of, some = lambda t: F.col(f"_{t}"), lambda c: F.when(F.size(c) > 0, c)

    def side_by_side(tags: tuple[str, ...]) -> Column:
        here = lambda x: reduce(lambda a, b: a & b, [x[t].isNotNull() for t in tags])
        return F.transform(F.arrays_zip(*[all_of(t).alias(t) for t in tags]), lambda x, i: F.struct(i.alias("pos"), *[x[t].alias(t) for t in tags], here(x).alias("complete")))

    def firsts(tags: tuple[str, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(F.size(all_of(t)) > 0, F.struct(F.lit(t).alias("tag"), F.get(all_of(t), F.lit(0)).alias("raw"))) for t in sorted({*tags})]))

    own = own.select(
        "ord", *[F.coalesce(F.get(all_of(t), F.lit(0)), F.lit("")).alias(t) for t in scalars], *[all_of(t).alias(t.lower() + "_all") for t in lists],
        side_by_side(grid).alias("grid"), side_by_side(pair).alias("pairs"),
        *[F.when(F.size(all_of(t)) > 0, F.array_join(F.col(f"_{t}_heads"), "; ")).alias(t.lower() + "_headings") for t in headings],
        *[firsts(tags).alias(name) for name, tags in (parts or {}).items()],
    )
    return own.withColumns({"grid": some(F.col("grid")), "pairs": some(F.col("pairs")), **{name: F.when(F.size(name) > 0, F.map_from_entries(name)) for name in (parts or {})}})


def lineage(shown: DataFrame, vals: DataFrame, records: DataFrame, evidence: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """For shown (line_id, ord, sources array of (tag, value_index or null), keys array): each source value, its place and the cited evidence.

    evidence has key and status, and what else is known of a key, such as its
    name and gloss, which is carried along. A key that it lacks has nulls.
    tags: all that sources name, where that is known; values of others are then dropped where they are read.
    """
    vals = vals if tags is None else vals.where(F.col("tag").isin(*tags))
    src = shown.select("line_id", "ord", "keys", F.explode("sources").alias("s")).select("line_id", "ord", "keys", F.col("s.tag").alias("tag"), F.col("s.value_index").alias("value_index"))
    hit = src.join(vals.select("ord", "tag", "value_seq", "raw", "line", "offset"), ["ord", "tag"]).where("value_index is null or value_index = value_seq")
    hit = hit.join(records.select("ord", "first_line", "last_line"), "ord")
    cited = hit.withColumn("key", F.explode("keys")).join(evidence, "key", "left")
    return cited.select("line_id", "ord", "tag", "value_seq", "raw", "line", "offset", "first_line", "last_line", "key", *[c for c in evidence.columns if c != "key"])


def with_files(lines: DataFrame, records: DataFrame, digests: DataFrame) -> DataFrame:
    """Lineage with the file (its path) and SHA-256 of the file that each record was read from; digests: (file, sha256) of the paths of records (ord, file)."""
    return lines.join(records.select("ord", "file"), "ord", "left").join(digests.select("file", "sha256"), "file", "left")


def weakest(cited: DataFrame, by: str) -> DataFrame:
    """(by, status): the weakest status of what is cited; null where none is."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return cited.groupBy(by).agg(F.min_by("status", F.nullif(rank, F.lit(0))).alias("status"))


def by_status(evidence: DataFrame) -> DataFrame:
    """(status, place, key): the keys of each status in their order, from 1; no status is gathered in one row."""
    own = sorted_ranks(evidence.select("status", "key"), F.col("status"), F.col("key"), name="rank")
    firsts = own.groupBy(F.col("status").alias("of")).agg(F.min("rank").alias("first"))
    return own.join(firsts, own["status"].eqNullSafe(F.col("of"))).select("status", (F.col("rank") - F.col("first") + 1).alias("place"), "key")


def record_json(vals: DataFrame, ids: DataFrame) -> DataFrame:
    """(ord, json) of the records of ids: fields with their values, in order."""
    own = vals.join(ids.select("ord"), "ord", "left_semi")
    f = own.groupBy("ord", "field_seq", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("value_seq", "raw"))), lambda x: x["raw"]).alias("values"))
    return f.groupBy("ord").agg(F.to_json(F.struct("ord", F.transform(F.array_sort(F.collect_list(F.struct("field_seq", "tag", "values"))), lambda x: F.struct(x["tag"].alias("tag"), x["values"].alias("values"))).alias("fields"))).alias("json"))
