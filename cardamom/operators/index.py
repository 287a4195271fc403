"""Indexes of a table of values: phrase, word and positional postings, term lists, reports.

Values are rows (ord, tag, field_seq, value_seq, raw). A code map says which
tags make up a code, in order; it is a constant of the schema, so it is broadcast.
A written index has a folder per code and first character of the term (its
shard), so that a search reads only the folders that it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.operators import checks


def code_map(spark, codes: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(code, tag, i) for code, tags in codes.items() for i, tag in enumerate(tags)]
    return F.broadcast(spark.createDataFrame(rows, "code string, tag string, tag_seq int"))


def _coded(vals: DataFrame, codes: dict[str, tuple[str, ...]]) -> DataFrame:
    """The values of the codes' tags with code and tag_seq; other columns of vals, such as a heading's own code, are ignored."""
    own = F.col("tag").isin(*{t: None for tags in codes.values() for t in tags})  # reaches the scan, which the join does not
    return vals.select("ord", "tag", "field_seq", "value_seq", "raw").where(own).join(code_map(vals.sparkSession, codes), "tag")


def phrase_postings(vals: DataFrame, codes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(code, term, ord), one row per record that has the term under any tag of the code; empty keys are left out."""
    keyed = _coded(vals, codes).select("code", text.phrase_key(F.col("raw")).alias("term"), "ord")
    return keyed.where("term <> ''").distinct()


def positions(vals: DataFrame, codes: dict[str, tuple[str, ...]], tasks: int | None = None) -> DataFrame:
    """(code, term, ord, field_ord, pos): every occurrence.

    Values are numbered over all tags of the code, so that two tags never share
    a field; words are numbered within a value, stop words included; the parts of
    a hyphenated word have its place. The explodes are outer ones, whose nulls are no
    terms: before others, Spark cuts each text once more to see whether it has words.
    tasks: among how many records are dealt out; as Spark has it, if not given.
    """
    v = _coded(vals, codes)
    v = v if tasks is None else v.repartition(tasks, "code", "ord")
    number = F.row_number().over(Window.partitionBy("code", "ord").orderBy("tag_seq", "field_seq", "value_seq")) - 1
    v = v.withColumn("field_ord", number)
    words = v.select("code", "ord", "field_ord", F.posexplode_outer(text.split_words(F.col("raw"))).alias("pos", "word"))
    return words.select("code", F.explode_outer(text.spellings(F.col("word"))).alias("term"), "ord", "field_ord", "pos").where(text.indexed(F.col("term")))


_VALUES = pa.schema([("code", pa.string()), ("ord", pa.int64()), ("raw", pa.string())])
_LISTS = pa.schema([("code", pa.string()), ("term", pa.string()), ("ord", pa.int64()), ("fields", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
_NO_TERMS = frozenset(("", *text.STOP_WORDS))
#: Each byte as it stands in a word, or a blank.
_IN_WORDS = np.array([b if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-" else 32 for b in range(256)], np.uint8)
#: Characters of text that are cut at a time.
CHUNK = 1 << 21


def _spelled(word: str) -> list[str]:
    """``text.spellings`` of a word at hand, terms only."""
    t = word.strip("-")
    return [x for x in ((t, *t.split("-")) if "-" in t else (t,)) if x not in _NO_TERMS]


def _words(texts: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts in capitals, in order, and the text that each stands in."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = _IN_WORDS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)]
    cut = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))
    row, words = pc.list_parent_indices(cut).to_numpy(), pc.list_flatten(cut)
    some = pc.not_equal(words, "")
    return row[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()


def _lists(values: pa.Table, record: np.ndarray) -> pa.RecordBatch:
    """Posting lists of whole records: values (``_VALUES``) with the number of each one's record."""
    row, coded = _words(values["raw"].combine_chunks())
    kind, spelled = coded.indices.to_numpy(), [_spelled(w) for w in coded.dictionary.to_pylist()]
    numbers: dict[str, int] = {}
    term_of = np.array([numbers.setdefault(t, len(numbers)) for own in spelled for t in own], np.int64)
    n_of = np.fromiter(map(len, spelled), np.int64, len(spelled))
    first_of = np.cumsum(n_of) - n_of
    before = np.concatenate([[0], np.flatnonzero(np.diff(record)) + 1]).astype(np.int64)  # the first value of each record
    sizes = np.bincount(row, minlength=len(record))
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    # a row per occurrence of a term
    each = n_of[kind]
    at = np.repeat(np.arange(len(row)), each)
    term = term_of[first_of[kind[at]] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)]
    key = record[row[at]] * max(len(numbers), 1) + term
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    ends = pa.array(np.append(begins, len(key)).astype(np.int32))
    value = before[record[row[at]]]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (row[at] - value, place[at])]
    own = pa.array(value[begins])
    column = lambda c: values[c].combine_chunks().take(own)
    return pa.RecordBatch.from_arrays([column("code"), pa.array(list(numbers), pa.string()).take(pa.array(term[order][begins])), column("ord"), *lists], schema=_LISTS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists (``_LISTS``) of values (``_VALUES``), which come by code, record and place; a record may go on in the next batch."""
    held = _VALUES.empty_table()
    for last, batch in chain(((False, b) for b in batches), [(True, _VALUES.empty_table())]):
        more = batch if last else pa.Table.from_batches([batch.cast(_VALUES)])
        t = pa.concat_tables([held, more]).combine_chunks()
        if not t.num_rows:
            continue
        code, own = t["code"].combine_chunks().dictionary_encode().indices.to_numpy(), t["ord"].to_numpy()
        record = np.concatenate([[0], np.cumsum((code[1:] != code[:-1]) | (own[1:] != own[:-1]))])
        size = np.cumsum(pc.utf8_length(t["raw"]).to_numpy()) // CHUNK
        starts = np.concatenate([[0], np.flatnonzero(np.diff(record)) + 1])
        # cut before records that begin another chunk; the last record may go on
        cuts = [0, *(starts[1:][size[starts[1:]] != size[starts[:-1]]]).tolist(), *([] if last else [int(starts[-1])])]
        cuts = sorted({*cuts, *([t.num_rows] if last else [])})
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _lists(t.slice(a, b - a), record[a:b] - record[a])
        held = t.slice(cuts[-1])


def posting_lists(vals: DataFrame, codes: dict[str, tuple[str, ...]], tasks: int | None = None) -> DataFrame:
    """(code, term, ord, fields, places): a row per record that has the term, with all of its occurrences (``positions``) in order.

    The two arrays go side by side: the value by its number and the word's place in
    it. Values are dealt out by record, and a task gathers the words of one record
    after the other, so no occurrence is shuffled or sorted. A row holds the
    occurrences of one term in one record, however many.
    tasks: among how many records are dealt out; as Spark has it, if not given.
    """
    v = _coded(vals, codes).select("code", "ord", "tag_seq", "field_seq", "value_seq", F.upper("raw").alias("raw"))
    v = v.repartition(*([] if tasks is None else [tasks]), "code", "ord").sortWithinPartitions("code", "ord", "tag_seq", "field_seq", "value_seq")
    return v.select("code", F.col("ord").cast("long").alias("ord"), F.coalesce("raw", F.lit("")).alias("raw")).mapInArrow(_gathered, "code string, term string, ord long, fields array<int>, places array<int>")


def occurrences(lists: DataFrame) -> DataFrame:
    """(code, term, ord, field_ord, pos) of posting lists, a row per occurrence."""
    return lists.select("code", "term", "ord", F.inline(F.arrays_zip(F.col("fields").alias("field_ord"), F.col("places").alias("pos"))))


def word_postings(vals: DataFrame, codes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(code, term, ord), one row per record and term."""
    words = _coded(vals, codes).select("code", "ord", F.explode_outer(F.array_distinct(text.split_words(F.col("raw")))).alias("word"))
    return words.select("code", F.explode_outer(text.spellings(F.col("word"))).alias("term"), "ord").where(text.indexed(F.col("term"))).distinct()


def term_list(postings: DataFrame) -> DataFrame:
    """(code, term, items): records per term."""
    return postings.groupBy("code", "term").agg(F.count("*").alias("items"))


def merged_terms(words: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """(term, items): records that have the term under any of the codes."""
    return words.where(F.col("code").isin(*codes)).select("term", "ord").distinct().groupBy("term").agg(F.count("*").alias("items"))


def sharded(postings: DataFrame) -> DataFrame:
    return postings.withColumn("shard", text.shard(F.col("term")))


def write_index(postings: DataFrame, path: str, tasks: int | None = None) -> None:
    """A folder per code and shard, sorted by term within its files; a prefix or term of very many postings takes several files. tasks: how many sort them."""
    order = [c for c in ("code", "shard", "term", "ord") if c == "shard" or c in postings.columns]
    sharded(postings).repartitionByRange(*([] if tasks is None else [tasks]), *order).sortWithinPartitions(*order).write.partitionBy("code", "shard").parquet(path)


def open_index(spark, path: str, columns: str = "term string, ord long") -> DataFrame:
    """The rows of a written index with code and shard; filters on these two decide which folders are read. Another shape is refused."""
    return checks.loaded(spark, path, columns, "code string, shard string")


def write_forward(phrases: DataFrame, path: str, buckets: int) -> None:
    """The same postings by record: a folder per code, in it ``buckets`` buckets of ord, each sorted by ord and term.

    What is grouped or joined by record, as sorting and ranking of sets are, reads a bucket per task and exchanges none of it.
    """
    table = f"forward_{uuid.uuid4().hex}"
    dealt = phrases.select("ord", "term", "code").repartition(buckets, "ord")
    dealt.write.partitionBy("code").bucketBy(buckets, "ord").sortBy("ord", "term").option("path", path).saveAsTable(table)
    phrases.sparkSession.sql(f"DROP TABLE {table}")  # the files stay: the table is not the catalog's own


def open_forward(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """(ord, term, code) as ``write_forward`` left it, bucketed by ord."""
    table = f"forward_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (ord BIGINT, term STRING, code STRING) USING parquet PARTITIONED BY (code) CLUSTERED BY (ord) SORTED BY (ord, term) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)  # the folders by code
    return spark.table(table)


def write_terms(terms: DataFrame, path: str) -> None:
    terms.repartitionByRange("code", "term").sortWithinPartitions("code", "term").write.parquet(path)


def report(lists: DataFrame) -> DataFrame:
    """(code, terms, postings, occurrences) per word code of posting lists."""
    a = lists.groupBy("code", "term").agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("occurrences"))
    return a.groupBy("code").agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.sum("occurrences").alias("occurrences"))


def stored_sizes(spark, path: str) -> DataFrame:
    """(part, code, shard, files, bytes) of a written index: its folders by code and shard, from the listing of files alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    # folder names escape what paths cannot hold
    name = lambda what: F.url_decode(F.replace(F.nullif(F.regexp_extract("path", rf"/{what}=([^/]*)/", 1), F.lit("")), F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract("path", r"/([^/=]+)(?:/[^/]+=[^/]*)*/[^/]+$", 1)
    return f.groupBy(part.alias("part"), name("code").alias("code"), name("shard").alias("shard")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def load_report(lists: DataFrame, vals: DataFrame, sets: dict[str, tuple[str, ...]], orphans: DataFrame, bad_lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(part, name, ord, n): all that a load has to say, a row per fact.

    terms, postings and occurrences: n of each code (name); bytes: of the files of
    each code, where sizes are given (``stored_sizes``); mismatch: a record in
    which the tags of a set (name) have different numbers of values; orphan: n
    continuations of a record that continue nothing; bad_lines: their number.
    """
    r = report(lists)
    facts = F.stack(F.lit(3), *[x for c in ("terms", "postings", "occurrences") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)).cast("long"))]).alias("part", "n")
    none = F.lit(None)
    counts = r.select(F.col("code").alias("name"), facts).select("part", "name", none.cast("long").alias("ord"), "n")
    uneven = count_mismatches(vals, sets).select(F.lit("mismatch"), "set_name", "ord", none.cast("long"))
    lost = orphans.groupBy("ord").agg(F.count("*").alias("n")).select(F.lit("orphan"), none.cast("string"), "ord", "n")
    if sizes is not None:
        counts = counts.union(sizes.where("code is not null").groupBy("code").agg(F.sum("bytes").alias("n")).select(F.lit("bytes"), "code", none.cast("long"), "n"))
    return counts.union(uneven).union(lost).union(bad_lines.select(F.lit("bad_lines"), none.cast("string"), none.cast("long"), "bad_lines"))


def count_mismatches(vals: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """(set_name, ord): records in which the tags of a set have different numbers of values; a missing tag has none.

    Values of the sets' tags are counted per record at once, a column for each tag, which is a constant of the schema.
    """
    every = list(dict.fromkeys(t for tags in sets.values() for t in tags))
    counts = vals.where(F.col("tag").isin(*every)).groupBy("ord").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("tag") == t, 1)).alias(f"_{i}") for i, t in enumerate(every)])
    of = lambda tags: F.array(*[F.col(f"_{every.index(t)}") for t in tags])
    uneven = F.array_compact(F.array(*[F.when(F.array_min(of(tags)) != F.array_max(of(tags)), name) for name, tags in sets.items()]).cast("array<string>"))
    return counts.select(F.explode(uneven).alias("set_name"), "ord")
