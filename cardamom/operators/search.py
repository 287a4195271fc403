"""Search expressions over the indexes; each gives the set of matching ordinals.

An expression is nested explicitly: And(Not(a, b), c). Nothing is evaluated
until ``found`` turns it into a DataFrame. Besides the term, searches state its
code and shard, so that only those folders of a written index are read. A code
that the index does not have is an error, not an empty set.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.operators import browse, checks, index
from cardamom.plans.numbering import scratch
from cardamom.schema import PHRASE_TAGS, WORD_ALIASES, WORD_TAGS


@dataclass(frozen=True)
class Index:
    """Postings with code and shard, posting lists of words, the lists of terms, the codes that there are, and phrases by record.

    forward: (ord, term, code), the phrase postings for what is grouped by record; bucketed by ord in a written index.
    """

    phrases: DataFrame
    words: DataFrame
    places: DataFrame | None
    phrase_codes: tuple[str, ...]
    word_codes: tuple[str, ...]
    merged: tuple[str, ...] = ()
    phrase_terms: DataFrame | None = None
    word_terms: DataFrame | None = None
    folder: str | None = None
    forward: DataFrame | None = None

    def codes(self, asked: tuple[str, ...], phrase: bool = False) -> tuple[str, ...]:
        """The word codes (or phrase codes) meant; one that the index lacks is refused, and a documented one said to be just that."""
        known = self.phrase_codes if phrase else self.word_codes
        own = asked if phrase else tuple(WORD_ALIASES.get(c, c) for c in asked)
        for code, was in zip(own, asked, strict=True):
            if code not in known:
                what = "field" if phrase else "suffix"
                documented = code in (PHRASE_TAGS if phrase else WORD_TAGS)
                raise ValueError(f"{what} not in this index: {was}" if documented else f"unknown {what}: {was}")
        return own or self.merged


_PLACES = "term string, ord long, fields array<int>, places array<int>"


def built(vals: DataFrame, phrases: dict[str, tuple[str, ...]], words: dict[str, tuple[str, ...]], merged: tuple[str, ...], tasks: int | None = None) -> Index:
    """The index of a table of values, made anew by each search. tasks: among how many the records with words are dealt out."""
    p, lists = index.phrase_postings(vals, phrases), index.posting_lists(vals, words, tasks)
    w = lists.select("code", "term", "ord")
    return Index(index.sharded(p), index.sharded(w), index.sharded(lists), tuple(phrases), tuple(words), merged, index.term_list(p), index.term_list(w), forward=p.select("ord", "term", "code"))


#: Written last: what an index was made of. Without it, what lies in the folder is no index.
MARKER = "made_of.json"


def write(made: Index, folder: str, sources: tuple = (), buckets: int | None = None, tasks: int | None = None) -> None:
    """Writes all parts of an index under folder. The mark of completion, with the sources, comes last.

    Postings of words are the posting lists without their places, so they are not stored apart.
    buckets: those of the phrases by record, as many as shuffle partitions if not given.
    tasks: how many sort the posting lists, as Spark has it if not given.
    """
    spark = made.phrases.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def part(name: str, terms: str, tasks: int | None = None) -> None:
        # sorting in ranges looks at its rows twice; to gather words again costs less than to write and read them
        rows = getattr(made, name).drop("shard")
        index.write_index(scratch(rows, name) if name == "phrases" else rows, f"{folder}/{name}", tasks)
        browse.write_list(index.term_list(opened_part(spark, folder, name)), f"{folder}/{terms}")

    def phrases() -> None:
        part("phrases", "phrase_terms")
        index.write_forward(opened_part(spark, folder, "phrases"), f"{folder}/forward", buckets)

    # phrases and words share nothing, so the jobs of one fill what those of the other leave idle
    with ThreadPoolExecutor(2) as both:
        jobs = [both.submit(inheritable_thread_target(spark)(f)) for f in (phrases, lambda: part("places", "word_terms", tasks))]
        for job in jobs:
            job.result()
    store = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = store.Path(f"{folder}/{MARKER}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps([sources, buckets]).encode()))
    out.close()


def opened_part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return index.open_index(spark, f"{folder}/{name}", _PLACES if name == "places" else "term string, ord long")


def mark_of(spark: SparkSession, folder: str) -> tuple[tuple, int] | None:
    """What a written index was made of, and its number of buckets; None where it is not complete."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = store.Path(f"{folder}/{MARKER}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    (row,) = spark.read.text(str(path), wholetext=True).collect()
    thaw = lambda x: tuple(map(thaw, x)) if isinstance(x, list) else x
    return thaw(json.loads(row[0]))


def opened(spark: SparkSession, folder: str, phrase_codes: tuple[str, ...], word_codes: tuple[str, ...], merged: tuple[str, ...], sources: tuple | None = None) -> Index:
    """A written index: searches read the folders of the codes and shards that they name.

    An index that was not written to its end is refused, and so is one whose
    sources (paths, lengths and times of files) are not those given.
    """
    mark = mark_of(spark, folder)
    if mark is None:
        raise ValueError(f"{folder}: no complete index")
    made_of, buckets = mark
    if sources is not None and made_of != sources:
        raise ValueError(f"{folder}: the sources have changed since the index was written")
    terms = [checks.loaded(spark, f"{folder}/{name}_terms", "code string, term string, items long") for name in ("phrase", "word")]
    places = opened_part(spark, folder, "places")
    return Index(opened_part(spark, folder, "phrases"), places.select("code", "shard", "term", "ord"), places, phrase_codes, word_codes, merged, *terms, folder, index.open_forward(spark, f"{folder}/forward", buckets))


@dataclass(frozen=True)
class Term:
    """A whole value of a phrase code."""

    code: str
    value: str


@dataclass(frozen=True)
class Word:
    """A word under any of the codes (none: the merged index). It is keyed, not cut into words."""

    value: str
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Prefix:
    """All words that begin with the stem."""

    stem: str
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class PhrasePrefix:
    code: str
    stem: str


@dataclass(frozen=True)
class Near:
    """W: right after left, N: either order, within ``within`` words; F: in the same value."""

    kind: str
    left: Word | Prefix
    right: Word | Prefix
    within: int = 1


@dataclass(frozen=True)
class SetOf:
    """A set made before."""

    ids: DataFrame


@dataclass(frozen=True)
class Refs:
    """The postings of shown rows of a term list (term column), under the codes."""

    rows: DataFrame
    codes: tuple[str, ...]
    phrase: bool = False


@dataclass(frozen=True)
class And:
    a: object
    b: object


@dataclass(frozen=True)
class Or:
    a: object
    b: object


@dataclass(frozen=True)
class Not:
    """a without b."""

    a: object
    b: object


def _matches(e: Word | Prefix | PhrasePrefix):
    if isinstance(e, Word):
        word = e.value.upper()
        return (F.col("shard") == text.shard_of(word)) & (F.col("term") == word)
    stem = e.stem.upper()
    begins = F.col("term").startswith(stem)
    return (F.col("shard") == text.shard_of(stem)) & begins if stem else begins


def _leaf_places(e: Word | Prefix, own: Index) -> DataFrame:
    """(code, ord, fields, places): a row per record of the operand; the lists of all terms of a prefix are one."""
    rows = own.places.where(F.col("code").isin(*own.codes(e.codes)) & _matches(e)).select("code", "ord", "fields", "places")
    if isinstance(e, Word):
        return rows
    rows = rows.groupBy("code", "ord").agg(F.collect_list(F.struct("fields", "places")).alias("x"))
    return rows.select("code", "ord", F.flatten("x.fields").alias("fields"), F.flatten("x.places").alias("places"))


#: Numbers that a place in a value stays below: value and place are one number where lists are compared.
_VALUE_PLACES = 1 << 32


def near_pairs(e: Near, own: Index) -> DataFrame:
    """(ord) of records with both operands near each other.

    Posting lists of one record meet; places of the left one, spread over those
    that count as near, are looked up in a hash table of the right one's. So the
    work of a record is the length of its lists, no pairs of occurrences are formed,
    and a row is shuffled for each term and record, not for each occurrence.
    """
    a, b = _leaf_places(e.left, own), _leaf_places(e.right, own).withColumnsRenamed({"fields": "fields_", "places": "places_"})
    both = a.join(b, ["code", "ord"])
    if e.kind == "F":
        return both.where(F.arrays_overlap("fields", "fields_")).select("ord").distinct()
    away = [*range(1, e.within + 1), *(range(-e.within, 0) if e.kind == "N" else ())]
    one = lambda f, p: F.zip_with(f, p, lambda x, y: x.cast("long") * _VALUE_PLACES + y)
    spread = F.flatten(F.transform(one("fields", "places"), lambda x: F.array(*[x + i for i in away])))
    return both.where(F.arrays_overlap(spread, one("fields_", "places_"))).select("ord").distinct()


def found(e, own: Index) -> DataFrame:
    """(ord) of the records that match, each once."""
    if isinstance(e, Term):
        key = text.phrase_key(F.lit(e.value))
        own.codes((e.code,), phrase=True)
        return own.phrases.where((F.col("code") == e.code) & (F.col("shard") == text.shard(key)) & (F.col("term") == key)).select("ord")
    if isinstance(e, Word | Prefix):
        return own.words.where(F.col("code").isin(*own.codes(e.codes)) & _matches(e)).select("ord").distinct()
    if isinstance(e, PhrasePrefix):
        own.codes((e.code,), phrase=True)
        return own.phrases.where((F.col("code") == e.code) & _matches(e)).select("ord").distinct()
    if isinstance(e, Near):
        return near_pairs(e, own)
    if isinstance(e, SetOf):
        return e.ids.select("ord").distinct()
    if isinstance(e, Refs):
        table = own.phrases if e.phrase else own.words
        return table.where(F.col("code").isin(*own.codes(e.codes, e.phrase))).join(e.rows.select("term"), "term", "left_semi").select("ord").distinct()
    if isinstance(e, And):
        return found(e.a, own).join(found(e.b, own), "ord", "left_semi")
    if isinstance(e, Or):
        return found(e.a, own).union(found(e.b, own)).distinct()
    if isinstance(e, Not):
        return found(e.a, own).join(found(e.b, own), "ord", "left_anti")
    raise ValueError(f"not a search expression: {e!r}")


def leaves(e) -> list:
    """Operands in the order in which they are written; a set made before is none, a proximity one of three counts."""
    if isinstance(e, And | Or | Not):
        return leaves(e.a) + leaves(e.b)
    if isinstance(e, Near):
        return [e.left, e.right, e]
    return [] if isinstance(e, SetOf) else [e]


def shown(e) -> str:
    if isinstance(e, Term):
        return f"{e.code}={e.value}"
    if isinstance(e, Word):
        return e.value + "".join(e.codes)
    if isinstance(e, Prefix):
        return e.stem + "?" + "".join(e.codes)
    if isinstance(e, PhrasePrefix):
        return f"{e.code}={e.stem}?"
    if isinstance(e, Near):
        return f"{shown(e.left)}({e.kind}{e.within if e.kind != 'F' else ''}){shown(e.right)}"
    return "rows"


def operand_counts(e, own: Index) -> DataFrame:
    """(seq, operand, items): the records that each operand finds by itself."""
    parts = []
    for i, leaf in enumerate(leaves(e)):
        n = found(leaf, own).agg(F.count("*").alias("items"))
        parts.append(n.select(F.lit(i + 1).alias("seq"), F.lit(shown(leaf)).alias("operand"), "items"))
    return reduce(DataFrame.union, parts)


def steps(e, own: Index) -> DataFrame:
    """(step, ord): a set for each operand and, if there are several, one for the whole."""
    each = leaves(e)
    every = each if len(each) == 1 else [*each, e]
    return reduce(DataFrame.union, [found(x, own).select(F.lit(i + 1).alias("step"), "ord") for i, x in enumerate(every)])
