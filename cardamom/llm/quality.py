"""Quality rules as a ledger: each rule is evaluated once, policies only read bits.

``ledger`` adds measurements and a long whose bit r is set where rule r fails.
A policy is a named, versioned set of rules; ``apply_policy`` keeps a document
if none of its bits is set, and ``ablation`` tells from the ledger alone how many
documents each rule rejects, rejects alone, and would bring back if dropped.
Only built-in column functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Rules in the order of their bits: name and the condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "n_words >= 10 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum({bits[r] for r in self.rules})


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PROSE = Policy("prose", 1, tuple(name for name, _ in RULES))
POLICIES = (BASE, PROSE)


def measured(docs: DataFrame) -> DataFrame:
    """docs (columns of any names but those of one underscore at the end) with the measurements in a struct m_.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and
    n_repeat_words, all long. Null text counts as empty.
    """
    text, words, wins = F.col("text_"), F.col("words_"), F.col("wins_")
    df = docs.withColumn("text_", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("words_", F.filter(F.split(text, SPACES), lambda x: x != ""))
    df = df.withColumn("hash_", F.transform(words, lambda x: F.xxhash64(x)))
    places = F.sequence(F.lit(1), F.size("hash_") - WINDOW + 1)
    windows = F.transform(places, lambda i: F.xxhash64(F.slice(F.col("hash_"), i, WINDOW)))
    df = df.withColumn("wins_", F.when(F.size("hash_") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only a text in which some window occurs twice needs its places; of those with one hash the words are compared
    placed = F.array_sort(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("wins_", F.when(F.size(wins) > F.size(F.array_distinct(wins)), placed))
    read = F.transform(_twice(wins, "bigint"), lambda z: F.struct(F.array_join(F.slice(words, z["i"] + 1, WINDOW), " ").alias("h"), z["i"].alias("i")))
    df = df.withColumn("wins_", F.array_sort(read))
    covered = F.aggregate(
        F.array_sort(F.transform(_twice(wins, "string"), lambda z: z["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
    )["n"]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(wins.isNotNull(), covered).otherwise(0),
    }
    df = df.withColumn("m_", F.struct(*[(c.cast("long") + _here()).alias(name) for name, c in measures.items()]))
    return df.drop("text_", "words_", "hash_", "wins_")


def _twice(placed: Column, kind: str) -> Column:
    """Of a sorted array of (h, i), those whose h stands before or after them too."""
    h, none = F.transform(placed, lambda x: x["h"]), F.array(F.lit(None).cast(kind))
    near = F.arrays_zip(placed.alias("x"), F.concat(none, F.slice(h, 1, F.size(placed) - 1)).alias("b"), F.concat(F.slice(h, 2, F.size(placed)), none).alias("a"))
    found = F.filter(near, lambda z: z["x"]["h"].eqNullSafe(z["b"]) | z["x"]["h"].eqNullSafe(z["a"]))
    return F.transform(F.when(F.size(placed) > 0, found).otherwise(F.slice(near, 1, 0)), lambda z: z["x"])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fail_bits long) for every row, whatever its other columns.

    A null or empty text has no words: it fails few_words and no other rule.
    Rows with a null or repeated doc_id are measured like any other.
    """
    return with_ledger(docs.select("doc_id", "text")).select("doc_id", "m_.*", "fail_bits_").withColumnRenamed("fail_bits_", "fail_bits")


def with_ledger(docs: DataFrame) -> DataFrame:
    """docs with m_ and fail_bits_."""
    bits = [F.when(F.expr(_on(rule)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs).withColumn("fail_bits_", total + _here())


def _here() -> Column:
    """0. Not deterministic to the optimizer, which otherwise copies all measurements into any filter on them."""
    return (F.spark_partition_id() * 0).cast("long")


def _on(rule: str) -> str:
    for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
        rule = rule.replace(name, f"m_.{name}")
    return rule


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy, version and kept."""
    return led.withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version), "kept": passes(policy)})


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and that fail it alone (kept again without it).

    Rows count one by one, whatever their doc_id; for an empty ledger there are no rows.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    by = led.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    each = by.select("bits", "n", rules).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )


def kept_documents(docs: DataFrame, policy: Policy = PROSE) -> DataFrame:
    """The rows of docs that pass the policy, columns (of any names) unchanged.

    Null and empty texts fail few_words. Repeated rows are judged alike, rows
    without a doc_id like any other; an empty table stays empty.
    """
    whole = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    return with_ledger(whole).where(passes(policy, "fail_bits_")).select("row_.*")
