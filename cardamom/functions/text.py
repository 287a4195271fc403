"""Keys, words and checks of text values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that are not indexed.
STOP_WORDS = ("AN", "BY", "FROM", "THE", "WITH", "AND", "FOR", "OF", "TO")
#: White space as the trimmed text knows it; U+00A0 is one, U+0085 is not.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + r"+\z", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def spaced(c: Column) -> Column:
    """Words with one blank between them. Single blanks, as most are, are not touched."""
    return F.btrim(F.regexp_replace(c, SPACE + "{2,}|" + SPACE.replace(" ", ""), " "), F.lit(" "))


def reduced(c: Column) -> Column:
    """Capitals, digits and blanks of a text, all else left out."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", "")


def phrase_key(c: Column) -> Column:
    """A whole value as a term: trailing white space off, capitals, spacing inside kept."""
    return F.upper(trim_end(c))


def split_words(c: Column) -> Column:
    """All words in order, stop words included: places are counted over these."""
    return F.array_remove(F.split(F.upper(c), "[^A-Z0-9-]+"), "")


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit("-"))


def indexed(term: Column) -> Column:
    """Whether a spelling is a term; stop words and what is left of bare hyphens are none."""
    return (term != "") & ~term.isin(*STOP_WORDS)


def spellings(word: Column) -> Column:
    """One word without outer hyphens, and the parts of a hyphenated one, whether ``indexed`` or not.

    Where rows are exploded from it, filter them afterwards: a filter inside the
    array would take the operator out of generated code.
    """
    t = bare(word)
    return F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))


def tokens(c: Column) -> Column:
    """The terms of a value as an array."""
    return F.filter(F.flatten(F.transform(split_words(c), spellings)), indexed)


def shard(term: Column) -> Column:
    return F.when(term.rlike("^[A-Z0-9]"), F.substring(term, 1, 1)).otherwise("_")


def shard_of(term: str) -> str:
    """``shard`` of a term at hand."""
    return term[:1] if term[:1].isascii() and term[:1].isalnum() and not term[:1].islower() else "_"


def alnum(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), "[^A-Z0-9]", "")


def shown_accession(an: Column) -> Column:
    """A blank and at least eight digits; longer ones are not cut."""
    return F.concat(F.lit(" "), F.when(F.length(an) >= 8, an).otherwise(F.lpad(an, 8, "0")))


def is_accession(an: Column) -> Column:
    return (F.octet_length(an) == 7) & an.rlike("^[0-9]{7}$")


def canonical_code(c: Column) -> Column:
    """Three digits, after one R or none; null otherwise."""
    return F.nullif(F.regexp_extract(c, r"\AR?([0-9]{3})\z", 1), F.lit(""))


def percent(c: Column) -> Column:
    """A whole number (a sign and digits, nothing else) with one % or none; null otherwise."""
    digits = F.regexp_replace(c, r"%\z", "")
    return F.when(digits.rlike(r"\A[-+]?[0-9]+\z"), digits.try_cast("decimal(38,0)"))


def long_words(c: Column, most: int = 60) -> Column:
    """Words between blanks of more than ``most`` bytes as Latin-1."""
    return F.filter(F.split(c, " +"), lambda w: F.octet_length(F.encode(w, "ISO-8859-1")) > most)


def is_year(c: Column) -> Column:
    return F.octet_length(c).isin(2, 4)


def has_length(c: Column, least: int, most: int) -> Column:
    return F.octet_length(c).between(least, most)


def not_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def excerpt(b: Column, n: int = 24) -> Column:
    """The first bytes as text, or in hexadecimal where they are not UTF-8."""
    head = F.substring(b, 1, n)
    return F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(F.hex(head))


def stamp(ts: Column) -> Column:
    """01jan24 00:00:00 in UTC, whatever the session's time zone."""
    ts = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat_ws(" ", F.lower(F.date_format(ts, "ddMMMyy")), F.date_format(ts, "HH:mm:ss"))


def line_offset(line: Column, width: int = 82) -> Column:
    return (line - 1) * width


def offset_line(offset: Column, width: int = 82) -> Column:
    return (F.floor(offset / width) + 1).cast("long")


def headings(items: Column, separator: str = "; ") -> Column:
    """code label; code label ..."""
    return F.array_join(F.transform(items, lambda h: F.concat_ws(" ", h["code"], h["label"])), separator)
