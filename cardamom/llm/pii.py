"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are decided by pattern and checksum alone.
Further kinds are proposed loosely and scored: a start score for the pattern,
more for a confirmed checksum, more or less for words within CONTEXT characters
before or after. A span is kept from THRESHOLD on. Words nearby never bring an
account number with a right checksum or a key with a known prefix below it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the scored patterns add, in the order in which spans at one place are listed after the base ones.
MORE_KINDS = ("iban", "national_id", "secret", "number")
CONTEXT = 40
THRESHOLD = 1.0

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number by country, as registered under ISO 13616.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64})(?![A-Za-z0-9_])")
#: The head of a private key, with the key if it is whole.
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*+[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")
_NEAR = {
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "national_id": re.compile(r"ssn|social\s+security|national\s+id|tax\s+id", re.I),
    "secret": re.compile(r"token|secret|password|passwd|api[_ -]?key|access[_ -]?key|credential", re.I),
    "number": re.compile(r"card|visa|credit|karte|carte|tarjeta|account|konto", re.I),
}
_AGAINST = re.compile(r"(?<![^\W\d_])(?:isbn|issn|version|commit|sha-?1|sha-?256|md5|checksum|order(?!\s+to\b)|invoice)s?(?![^\W\d_])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Four first characters last, letters as 10 to 35: the number leaves 1 when divided by 97."""
    text = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, confirmed) of what may be account numbers.

    What follows an account number may look like more of it, so the end is the
    one at its country's length. Of other countries, the last end of a group at
    which the checksum holds. The next is sought behind a confirmed one, and
    behind the start of any other.
    """
    m = _IBAN.search(text)
    while m:
        ends = [i for i, c in enumerate(m[0]) if c == " "] + [len(m[0])]
        size = _IBAN_LENGTH.get(m[0][:2])
        bare = {i: m[0][:i].replace(" ", "") for i in ends}
        tried = [i for i in ends if len(bare[i]) == size] + ends[-1:] if size else [i for i in reversed(ends) if len(bare[i]) >= 15]
        end = next((i for i in tried if mod97(bare[i])), None)
        yield m.start(), m.start() + (end or len(m[0])), end is not None
        m = _IBAN.search(text, m.start() + (end or 1))


def _context(text: str, a: int, b: int, kind: str) -> float:
    near = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
    return 0.6 * bool(_NEAR[kind].search(near)) - 0.5 * bool(_AGAINST.search(near))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds with their scores, those under the threshold included."""
    found = []
    for a, b, ok in ibans(text):
        found.append(("iban", a, b, max(THRESHOLD * ok, 0.3 + 0.7 * ok + _context(text, a, b, "iban"))))
    for m in _NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        ok = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        found.append(("national_id", m.start(), m.end(), 0.4 + 0.3 * ok - 0.7 * (not ok) + _context(text, *m.span(), "national_id")))
    for m in _SECRET.finditer(text):
        known = not re.fullmatch("[0-9a-f]+", m[0])
        found.append(("secret", m.start(), m.end(), max(THRESHOLD * known, 0.5 + 0.5 * known + _context(text, *m.span(), "secret"))))
    found += [("secret", m.start(), m.end(), THRESHOLD) for m in _KEY_BLOCK.finditer(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 13 and luhn(digits):
            found.append(("number", m.start(), m.end(), 0.5 + _context(text, *m.span(), "number")))
    return found


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together, by start and then kind. Null is empty."""
    text = text or ""
    base = base_spans(text)
    more = [s[:3] for s in scored_spans(text) if s[3] >= THRESHOLD]
    order = {k: i for i, k in enumerate(KINDS + MORE_KINDS)}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]]))


def _listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, found: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with each span, overlapping ones merged, as <KIND> of the one that begins first."""
    if text is None:
        return None
    found = spans(text)[1] if found is None else found
    out, at = [], 0
    for kind, a, b in found:
        if a < at:  # overlaps what is already replaced
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if found else text


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Null and empty texts have no spans. Rows with a null or repeated doc_id are
    treated like any other; other columns are ignored. Places are code points. An
    empty table stays empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, every = spans(text)
                count = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*count, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield out

    kind = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, kind)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; all rows and other columns stay.

    Null and empty texts stay as they are, repeated rows are treated alike, an
    empty table stays empty.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact)

    return docs.withColumn("text", run(F.col("text").cast("string")))
