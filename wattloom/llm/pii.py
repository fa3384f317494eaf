"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Kinds: email, ip, card and phone are the base and are always kept; iban (mod-97) and national_id (nine digits as 3-2-4)
are extra and are kept only from the score of `keep` on. A null or empty text has no span. All other columns are left alone,
repeated rows get the same result each, a table without rows gives none."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
#: Length of an account number by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: Score of a span before its surroundings are read: how much the pattern and its validator say alone.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
#: Words within NEAR characters before a span that speak for its kind, and those that speak against any kind.
NEAR = 40
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"), "national_id": ("ssn", "social", "security", "identity"),
}
AGAINST = ("version", "isbn", "invoice", "order", "part", "serial", "sku")
STEP = 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    """Checksum of account numbers: country and check digits go last, letters count from ten on."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds exactly one @: the run of name characters before it, cut off by the match before, and a dotted domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", end if m else at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Chains of dotted numbers, four parts at a time from the left; a foursome with a part over 255 is dropped."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        n, end, at = IBAN_LENGTH.get(m.group()[:2], 99), m.start(), []
        for end in range(m.start(), m.end()):
            if text[end] != " ":
                at.append(text[end])
                if len(at) == n:
                    break
        if len(at) == n and mod97("".join(at)):
            yield m.start(), end + 1


def score(text: str, kind: str, start: int) -> float:
    """Prior of the kind, moved once by words nearby that speak for it and once by those that speak against it."""
    near = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * (not near.isdisjoint(FOR[kind])) - STEP * (not near.isdisjoint(AGAINST)))), 2)


def spans_of(text: str | None, keep: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [("email", s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(k, s) for k, f in (("ip", addresses), ("card", cards), ("iban", accounts)) for s in f(text)]
        found += [("phone", s) for s in phones(text)] if "+" in text else []
        found += [("national_id", m.span()) for m in _NATIONAL.finditer(text)] if "-" in text else []
    out = [(s, e, k, score(text, k, s)) for k, (s, e) in found]
    return sorted((x for x in out if x[2] in BASE or x[3] >= keep), key=lambda x: (x[0], KINDS.index(x[2])))


def masked(text: str | None, keep: float = 0.5) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    spans = spans_of(text, keep)
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of each row of `docs` (doc_id, text)."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in spans_of(t, keep)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(item))], ["doc_id", "spans"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, score double>>")


def mask_pii(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """All columns of `docs`; the text has its spans masked, a null text stays null. n_chars, if there, follows the text."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t, keep) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out


def digest(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text, one row per row of `docs`."""
    found = find_pii(docs, keep)
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"))
