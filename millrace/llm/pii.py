"""Personal data: patterns propose, checksums confirm, nearby words adjust a score.

Every span has a kind, a begin and an end in code points (end exclusive) and a score. The
four base kinds (email, ip, card, phone) are found leftmost and without overlap inside a
kind; a match that its validator refuses is dropped and not tried again at another length.
They are always reported, with their score. Further kinds are reported when their score
reaches ``REPORTED``: what a validator confirms is the prior, whole words near the span raise
or lower it, so that the words decide where the pattern alone does not.

Defined results: a null or empty text has no spans; any length of text is searched whole,
in time that grows with its length; rows are independent, so null or repeated ids and
repeated rows need no care; an empty table gives no rows; other columns are kept out of the
way by selecting the id and the text only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import spread
from .batches import sliced


class Span(NamedTuple):
    kind: str
    begin: int
    end: int
    score: float


BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
REPORTED = 0.5

# What is looked for.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: a later start would meet the same next character.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NEAR = re.compile(r"[^\W\d_]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"""(?i:\b(?:token|secret|password|api[_-]?key)\b)\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_/+=-]{16,}+)""")

# Words that speak for a kind, and words that speak against it, within WINDOW characters of a span.
WINDOW = 40
CONTEXT = {
    "email": "mail email emails contact write address reach",
    "ip": "ip ips address addresses host server client ping login",
    "card": "card cards visa mastercard amex credit debit payment pay paid karte",
    "phone": "phone phones call calls tel telephone mobile cell fax telefon",
    "iban": "iban account accounts bank transfer payment konto cuenta compte",
    "ssn": "ssn social security taxpayer tin",
    "secret": "token tokens secret password passwd apikey api key login credentials",
}
AGAINST = {
    "email": "example sample",
    "ip": "version release section chapter build firmware",
    "card": "order isbn tracking serial part invoice",
    "phone": "order isbn tracking serial part invoice",
    "iban": "isbn serial part sku model example sample",
    "ssn": "order part serial sku model isbn example sample",
    "secret": "placeholder dummy sample example redacted",
}
CONTEXT, AGAINST = ({k: frozenset(v.split()) for k, v in x.items()} for x in (CONTEXT, AGAINST))
# The score of a span that its validator confirmed, without context, and what context moves.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "secret": 0.3}
MOVES = 0.3
# Lengths of account numbers by country. A number of its country's length is surer by KNOWN_LENGTH.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH_OF = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
KNOWN_LENGTH = 0.2


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number passes the ISO 13616 check."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _AFTER_AT.match(text, at) if begin < at else None
        if match:
            free = match.end()
            yield begin, free
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The confirmed spans of the base kinds, by kind and then begin."""
    found = [("email", b, e) for b, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_fits, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", "")):
            yield ("iban", *m.span())
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield ("ssn", *m.span())
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                yield ("secret", *m.span(1))


def near_words(text: str, begin: int, end: int) -> set[str]:
    """The whole words, lower-cased, that begin and end within WINDOW characters before or after a span."""
    out: set[str] = set()
    for lo, hi in ((max(0, begin - WINDOW), begin), (end, min(len(text), end + WINDOW))):
        for m in _NEAR.finditer(text, lo, hi):
            # A word that the window's edge cuts is none.
            cut = (m.start() == lo and lo > 0 and text[lo - 1].isalpha()) or (m.end() == hi and hi < len(text) and text[hi].isalpha())
            if not cut:
                out.add(m[0].lower())
    return out


def score(text: str, kind: str, begin: int, end: int) -> float:
    """The prior of the kind, moved by the words nearby."""
    near, prior = near_words(text, begin, end), PRIOR[kind]
    if kind == "iban":
        number = text[begin:end].replace(" ", "")
        prior += KNOWN_LENGTH * (_LENGTH_OF.get(number[:2]) == len(number))
    moved = prior + MOVES * (not near.isdisjoint(CONTEXT[kind])) - MOVES * (not near.isdisjoint(AGAINST[kind]))
    return round(min(1.0, max(0.0, moved)), 2)


def find(text: str) -> list[Span]:
    """All reported spans of a text: base kinds, then added kinds, each by begin."""
    spans = [Span(*s, score(text, *s)) for s in base_spans(text)]
    added = (Span(*s, score(text, *s)) for s in _added(text))
    return spans + [s for s in added if s.score >= REPORTED]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by its kind in angle brackets."""
    out, done, ordered = [], 0, sorted(spans, key=lambda s: (s.begin, -s.end))
    for s in ordered:
        if s.begin >= done:
            out += [text[done : s.begin], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


#: What a sink makes of the texts and their spans: one Arrow array for each field of its schema.
Sink = Callable[[list[str | None], list[list[Span]]], list[pa.Array]]

SPANS = T.StructType([T.StructField(
    "pii",
    T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
)])
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
DIGESTS = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("scores", T.StringType())
])
REDACTED = T.StructType([T.StructField("redacted", T.StringType())])


def spans_sink(_texts, spans) -> list[pa.Array]:
    """Spans with scores as an array of structs."""
    return [pa.array([[s._asdict() for s in x] for x in spans], _SPANS_ARROW)]


def digest_sink(_texts, spans) -> list[pa.Array]:
    """Counts of the base kinds, a digest of the base spans, all spans and their scores as text."""
    joined = lambda x: ",".join(f"{s.kind}:{s.begin}:{s.end}" for s in x)
    base = [[s for s in x if s.kind in BASE_KINDS] for x in spans]
    counts = [pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
    digests = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
    scores = pa.array([",".join(f"{s.score:.2f}" for s in x) for x in spans], pa.string())
    return [*counts, digests, pa.array([joined(x) for x in spans], pa.string()), scores]


def redact_sink(texts, spans) -> list[pa.Array]:
    """The redacted text; null stays null."""
    return [pa.array([None if t is None else redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string())]


def find_pii(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sink: Sink = spans_sink,
    sink_schema: T.StructType = SPANS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: its id, the columns in ``keep``, and what ``sink`` makes of its spans.

    A map over the scan, without shuffle.
    """
    kept = [id_column, *keep]
    schema = T.StructType([*(docs.schema[c] for c in kept), *sink_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            spans = [find(x) if x else [] for x in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sink(texts, spans)], names=schema.names)

    return spread(docs.select(*kept, F.col(text_column).cast("string").alias("__text"))).mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind; a length column follows the text."""
    others = tuple(c for c in docs.columns if c not in (id_column, text_column))
    out = find_pii(docs, id_column, text_column, redact_sink, REDACTED, others)
    columns = {c: F.col(c) for c in docs.columns} | {text_column: F.col("redacted").alias(text_column)}
    if length_column in docs.columns:
        # Only where spans changed the text does its length change.
        kind = docs.schema[length_column].dataType
        columns[length_column] = F.when(
            F.col("redacted").isNull(), F.col(length_column)
        ).otherwise(F.length("redacted")).cast(kind).alias(length_column)
    return out.select(*(columns[c] for c in docs.columns))
