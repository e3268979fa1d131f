"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

``find_spans`` gives what is in one text; ``detect`` and ``redact`` run it over
a table. A row depends on its own text alone, so there is no shuffle and a lost
executor costs only its running tasks. Every search is linear in the text.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are the base: leftmost
non-overlapping matches that pass their check, whatever stands around them.
``iban`` (ISO 13616, remainder 1 modulo 97), ``ssn`` (three-two-four digits) and
``secret`` (20 signs or more, letters and digits, of at least 3 bits of entropy each)
are added where their score reaches ``threshold``; an ssn and a secret carry
no checksum, so they need a word nearby.

Null or empty text: no spans. Repeated rows: one result each. Other columns are
ignored by ``detect`` and kept by ``redact``. Very long texts are read whole.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.llm.batches import bounded, keyed_texts, pieces

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A run of digits that can't start an address can't do so from its middle either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9]{4})")
_BODY = re.compile(r"(?:\x20?[A-Z0-9]{4}){0,7}(?:\x20?[A-Z0-9]{1,3})?")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}")

# Words that make a kind more likely, or less so, when they stand within WINDOW characters.
NEAR = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "ip", "server"),
    "card": ("card", "credit", "payment", "visa"),
    "phone": ("call", "fax", "mobile", "phone", "tel"),
    "iban": ("account", "bank", "iban", "transfer"),
    "ssn": ("security", "social", "ssn"),
    "secret": ("api", "bearer", "credential", "key", "password", "secret", "token"),
}
AGAINST = ("build", "example", "isbn", "order", "part", "release", "sample", "version")
# What a kind's pattern and check are worth by themselves.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
WINDOW = 40
# Characters of the registered countries' account numbers (ISO 13616).
_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = ord(x) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    rest = 0
    for x in plain[4:] + plain[:4]:
        v = int(x, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def entropy(text: str) -> float:
    """Bits for each sign."""
    return sum(n / len(text) * math.log2(len(text) / n) for n in Counter(text).values())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By the at-signs: what stands left of one as far as the last match, then the host."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _DOMAIN.match(text, at + 1)):
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """By the starts: the end that the country's registered length gives, then the last possible one."""
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() < free:
            continue
        stop = _BODY.match(text, m.end()).end()
        ends, n = {}, 4
        for at in range(m.end(), stop):
            n += text[at] != " "
            if text[at] != " " and 15 <= n <= 34 and not (text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isalnum()):
                ends[n] = at + 1
        own = ends.get(_LENGTHS.get(text[m.start() : m.start() + 2]))
        for end in (own, max(ends.values(), default=None)):
            if end is not None and mod97(text[m.start() : end]):
                free = end
                yield m.start(), free
                break


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their check, by kind as listed, then by start."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = (x.lstrip("0") or "0" for x in m[0].split("."))
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if _DIGIT.search(m[0]) and any(map(str.isalpha, m[0])) and entropy(m[0]) >= 3:
            yield "secret", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = set(re.findall(r"[a-z]+", f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()))
    score = PRIOR[kind] + 0.15 * any(x in around for x in NEAR[kind]) - 0.15 * any(x in around for x in AGAINST)
    return round(min(1.0, score), 2)


def find_spans(text: str | None, threshold: float = 0.5) -> list[Span]:
    """All spans of a text in code points, end exclusive, by kind as listed and then by start."""
    scored = (Span(k, s, e, _score(text, k, s, e)) for k, s, e in _proposed(text or ""))
    return [x for x in scored if x.kind in BASE or x.score >= threshold]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _detected(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        found = [find_spans(x, threshold) for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array([[x._asdict() for x in spans] for spans in found], SPANS)], ["key", "spans"]
        )


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, spans array<struct<kind, start, end, score>>), a row for each row of ``docs``."""
    return (
        keyed_texts(docs, key, text)
        .mapInArrow(lambda b: _detected(b, threshold), "key long, spans array<struct<kind string, start long, end long, score double>>")
        .withColumnRenamed("key", key)
    )


def redacted(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span, overlapping ones taken together, replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    merged: list[list] = []
    for x in sorted(find_spans(text, threshold), key=lambda x: (x.start, -x.end)):
        if merged and x.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x.end)
        else:
            merged.append([x.start, x.end, x.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text``; a null stays null."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            at = part.schema.get_field_index(text)
            clean = pa.array([redacted(x, threshold) for x in part.column(at).to_pylist()], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), clean)

    return bounded(docs).mapInArrow(mapped, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """The counts and digests of ``detect`` over whole ``documents``."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = {k: F.filter("spans", _is(k)) for k in (*BASE, *ADDED)}
    joined = lambda kinds: F.array_join(
        F.flatten(F.array(*(F.transform(F.array_sort(of[k], _by_start), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])) for k in kinds))), ","
    )
    return found.select(
        "doc_id",
        *(F.size(of[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined((*BASE, *ADDED)).alias("spans"),
        *(F.size(of[k]).cast("long").alias(f"n_{k}") for k in ADDED),
        (F.size("spans") > 0).alias("private"),
        F.array_max(F.transform("spans", lambda x: x["score"])).alias("score"),
    )


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _by_start(a, b):
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)


def base_digest(spans: list[Span]) -> str:
    """What ``op10_pii`` returns as base_sha256, for one text."""
    return hashlib.sha256(",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans if x.kind in BASE).encode()).hexdigest()
