"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind; ip parts are at most 255, cards pass Luhn with 14 to 19
digits, phones have 10 to 15 digits.  Their prior score already reaches the
threshold, so they always stay.  The method adds

* ``iban``: two letters, two check digits and 11 to 30 more letters or digits,
  confirmed by the mod-97 check;
* ``ssn``: three, two and four digits with hyphens, with possible area, group and
  serial numbers; it needs a context word nearby;
* ``localphone``: a national telephone number without ``+``; it needs a context
  word nearby;
* ``secret``: a run of 20 or more letters, digits, ``_`` and ``-`` with letters and digits
  and at least ``SECRET_BITS`` bits a character; it needs a context word nearby.

Context words are whole words (with or without a plural s) that begin within
``CONTEXT_CHARS`` of the span; for base kinds they raise the score only.  The time is
linear in the text: a run of characters that can't start a match is left at once.

Spans are (kind, start, end, score) in code points, end exclusive.  A null or
empty text has no spans; texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from slotloom.llm.shared import mapped
from slotloom.llm.words import tidy

THRESHOLD = 0.5
CONTEXT_CHARS = 40
SECRET_BITS = 2.8
#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "localphone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PATTERNS = {
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "localphone": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
}
#: Score before context, and the words nearby that raise it.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "localphone": 0.3, "secret": 0.3}
_CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("address", "host", "server"), "card": ("card", "visa", "payment", "credit"), "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "key", "credential"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social security"), "localphone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
}
_LONGEST = max(len(w) for words in _CONTEXT.values() for w in words) + 2
_NEARBY = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, words)) + r")s?(?![^\W\d_])", re.I) for k, words in _CONTEXT.items()}
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LETTER = re.compile(r"[A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: the first four characters go last, letters count 10 to 35."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(text: str) -> float:
    """Bits a character."""
    return sum(-n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == "card":
        digits = _NOT_DIGIT.sub("", found) if len(found) <= 37 else ""
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_NOT_DIGIT.sub("", found)) <= 15
    if kind == "iban":
        return mod97(found)
    if kind == "secret":
        return bool(_DIGIT.search(found) and _LETTER.search(found)) and _entropy(found) >= SECRET_BITS
    if kind == "ssn":
        area, group, serial = found.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern finds them: of the characters before an @ the first run decides, at the earliest place."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each of every dotted chain, from its left."""
    for m in _DOTTED.finditer(text):
        if (parts := m[0].count(".") + 1) < 4:
            continue
        at = m.start()
        numbers = m[0].split(".")
        for k in range(0, parts - 3, 4):
            size = sum(map(len, numbers[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def _candidates(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return _emails(text)
    return _ips(text) if kind == "ip" else (m.span() for m in _PATTERNS[kind].finditer(text))


def _near(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a context word stands before or after the span."""
    if _NEARBY[kind].search(text, max(0, a - CONTEXT_CHARS), a):
        return True
    after = _NEARBY[kind].search(text, b, b + CONTEXT_CHARS + _LONGEST)
    return after is not None and after.start() < b + CONTEXT_CHARS


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans that reach the threshold, by start, then kind."""
    if not text:
        return []
    kinds = []
    if "@" in text:
        kinds.append("email")
    if _DIGIT.search(text):
        kinds += KINDS[1:] if "+" in text else [k for k in KINDS[1:] if k != "phone"]
    spans = []
    for kind in kinds:
        for a, b in _candidates(kind, text):
            if _valid(kind, text[a:b]):
                score = min(1.0, _PRIOR[kind] + 0.3 * _near(kind, text, a, b))
                if score >= THRESHOLD:
                    spans.append((kind, a, b, score))
    # A domestic number inside a base span is that span.
    starts, ends = [], []
    for a, b in sorted((a, b) for k, a, b, _ in spans if k in BASE_KINDS):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)

    def inside(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and ends[k - 1] > a

    spans = [s for s in spans if s[0] not in ("ssn", "localphone") or not inside(s[1], s[2])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"
_SPAN_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and its spans with scores and values."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": s, "value": t[a:b]} for k, a, b, s in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_KIND)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one."""

    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        out, last = [], 0
        for kind, a, b, _ in find(text):
            if a >= last:
                out += [text[last:a], f"<{kind}>"]
            last = max(last, b)
        return text if not out else "".join([*out, text[last:]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return mapped(docs, run, docs.columns)


def _digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans."""
    from pyspark.sql import functions as F

    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    return personal_data(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return _digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
