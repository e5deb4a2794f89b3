"""Personal data in texts: patterns propose spans, checksums confirm them and
context words adjust the score.

The base kinds (email, ip, card, phone) are those of the patterns below, kept
whenever their check holds. Further kinds are proposed by a pattern and kept
when their score reaches ``THRESHOLD``: an IBAN whose digits leave 1 modulo 97,
a US social security number, and a national telephone number. The last two
have no checksum and need a context word close before them.

Defined results: a null or empty text has no spans; a match that fails its
check is dropped and not tried again; spans count code points, the end is
exclusive. Columns of the documents may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.rows import with_columns

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
THRESHOLD = 0.6
#: Characters before a span in which context words count.
CONTEXT = 40
#: Words that support a kind.
WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}
#: Score of a span by its pattern alone, what its checksum adds, and a context word.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "tel": 0.3}
CHECKED, NEARBY = 0.4, 0.35

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its first digit fails from every later one, so the search starts at runs only.
IP = re.compile(r"(?<![0-9])(?>[0-9]+)\.(?>[0-9]+)\.(?>[0-9]+)\.(?>[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9])")
DIGIT = re.compile(r"[0-9]")

SCHEMA = "spans array<struct<start:int,end:int,kind:string,score:double>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each @
    with the longest local part before it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        elif start < at:
            done = max(done, at)  # what precedes this @ can't belong to a later one
        at = max(at + 1, done)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end and whether a checksum confirmed the span."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, False
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span(), False
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", *m.span(), True
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span(), False
    for m in TEL.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 13:
            yield "tel", *m.span(), False


def find(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind; further kinds yield to base spans that they touch."""
    found = []
    for kind, a, b, checked in proposals(text or ""):
        before = text[max(0, a - CONTEXT) : a].lower()
        near = any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", before) for w in WORDS[kind]) if kind != "email" else "mail" in before
        score = min(1.0, BASE_SCORE[kind] + CHECKED * checked + NEARBY * near)
        if kind in KINDS[:4] or score >= THRESHOLD:
            found.append({"start": a, "end": b, "kind": kind, "score": round(score, 3)})
    base = [x for x in found if x["kind"] in KINDS[:4]]
    if len(base) < len(found):
        found = base + [x for x in found if x["kind"] not in KINDS[:4] and not any(x["start"] < y["end"] and y["start"] < x["end"] for y in base)]
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def find_pii(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document: its columns as the struct ``row`` and its ``spans``."""
    text = F.col(text) if isinstance(text, str) else text
    return with_columns(docs, text, lambda: lambda texts: {"spans": list(map(find, texts))}, SCHEMA, keep)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; a span that
    begins inside an earlier one is covered by that one's mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"),
                x["end"].alias("at"),
            )
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def pii_digest(docs: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs, keep=("doc_id",)).select(
        "row.doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
