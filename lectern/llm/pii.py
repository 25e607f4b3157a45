"""Personal data in whole texts: patterns propose, checksums confirm, nearby words move the score.

Offsets are code points, ends exclusive. Every pattern is scanned in linear time: runs are taken whole (possessive
quantifiers, look-behind at run starts), so one very long word, number or line costs no more than its length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans that begin together are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")

SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"

# What each kind is worth before its context, and words that speak for or against it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9, "national_id": 0.3}
SUPPORT = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "pay"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "number"},
    "iban": {"iban", "bank", "account", "transfer"},
    "national_id": {"ssn", "social", "security", "id", "identity", "passport", "tax"},
}
AGAINST = {"example", "sample", "version", "isbn", "order", "invoice", "test"}
#: Spans of other than the base kinds are returned from this score on.
THRESHOLD = 0.5
#: Characters on each side in which context words count.
CONTEXT = 48

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        if at < done:
            continue
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            yield begin, m.end()
            done = m.end()


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str):
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def _nationals(text: str):
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones, _ibans, _nationals)


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = _WORD.findall(text[max(0, start - CONTEXT) : start].lower()) + _WORD.findall(text[end : end + CONTEXT].lower())
    score = PRIOR[kind] + 0.25 * bool(SUPPORT[kind].intersection(near)) - 0.25 * bool(AGAINST.intersection(near))
    return min(1.0, max(0.0, score))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind as listed. Base kinds always, others from ``THRESHOLD`` on."""
    found = []
    if text:
        for n, (kind, finder) in enumerate(zip(KINDS, _FINDERS, strict=True)):
            for start, end in finder(text):
                score = _score(text, kind, start, end)
                if n < 4 or score >= THRESHOLD:
                    found.append((start, n, kind, end, score))
    return [(kind, start, end, score) for start, _, kind, end, score in sorted(found)]


def _span_array(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    return pa.array(([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t.as_py())] for t in texts), pa.list_(kind))


def _masked(texts: pa.Array) -> pa.Array:
    def one(t: str | None) -> str | None:
        parts, done = [], 0
        for kind, start, end, _ in spans_of(t):
            if start >= done:
                parts += [t[done:start], f"<{kind}>"]
                done = end
        return t if not parts else "".join([*parts, t[done:]])

    return pa.array((one(t.as_py()) for t in texts), pa.string())


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out`` of spans (kind, start, end, score).

    Null and empty texts have no spans. Rows are independent: repeated rows get equal spans, an empty table stays
    empty, other columns pass unchanged; a column already named ``out`` is replaced. A text of any length is taken
    whole; its patterns take linear time.
    """
    return docs.withColumn(out, F.arrow_udf(_span_array, SPAN_TYPE)(F.col(text)))


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; of overlapping spans the first counts.

    Null texts stay null and texts without spans as they are; all rows stay, repeated ones too, an empty table stays
    empty, other columns pass unchanged whatever their names.
    """
    return docs.withColumn(text, F.arrow_udf(_masked, "string")(F.col(text)))
