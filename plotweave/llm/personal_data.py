"""Personal data (operator 7): patterns propose spans, checksums confirm them, near words move the score.

Every text is read whole, in one narrow pass without a shuffle, so neither a hot source nor groups of
copies matter. Spans are code points, the end exclusive.

Four base kinds are always reported once their own test holds: e-mail address, IP address (parts up to
255), payment card (Luhn) and phone number (10 to 15 digits). Further kinds are reported if their score,
after checksum and context, reaches the threshold and they overlap no base span. An account number whose
checksum holds is reported beside a base span that it overlaps. Further numbers are confirmed by two digits modulo
11, a key modulo 97 and the Verhoeff scheme. Secrets are keys of known forms, values that are assigned to a name such
as password or token, and long hexadecimal or base-64 runs of high entropy near such a name. If a proposal for one fails, its ends at
earlier spaces are tried, the longest first, as the words behind a number can look like a part of it.

Defined cases: a null or empty text has no spans; rows without an id are scanned like any other;
repeated rows are reported one by one; an empty table gives an empty result; spans of one text come by
start, then by kind in the order of `KINDS`. Searches are linear in the text, also on runs of a million
digits or letters. Only the columns named by the caller are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotweave.session import ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone", "tax_id", "insurance_id", "resident_id", "secret")
THRESHOLD = 0.5
# How many code points before and after a span are searched for context words.
NEAR = 60

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits that was tried from its start
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_TAX = re.compile(r"(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9-])")
_INSURANCE = re.compile(r"(?<![0-9])[1278](?:\x20?[0-9]{2}){3}(?:\x20?[0-9]{3}){2}\x20?[0-9]{2}(?![0-9])")
_RESIDENT = re.compile(r"(?<![0-9-])[2-9][0-9]{3}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9-])")
# The beginnings and lengths of keys that services hand out, and the frame of private keys.
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{60,255}|xox[abprs]-[A-Za-z0-9-]{10,250}"
    r"|sk_live_[A-Za-z0-9]{16,250}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,4096}\.eyJ[A-Za-z0-9_-]{10,4096}\.[A-Za-z0-9_-]{10,4096})(?![A-Za-z0-9])"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
_NAMED = re.compile(
    r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?\x20{0,3}([=:])\x20{0,3}([\"']?)([^\s\"',;]{6,256})"
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,256}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT = re.compile(r"[0-9]")

# Score of a proposal before context, and the words near it that raise the score.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3, "local_phone": 0.3, "tax_id": 0.6, "insurance_id": 0.3, "resident_id": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "id number", "identity"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "tax_id": ("cpf", "tax"),
    "insurance_id": ("nir", "sécu", "secu", "insurance", "social"),
    "resident_id": ("aadhaar", "aadhar", "uid", "resident", "identity"),
    "secret": ("secret", "token", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "credential", "private key"),
}
BONUS = 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Check of account numbers: country and check digits go to the end, letters count from 10."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11(digits: str) -> bool:
    """Two check digits behind nine, each from the weighted sum of those before it; equal digits are no number."""
    if len(set(digits)) == 1:
        return False
    for n in (9, 10):
        rest = sum(int(c) * (n + 1 - k) for k, c in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def _turned(a: int, b: int) -> int:
    """The product in the group of turns and mirrorings of a pentagon, mirrorings counted from 5."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


# Fixed value: the permutation of digits by place.
_PERMUTED = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def verhoeff(digits: str) -> bool:
    state = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c)
        for _ in range(place % 8):
            d = _PERMUTED[d]
        state = _turned(state, d)
    return state == 0


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def _secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """Start, end and what a form adds to the score."""
    for m in _KEY.finditer(text):
        yield m.start(), m.end(), 0.6
    if "=" in text or ":" in text:
        for m in _NAMED.finditer(text):
            value = m[3]
            kinds = sum(any(test(c) for c in value) for test in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in value)
            # a colon may also go before a word of prose, and a value may be a placeholder
            if len(set(value)) > 3 and (m[1] == "=" and (kinds > 1 or m[2]) or kinds > 2 or kinds == 2 and any(c.isdigit() for c in value)):
                yield m.start(3), m.end(3), 0.5
    for m in _RUN.finditer(text):
        run = m[0].rstrip("=")
        digits = sum(c.isdigit() for c in run)
        plain_hex = all(c in "0123456789abcdefABCDEF" for c in run)
        if digits and digits < len(run) and (entropy(run) > 3.0 if plain_hex else entropy(run) > 4.2 and any(map(str.isupper, run)) and any(map(str.islower, run))):
            yield m.start(), m.end(), 0.0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` by their at signs."""
    free = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        head = text[free:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        if domain and local:
            yield at - local, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ip_holds(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _digits(match: str) -> str:
    return "".join(_DIGIT.findall(match))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose checksum holds, from left to right and none inside another."""
    m = _IBAN.search(text)
    while m:
        end, held = m.end(), False
        while end > m.start() and not held:
            packed = text[m.start() : end].replace(" ", "")
            if len(packed) < 15:
                break
            held = len(packed) <= 34 and mod97(packed)
            if held:
                yield m.start(), end
            else:
                end = text.rfind(" ", m.start(), end)
        # behind a proposal that failed, one may start at its next group
        m = _IBAN.search(text, end if held else m.start() + 4)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose own test holds."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if _ip_holds(m[0]):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in _TAX.finditer(text):
        if mod11(_digits(m[0])):
            yield "tax_id", m.start(), m.end()
    for m in _INSURANCE.finditer(text):
        digits = _digits(m[0])
        if 97 - int(digits[:13]) % 97 == int(digits[13:]):
            yield "insurance_id", m.start(), m.end()
    for m in _RESIDENT.finditer(text):
        if verhoeff(_digits(m[0])):
            yield "resident_id", m.start(), m.end()


def spans_of(text: str | None) -> list[Span]:
    """All reported spans of one text."""
    found: list[Span] = []
    taken: list[tuple[int, int]] = []
    for kind, start, end in _proposals(text or ""):
        near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
        score = min(1.0, SCORES[kind] + BONUS * any(w in near for w in CONTEXT[kind]))
        if kind in BASE_KINDS:
            taken.append((start, end))
        elif score < THRESHOLD or kind != "iban" and any(start < b and a < end for a, b in taken):
            continue
        found.append(Span(kind, start, end, round(score, 6)))
    free = 0
    for start, end, form in sorted(_secrets(text or ""), key=lambda x: (x[0], -x[1])):
        near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
        score = min(1.0, SCORES["secret"] + form + BONUS * any(w in near for w in CONTEXT["secret"]))
        if score >= THRESHOLD and start >= free and not any(start < b and a < end for a, b in taken):
            found.append(Span("secret", start, end, round(score, 6)))
            free = end
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_personal_data(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of `docs` and the array `spans` of `(kind, start, end, score)`."""
    ship(docs.sparkSession)
    read = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)], F.col(f"`{text}`").alias("_text"))
    width = len(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[s._asdict() for s in spans_of(t.as_py())] for t in b.column(width)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(spans, _ARROW)], [*columns, "spans"])

    return read.mapInArrow(scan, T.StructType([*[docs.schema[c] for c in columns], T.StructField("spans", SPANS)]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_personal_data(spark, folder: str) -> DataFrame:
    """Spans of all documents, counted and digested."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = find_personal_data(docs, ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
