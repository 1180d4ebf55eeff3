"""Personal data: patterns propose spans, validators confirm them, words nearby move their scores.

The base kinds (email, ip, card, phone) are kept whenever their validator holds, whatever their score. The added kinds
(iban, ssn, routing) are kept from a score on: an account number confirmed by mod-97 is enough by itself, numbers
that plain chance often confirms need a word nearby that says what they are.

Every pattern is written so that a failed start costs a bounded number of steps, or only as many as it then skips:
texts of one endless run of digits, letters or separators take linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing")
KINDS = BASE + ADDED
WINDOW = 48  # code points on either side of a span in which context words count
THRESHOLD = 0.6
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())])
RESULT = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,value:string>>"

#: Lengths of international account numbers by country. Fixed values of the public registry.
IBAN_LENGTHS = dict(
    pair.split(":")
    for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 "
        "FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 "
        "LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 "
        "SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)


class Context(NamedTuple):
    """A kind's score without context, words that raise it and words that lower it."""

    prior: float
    raising: re.Pattern
    lowering: re.Pattern


def words(*stems: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(stems) + r")", re.IGNORECASE)


NUMBERING = ("order", "invoice", "ticket", "serial", "version", "build", "part no", "sku", "tracking")
CONTEXT = {
    "email": Context(0.9, words("e-?mail", "contact", "mailto", "write to"), words("example of", "noreply")),
    "ip": Context(0.6, words("ip\\b", "address", "host", "client", "login"), words("version", "release", "build", "section")),
    "card": Context(0.7, words("card", "visa", "master", "amex", "credit", "debit", "payment", "cvv"), words(*NUMBERING)),
    "phone": Context(0.7, words("phone", "tel\\b", "call", "mobile", "fax", "cell", "whatsapp"), words(*NUMBERING)),
    "iban": Context(0.75, words("iban", "account", "bank", "konto", "compte", "cuenta", "bic\\b", "swift"), words(*NUMBERING)),
    "ssn": Context(0.35, words("ssn\\b", "social security", "tax id", "taxpayer"), words(*NUMBERING)),
    "routing": Context(0.3, words("routing", "aba\\b", "rtn\\b", "bank"), words(*NUMBERING)),
}
RAISE, LOWER = 0.35, 0.2


def score(kind: str, text: str, start: int, end: int, window: int = WINDOW) -> float:
    """A kind's prior, moved by the words within ``window`` code points before and after the span."""
    c = CONTEXT[kind]
    near = text[max(0, start - window) : start], text[end : end + window]
    moved = c.prior + RAISE * any(c.raising.search(x) for x in near) - LOWER * any(c.lowering.search(x) for x in near)
    return round(min(1.0, max(0.0, moved)), 2)


# ---- validators ----------------------------------------------------------------------------


def digits_of(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def luhn(digits: str) -> bool:
    """The sum of the digits, every second one from the right doubled and cast out, is a multiple of ten."""
    doubled = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])) % 10 == 0


def mod97(value: str) -> bool:
    """Country and check digits go to the end, letters become 10 to 35, and the number leaves 1 modulo 97."""
    compact = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def routing_ok(digits: str) -> bool:
    """Weights 3, 7, 1, and a first pair that is in use."""
    return sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0 and (1 <= int(digits[:2]) <= 12 or 21 <= int(digits[:2]) <= 32)


# ---- proposers: (start, end) of every confirmed span ------------------------------------------

# A leftmost match ends its local part at an "@", and what follows the "@" does not depend on where it began.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Behind the first digit: no digit stands before it, as a start inside a run fails wherever the run's start does.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
# The proposal always takes a whole chain of digits with single separators, so a chain of another length is none.
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9](?<![0-9A-Za-z-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_ROUTING = re.compile(r"[0-9](?<![0-9A-Za-z.-][0-9])[0-9]{8}(?![0-9A-Za-z-])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        at, size = m.start(), 64
        while True:  # the local part, looked for in growing pieces before the "@"
            low = max(done, at - size)
            tail = text[low:at]
            gaps = [g.end() for g in _NOT_LOCAL.finditer(tail)]
            if gaps or low == done:
                start = low + (gaps[-1] if gaps else 0)
                break
            size *= 4
        if start < at:
            done = m.end()
            yield start, done


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CARD.finditer(text) if luhn(digits_of(m[0])))


def phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        need, end = int(IBAN_LENGTHS.get(m[0][:2], 0)), m.start()
        if not need:
            continue
        for c in m[0]:  # as many characters as the country's numbers have, spaces apart
            end += 1
            need -= c != " "
            if not need:
                break
        if not need and not re.match(r"[A-Za-z0-9]", text[end : end + 1]) and mod97(text[m.start() : end]):
            yield m.start(), end


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def routings(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _ROUTING.finditer(text) if routing_ok(m[0]))


PROPOSERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns, routings), strict=True))
_SOME_DIGITS = re.compile(r"[0-9][0-9.\x20-]{6}")  # seven characters of digits and separators: the shortest ip, and any card, ssn or routing number, hold them
_NEEDS = {"email": lambda t, d: "@" in t, "phone": lambda t, d: "+" in t, "iban": lambda t, d: True}


def find_spans(text: str, kinds: tuple[str, ...] = KINDS, threshold: float = THRESHOLD, window: int = WINDOW) -> list[dict]:
    """Spans by kind, in the order of ``KINDS``, then start. Added spans inside a base span are not reported again."""
    out: list[dict] = []
    taken: list[list[tuple[int, int]]] = []  # a base kind's spans, which do not overlap
    digits = bool(_SOME_DIGITS.search(text))

    def inside(start: int, end: int) -> bool:
        at = [(have, bisect_right(have, (start, len(text))) - 1) for have in taken]
        return any(k >= 0 and have[k][1] >= end for have, k in at)

    for kind in KINDS:
        if kind not in kinds or not _NEEDS.get(kind, lambda t, d: d)(text, digits):
            continue
        found = list(PROPOSERS[kind](text))
        if kind in BASE:
            taken.append(found)
        for start, end in found:
            s = score(kind, text, start, end, window)
            if kind in BASE or (s >= threshold and not inside(start, end)):
                out.append({"kind": kind, "start": start, "end": end, "score": s, "value": text[start:end]})
    return out


def find_personal(docs: DataFrame, kinds: tuple[str, ...] = KINDS, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, spans (kind, start, end, score, value), by kind as listed in ``KINDS`` and then start.

    Offsets are code points, ends exclusive. Whole texts; null counts as empty and gives no spans. Within a kind spans
    do not overlap; spans of different kinds may. Repeated rows give repeated results and columns other than doc_id and
    text are not read. There is no shuffle: memory is an Arrow batch and the longest text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in text_slices(batch.column(1)):
                found = [find_spans(t or "", kinds, threshold, window) for t in batch.column(1).slice(first, end - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, RESULT)
