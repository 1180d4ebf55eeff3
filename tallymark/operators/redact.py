"""Redaction and replay: where exact spans in the original text are needed, small Arrow UDFs over the same patterns."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect, rulesets
from .offsets import Reading, merged, replaced, touches
from ..functions.numbers import ISSUER_PREFIXES, ISSUER_RANGES


def compiled(java: str) -> re.Pattern:
    """The same pattern in Python, whose classes are Unicode anyway."""
    flags = re.IGNORECASE if java.startswith("(?iU)") else 0
    return re.compile(re.sub(r"^\(\?i?U\)", "", java).replace(r"\z", r"\Z"), flags)


EMAIL, SSN, PHONE, IPV4, CARD = map(compiled, (detect.EMAIL, detect.SSN, detect.PHONE, detect.IPV4, detect.CARD))
INJECTIONS = {k: compiled(v) for k, v in detect.INJECTIONS.items()}
SECRETS = {k: compiled(v) for k, v in detect.SECRETS.items()}
MARKER_NAMES = {"injection.jailbreak": "prompt_injection"}  # whose own name would fire again: fixed value


def marker(rule: str) -> str:
    return f"[REDACTED:{MARKER_NAMES.get(rule, rule.split('.', 1)[1])}]"


def luhn(digits: str) -> bool:
    worth = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(w - 9 * (w > 9) for w in worth) % 10 == 0


def is_card(digits: str) -> bool:
    issued = digits.startswith(ISSUER_PREFIXES) or any(lo <= int(digits[: len(str(lo))]) <= hi for lo, hi in ISSUER_RANGES)
    return len(set(digits)) > 1 and issued and luhn(digits)


DIGIT = re.compile(r"\d")


def gated(pattern: re.Pattern, label: str, gate: Callable[[str], bool], text: str) -> str:
    return pattern.sub(lambda m: f"[REDACTED:{label}]" if gate(re.sub(r"\D", "", m[0])) else m[0], text)


def redact_pii(text: str) -> str:
    """Cards first, then social security numbers, phones, e-mails and addresses; the gates of detection hold here too."""
    if DIGIT.search(text):
        text = gated(CARD, "credit_card", is_card, text)
        text = SSN.sub("[REDACTED:ssn]", text) if "-" in text else text
        text = gated(PHONE, "phone", lambda d: set(d) != {"0"}, text)
    if "@" in text:
        text = EMAIL.sub("[REDACTED:email]", text)
    return IPV4.sub("[REDACTED:ip_address]", text) if "." in text and DIGIT.search(text) else text


WIDTHLESS = re.compile("[" + "".join(map(chr, detect.ZERO_WIDTH)) + "]+")
ONE = r"[^\W_]"
LONE, ALONE = rf"(?<!{ONE}){ONE}", rf"{ONE}(?!{ONE})"
#: The same separators between single characters as in ``detect.SPACED``.
SPACED = re.compile(rf"{detect.SEPARATORS}(?:(?<={LONE}{detect.SEPARATORS})(?={ALONE}{detect.SEPARATORS}{ALONE})|(?<={LONE}{detect.SEPARATORS}{ONE}{detect.SEPARATORS})(?={ALONE}))")


def normalised(text: str) -> Reading:
    """The reading without characters of no width and without the separators of spaced out words."""
    return Reading("normalised", text).without(WIDTHLESS).without(SPACED)


def decoded(text: str) -> list[Reading]:
    """Decoded base64 runs; each stands for the whole run."""
    out = []
    for m in re.finditer(detect.BASE64_RUN, text):
        try:
            plain = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4), validate=True).decode()
        except ValueError:
            continue
        shown = sum(c.isprintable() or c.isspace() for c in plain)
        if plain and shown / len(plain) >= detect.PRINTABLE_SHARE and any(map(str.isspace, plain)):
            out.append(Reading("decoded", plain, whole=m.span()))
    return out


def possible(text: str, rules: dict[str, re.Pattern]) -> dict[str, re.Pattern]:
    """The rules, of any version, one of whose stems the text holds."""
    mask = detect.stem_mask(text)
    return {rule: p for rule, p in rules.items() if detect.BIT[rule] & mask}


def hits(text: str, rules: dict[str, re.Pattern]) -> list[tuple[str, str, int, int]]:
    """(view, rule, start, end) of all matches, in places of the original text; the raw reading first."""
    others = [r for r in (normalised(text), *decoded(text)) if r.text and r.text != text]
    return [(r.name, rule, *r.span(*m.span())) for r in (Reading("raw", text), *others) for rule, p in possible(r.text, rules).items() for m in p.finditer(r.text) if m.end() > m.start()]


def redact_text(text: str, tag: str | None) -> str:
    """What only another reading shows goes first; then each rule in turn. A text with few readings costs little more than itself."""
    found = hits(text, INJECTIONS)
    raw = merged([(a, b) for view, _, a, b in found if view == "raw"])
    derived = sorted({(a, -b, rule) for view, rule, a, b in found if view != "raw" and not touches(raw, a, b)})
    spans: list[tuple[int, int, str]] = []
    for a, minus_b, rule in derived:
        if not spans or a >= spans[-1][1]:
            spans.append((a, -minus_b, marker(rule)))
    text = replaced(text, spans)
    folded = (tag or "").strip().lower()
    if folded.removesuffix("_basic") in detect.PERSONAL:
        text = redact_pii(text)
    for rule, p in possible(text, INJECTIONS | SECRETS).items():  # a marker holds no match of a rule
        text = p.sub(marker(rule), text)
    return text


#: Texts should come to the functions below in Arrow batches of so many bytes: a Python worker holds a few batches and what is made of
#: them, and Spark's own limit of 64 MB or 10 000 rows is a limit for one worker, not for all that an executor has cores for.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
SLICE = 256  # rows that are Python objects at a time: of the others an Arrow batch holds the bytes only


def by_slices(one: Callable[..., object], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row, null where its first column is, a slice of rows after the other."""
    rows = lambda k: zip(*(c.slice(k, SLICE).to_pylist() for c in columns), strict=True)
    parts = [pa.array([None if row[0] is None else one(*row) for row in rows(k)], kind) for k in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def pii_redacted(text: pa.Array) -> pa.Array:
    return by_slices(redact_pii, pa.string(), text)


@F.arrow_udf(T.StringType())
def redacted(text: pa.Array, tag: pa.Array) -> pa.Array:
    return by_slices(redact_text, pa.string(), text, tag)


def _walk(value: object, tag: str | None) -> object:
    if isinstance(value, str):
        return redact_text(value, tag)
    if isinstance(value, dict):
        return {k: _walk(v, tag) for k, v in value.items()}
    return [_walk(v, tag) for v in value] if isinstance(value, list) else value


@F.arrow_udf(T.StringType())
def redacted_document(document: pa.Array, tag: pa.Array) -> pa.Array:
    """A JSON document of the same shape with every string leaf redacted."""
    return by_slices(lambda d, t: json.dumps(_walk(json.loads(d), t), ensure_ascii=False), pa.string(), document, tag)


def without_markers(text: Column) -> Column:
    """Markers made inert, so that no rule fires on the trace of its own redaction."""
    return F.regexp_replace(text, r"\[REDACTED:[a-z_]+\]", " ~ ")


def surviving_rules(rules: Column, redacted_prompt: Column, tag: Column) -> Column:
    """Rules that fired on the prompt and still fire on what is left of it."""
    return F.array_sort(F.array_intersect(rules, detect.prompt_rules(without_markers(redacted_prompt), tag)))


CHECKS = {
    "luhn": luhn,
    "luhn+distinct": lambda d: len(set(d)) > 1 and luhn(d),
    "luhn+iin+distinct": is_card,
    "not-all-zero": lambda d: set(d) != {"0"},
}
MATCHES = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Ruleset:
    """The compiled patterns and checks of one published version."""

    def __init__(self, version: str):
        self.injections, self.secrets, self.personal = ({k: compiled(p) for k, p in rulesets.at(t, version).items()} for t in (rulesets.INJECTIONS, rulesets.SECRETS, rulesets.PERSONAL))
        self.checks = {k: CHECKS[c] for k, c in rulesets.at(rulesets.CHECKS, version).items()}
        self.views = version >= rulesets.VIEWS_SINCE

    def matches(self, text: str, tag: str | None) -> list[tuple[str, int, int]]:
        """(rule, start, end) of all that fires under a tag, in places of the text; what two readings show alike is one match."""
        found = {(rule, a, b) for view, rule, a, b in hits(text, self.injections) if self.views or view == "raw"}
        found |= {(rule, *m.span()) for rule, p in possible(text, self.secrets).items() for m in p.finditer(text)}
        prefix = detect.PERSONAL.get((tag or "").strip().lower().removesuffix("_basic"))
        if prefix:
            passes = lambda label, m: label not in self.checks or self.checks[label](re.sub(r"\D", "", m[0]))
            found |= {(f"{prefix}.{label}", *m.span()) for label, p in self.personal.items() for m in p.finditer(text) if passes(label, m)}
        return sorted(found, key=lambda m: (m[1], m[0], m[2]))


RULESETS = {v: Ruleset(v) for v in rulesets.VERSIONS}


@F.arrow_udf(MATCHES)
def replayed(text: pa.Array, version: pa.Array, tag: pa.Array) -> pa.Array:
    """All matches of a text under the ruleset version and the tag that its row names, with spans; null for an unknown version."""

    def one(t: str, v: str | None, g: str | None) -> list[dict] | None:
        own = RULESETS.get(v)
        return None if own is None else [dict(zip(("rule", "start", "end"), m, strict=True)) for m in own.matches(t, g)]

    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return by_slices(one, kind, text, version, tag)


def explained(rows: DataFrame, known: DataFrame, commitment: Column) -> DataFrame:
    """Each row asked about, what is known of it, and a named outcome: the checks in the order in which they can fail."""
    both = rows.join(known, "event_id", "left")
    outcome = (
        F.when(F.col("prompt").isNull(), "content_unknown")
        .when(F.col("prompt_hash").isNull(), "no_commitment")
        .when(commitment != F.col("prompt_hash"), "content_mismatch")
        .when(~F.col("ruleset_version").isin(*RULESETS), "unknown_ruleset")
        .otherwise("explained")
    )
    out = both.withColumn("outcome", outcome)
    return out.withColumn("matches", F.when(F.col("outcome") == "explained", replayed(F.col("prompt"), F.col("ruleset_version"), F.col("policy_tag"))))


def ruleset_digest() -> str:
    """One digest over the latest patterns and tables: it moves when any rule does."""
    import hashlib

    tables = (rulesets.INJECTIONS, rulesets.SECRETS, rulesets.PERSONAL, rulesets.RESPONSES, rulesets.CHECKS)
    definition = [*map(rulesets.at, tables), sorted(ISSUER_PREFIXES), sorted(ISSUER_RANGES), sorted(detect.ZERO_WIDTH)]
    return hashlib.sha256(json.dumps(definition, sort_keys=True).encode()).hexdigest()


#: The digest of the latest published version.
FROZEN_DIGEST = "b68b162ce53c10add77b54593be9fb6a5bb3bfe1d8648f85402e1394331d523a"


def drifted_from(digest: Column) -> Column:
    """Whether rows name another ruleset than the one in force."""
    return ~digest.eqNullSafe(F.lit(ruleset_digest()))


def drifted(frozen: str) -> bool:
    return ruleset_digest() != frozen
