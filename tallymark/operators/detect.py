"""Detection of personal data, secrets, injections and unsafe responses, as column expressions over the latest ruleset."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rulesets
from ..functions.nested import resolved_tag
from ..functions.numbers import issued, luhn_ok, uniform

INJECTIONS, SECRETS, RESPONSES = map(rulesets.at, (rulesets.INJECTIONS, rulesets.SECRETS, rulesets.RESPONSES))
PERSONAL_PATTERNS = rulesets.at(rulesets.PERSONAL)
EMAIL, SSN, PHONE, IPV4, CARD = (PERSONAL_PATTERNS[k] for k in ("email", "ssn_pattern", "phone", "ip_address", "credit_card"))
#: A text in which a rule fires holds one of these in lower case: they say which of the large patterns need to run.
STEMS = {
    "injection.ignore_previous": ("ignor", "skip", "omit", "overlook", "neglect", "attention", "notice", "aside", "follow"),
    "injection.override_instructions": ("disregard", "forget", "override", "bypass", "circumvent", "discard", "suspend", "off"),
    "injection.reveal_system_prompt": ("prompt", "message", "instruction"),
    "injection.jailbreak": ("anything", "jailbreak", "mode"),
    "injection.dan": ("dan",),
    "injection.multilingual_override": ("précédent", "precedent", "antérieur", "anterieur", "anterior", "previas", "prévias", "vorherigen", "vorigen", "bisherigen", "obigen", "vorige", "eerdere", "voorgaande", "предыдущие", "忽略", "無視"),  # rarer than its nouns and verbs
    "secret.openai_key": ("sk-",),
    "secret.aws_access_key": ("akia",),
    "secret.private_key": ("private key",),
    "secret.bearer_token": ("bearer",),
    "response_markup.script_tag": ("script",),
    "response_markup.iframe": ("iframe",),
    "response_markup.event_handler": ("<",),
    "response_markup.javascript_uri": ("javascript",),
    "response_markup.data_html_uri": ("data:",),
    "response_sql.destructive": ("drop", "truncate", "delete", "alter"),
    "response_sql.tautology": ("=",),
    "response_sql.stacked_statement": (";",),
    "response_url.private_host": ("http",),
    "response_url.file_scheme": ("file://",),
    "response_secret.openai_key": ("sk-",),
    "response_secret.aws_access_key": ("akia",),
    "response_secret.private_key": ("private key",),
    "response_secret.bearer_token": ("bearer",),
}
BIT = {rule: 1 << k for k, rule in enumerate(STEMS)}
ALL_BITS = (1 << len(STEMS)) - 1
ODD_LETTERS = "ſıİ"  # whose lower case is not the letter that they match where case is ignored
# Labels and the transformations of a text's other readings.
SIGNALS = {"injection": "prompt_injection", "secret": "secret_key", "response_secret": "secret_key", "response_markup": "unsafe_markup", "response_sql": "unsafe_sql", "response_url": "unsafe_url"}
REASONS = (
    ("secret", "secret_key"), ("response_secret", "secret_key"), ("injection", "prompt_injection"), ("response_markup", "unsafe_markup"),
    ("response_sql", "unsafe_sql"), ("response_url", "unsafe_url"), ("phi", "phi"), ("response_phi", "phi"), ("pii", "pii"),
    ("response_pii", "pii"), ("response_scan", "scan_coverage"),
)
PERSONAL = {"hipaa": "phi", "gdpr": "pii"}
ZERO_WIDTH = (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
SEPARATORS = r"[ \t.\-_]"
BASE64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
PRINTABLE_SHARE = 0.9


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, r"(?U)\D", "")


def has_phone(text: Column) -> Column:
    """Some phone shape that is not all zeros."""
    return F.exists(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda m: F.regexp_replace(digits_of(m), "0", "") != "")


def is_card(digits: Column) -> Column:
    return ~uniform(digits) & issued(digits) & luhn_ok(digits)


def has_card(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda m: is_card(digits_of(m)))


def labels(cases: dict[str, Column]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()])))


def detect_pii(text: Column) -> Column:
    """Labels of all personal data; a pattern runs only where a character stands that each of its matches holds."""

    def of(t: Column) -> Column:
        return labels({
            "email": F.contains(t, F.lit("@")) & t.rlike(EMAIL), "ssn_pattern": F.contains(t, F.lit("-")) & t.rlike(SSN), "phone": t.rlike(r"(?U)\d{3}") & has_phone(t),
            "ip_address": F.contains(t, F.lit(".")) & t.rlike(IPV4), "credit_card": t.rlike("[1-9]") & has_card(t),
        })

    return computed(text, of)


@cache
def automaton() -> object:
    """All stems in one automaton, each with the bits of its rules; without the library, the stems one by one."""
    bits: dict[str, int] = {}
    for rule, stems in STEMS.items():
        for stem in stems:
            bits[stem] = bits.get(stem, 0) | BIT[rule]
    try:
        import ahocorasick
    except ImportError:
        return bits
    out = ahocorasick.Automaton()
    for stem, mask in bits.items():
        out.add_word(stem, mask)
    out.make_automaton()
    return out


def stem_mask(text: str) -> int:
    """The rules one of whose stems the text holds: one pass whatever their number."""
    if any(c in text for c in ODD_LETTERS):
        return ALL_BITS
    lower, tree, mask = text.lower(), automaton(), 0
    if isinstance(tree, dict):
        return reduce(or_, [m for stem, m in tree.items() if stem in lower], 0)
    for _, m in tree.iter(lower):
        mask |= m
    return mask


def computed(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once for each row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fired_by_mask(text: Column, mask: Column, rules: dict[str, str]) -> Column:
    """Sorted names of the rules whose pattern occurs, of those that the text's stems allow."""
    return labels({r: (mask.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0) & text.rlike(p) for r, p in rules.items()})


def fired_in(readings: Column, rules: dict[str, str]) -> Column:
    """Sorted names of the rules whose pattern occurs in one of the readings; a pattern runs only where one of its stems stands."""

    def one(c: Column) -> Column:
        may = lambda r: reduce(or_, [F.contains(c["lower"], F.lit(stem)) for stem in STEMS[r]], c["odd"])
        return labels({r: may(r) & c["reading"].rlike(p) for r, p in rules.items()})

    odd = lambda r: reduce(or_, [F.contains(r, F.lit(letter)) for letter in ODD_LETTERS])
    lowered = F.transform(readings, lambda r: F.struct(r.alias("reading"), F.lower(r).alias("lower"), odd(r).alias("odd")))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(lowered, one)))), F.array().cast("array<string>"))


def fired(text: Column, rules: dict[str, str]) -> Column:
    """Sorted names of the rules whose pattern occurs."""
    return fired_in(F.array(text), rules)


def visible(text: Column) -> Column:
    """Without characters that have no width."""
    some = reduce(or_, [F.contains(text, F.lit(chr(c))) for c in ZERO_WIDTH])
    return F.when(some, F.translate(text, "".join(map(chr, ZERO_WIDTH)), "")).otherwise(text)


ONE = r"[\p{L}\p{N}]"
LONE = rf"(?<!{ONE}){ONE}"  # a letter or digit with none before it
ALONE = rf"{ONE}(?!{ONE})"  # a letter or digit with none behind it
#: A separator between the first and second, or the second and third, of three single characters; what precedes is looked at last.
SPACED = rf"{SEPARATORS}(?:(?<={LONE}{SEPARATORS})(?={ALONE}{SEPARATORS}{ALONE})|(?<={LONE}{SEPARATORS}{ONE}{SEPARATORS})(?={ALONE}))"


def joined_letters(text: Column) -> Column:
    """Runs of three or more single characters with one separator between each, without the separators."""
    return F.regexp_replace(text, SPACED, "")


def decoded_runs(text: Column) -> Column:
    """Each base64 run that holds a sentence, decoded: valid UTF-8, printable for the most part, with white space. One text a run."""

    def plain(run: Column) -> Column:
        padded = F.concat(run, F.repeat(F.lit("="), F.pmod(-F.length(run), F.lit(4))))
        return F.try_to_binary(padded, F.lit("base64"))

    texts = F.transform(F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0)), lambda r: F.try_validate_utf8(plain(r).cast("string")))
    odd = lambda t: F.length(t) - F.length(F.regexp_replace(t, r"[\p{C}&&[^\t\n\x0B\f\r\x1C-\x1F\x85]]", ""))
    return F.filter(F.array_compact(texts), lambda t: (t != "") & (odd(t) <= (1 - PRINTABLE_SHARE) * F.length(t)) & t.rlike(r"(?U)\s"))


def views(text: Column) -> Column:
    """The readings of a text: as it is, normalised, and each decoded run; the empty and the repeated left out."""
    def own(t: Column) -> Column:
        others = F.concat(F.array(joined_letters(visible(t))), decoded_runs(t))
        return F.concat(F.array(t), F.filter(others, lambda v: (v != "") & (v != t)))

    return computed(text, own)


def injections(text: Column) -> Column:
    """Injection rules that fire on any reading."""
    return fired_in(views(text), INJECTIONS)


def prompt_rules(text: Column, tag: Column) -> Column:
    """All rules a prompt fires under a tag: injections and secrets always, personal data where the tag asks for it."""
    own = resolved_tag(tag)
    prefix = F.when(own == "hipaa", "phi").when(own == "gdpr", "pii")

    def of(t: Column) -> Column:
        personal = F.when(prefix.isNotNull(), F.transform(detect_pii(t), lambda x: F.concat(prefix, F.lit("."), x))).otherwise(F.array().cast("array<string>"))
        return F.array_sort(F.array_distinct(F.concat(injections(t), fired(t, SECRETS), personal)))

    return computed(text, of)


def response_rules(text: Column, tag: Column | None = None) -> Column:
    base = fired(text, RESPONSES)
    if tag is None:
        return base
    own = resolved_tag(tag)
    prefix = F.when(own == "hipaa", "response_phi").when(own == "gdpr", "response_pii")
    personal = F.when(prefix.isNotNull(), F.transform(detect_pii(text), lambda x: F.concat(prefix, F.lit("."), x))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(base, personal)))


def signals_of(rules: Column) -> Column:
    """Coarse labels: personal rules stand for what they found, the others for their family."""

    def one(r: Column) -> Column:
        family = F.substring_index(r, ".", 1)
        out = F.substring_index(r, ".", -1)
        for name, signal in SIGNALS.items():
            out = F.when(family == name, F.lit(signal)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.transform(rules, one)))


def reason_of(rules: Column) -> Column:
    """The label of the weightiest family that fired."""
    families = F.transform(rules, lambda r: F.substring_index(r, ".", 1))
    out = F.lit("none")
    for family, label in reversed(REASONS):
        out = F.when(F.array_contains(families, family), F.lit(label)).otherwise(out)
    return out


def action_of(rules: Column) -> Column:
    return F.when(F.size(rules) > 0, "flag").otherwise("allow")
