"""Patterns of the rulesets for DuckDB, which has no look-around and gives classes their ASCII meaning."""

from __future__ import annotations

from ..operators import rulesets


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern in Java's dialect as an SQL literal."""
    return sql_text(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def fired_sql(text: str, rules: dict[str, str]) -> str:
    """A sorted list of the rules that occur in a text."""
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {re2(p)}) THEN '{n}' END" for n, p in sorted(rules.items()))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


#: Look-arounds as characters beside the match: what one match takes, the next cannot share, which only matters between touching ones.
PHONE = r"(?:^|[^0-9A-Za-z\-])((?:\+?\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4})(?:$|[^0-9A-Za-z\-])"
CARD = r"(?:^|[^0-9A-Za-z])([1-9](?:[ \-]?\d){12,18})(?:$|[^0-9A-Za-z])"
PREFIXES = "4|34|37|6011|65|3095|36|38|39|62|5018|5020|5038|5893|6304|6759|6761|6762|6763"
RANGES = ((2, 51, 55), (4, 2221, 2720), (3, 644, 649), (3, 300, 305), (4, 3528, 3589))


def luhn_sql(digits: str) -> str:
    d = f"CAST({digits}[len({digits}) + 1 - i] AS INTEGER)"
    return f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0"


def card_sql(text: str) -> str:
    runs = f"list_transform(regexp_extract_all({text}, {sql_text(CARD)}, 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    issued = " OR ".join([f"regexp_matches(d, '^(?:{PREFIXES})')", *(f"CAST(d[1:{n}] AS INTEGER) BETWEEN {a} AND {b}" for n, a, b in RANGES)])
    return f"len(list_filter({runs}, lambda d: replace(d, d[1], '') <> '' AND ({issued}) AND {luhn_sql('d')})) > 0"


def pii_sql(text: str) -> str:
    """A sorted list of the labels of personal data in a text."""
    personal = rulesets.at(rulesets.PERSONAL)
    cases = {
        "credit_card": card_sql(text),
        "email": f"regexp_matches({text}, {re2(personal['email'])})",
        "ip_address": f"regexp_matches({text}, {re2(personal['ip_address'])})",
        "phone": f"len(list_filter(regexp_extract_all({text}, {sql_text(PHONE)}, 1), lambda m: regexp_replace(m, '[^1-9]', '', 'g') <> '')) > 0",
        "ssn_pattern": f"regexp_matches({text}, {re2(personal['ssn_pattern'])})",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases.items()) + "], lambda x: x IS NOT NULL)"
