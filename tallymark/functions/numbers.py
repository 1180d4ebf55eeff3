"""Rates, rounding, checksums and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Issuer prefixes assigned to card networks: fixed values. Ranges are (first, last).
ISSUER_PREFIXES = ("4", "34", "37", "6011", "65", "3095", "36", "38", "39", "62", "5018", "5020", "5038", "5893", "6304", "6759", "6761", "6762", "6763")
ISSUER_RANGES = ((51, 55), (2221, 2720), (644, 649), (300, 305), (3528, 3589))


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, half-even as in Python; null where there is nothing to divide by."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def delta_percent(total: Column, before: Column) -> Column:
    return F.when(before != 0, F.bround(100.0 * (total - before) / before, 1))


def truncated(x: Column) -> Column:
    return x.cast("int")


def luhn_ok(digits: Column) -> Column:
    """The checksum of 13 to 19 digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def issued(digits: Column) -> Column:
    """Starts with a prefix that some network has been assigned."""
    cond = F.lit(False)
    for p in ISSUER_PREFIXES:
        cond = cond | digits.startswith(p)
    for first, last in ISSUER_RANGES:
        cond = cond | F.substring(digits, 1, len(str(first))).cast("int").between(first, last)
    return F.coalesce(cond, F.lit(False))


def uniform(digits: Column) -> Column:
    return F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) == 0


def estimated_tokens(*parts: Column) -> Column:
    """For each part the larger of a quarter of its characters and its words; an empty part counts nothing."""
    total = F.lit(0)
    for p in parts:
        words = F.size(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""))
        total = total + F.coalesce(F.greatest(F.floor(F.length(p) / 4).cast("int"), words), F.lit(0))
    return total


def backoff_ceiling(failures: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(failures, F.lit(8)).cast("double")))


def jittered(ceiling: Column, key: Column) -> Column:
    """Between half of the ceiling and all of it, settled by a hash of the key so that a rerun gives the same."""
    return ceiling / 2 + ceiling / 2 * (F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000)
