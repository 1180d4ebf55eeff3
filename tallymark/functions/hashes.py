"""Digests over canonical text. Where Spark has no built-in (sorted-key JSON, HMAC, ISO text), small Arrow UDFs."""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(text: str | Column) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes; null stays null."""
    return raw.map(lambda s: None if s is None else canonical(json.loads(s)))


def document_hash(raw: Column) -> Column:
    """Digest of a JSON document, whatever the order of its keys; null of null."""
    return F.sha2(canonical_json(raw), 256)


@F.pandas_udf(T.StringType())
def commitment(text: pd.Series, key: pd.Series, salt: pd.Series) -> pd.Series:
    """Keyed digest of a text, with an optional salt inside the canonical form rather than appended."""

    def one(t: str | None, k: str, s: str | None) -> str | None:
        if t is None:
            return None
        payload = canonical(t)
        if s:
            payload = canonical({"s": s, "v": payload})
        return hmac.new(k.encode(), payload.encode(), hashlib.sha256).hexdigest()

    return pd.Series([one(*x) for x in zip(text, key, salt, strict=True)])


@F.pandas_udf(T.StringType())
def utc_iso(raw: pd.Series) -> pd.Series:
    """One UTC text for one instant; a time without zone is UTC, and what is no time stays as it is."""

    def one(s: str | None) -> str | None:
        try:
            at = datetime.fromisoformat(s.strip().replace("Z", "+00:00").replace("z", "+00:00"))
        except (AttributeError, ValueError):
            return s
        return (at if at.utcoffset() is not None else at.replace(tzinfo=UTC)).astimezone(UTC).isoformat()

    return raw.map(one)


#: A time without zone that exists in every month.
PLAIN_TIME = r"^(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?\z"


def utc_of(raw: Column) -> Column:
    """``utc_iso`` of a text, natively where it is a plain time."""
    plain = F.coalesce(raw.rlike(PLAIN_TIME), F.lit(False))
    fraction = F.rpad(F.substring(raw, 20, 7), 7, "0")
    fraction = F.when((F.length(raw) == 19) | (fraction == ".000000"), "").otherwise(fraction)
    own = F.concat(F.substring(raw, 1, 10), F.lit("T"), F.substring(raw, 12, 8), fraction, F.lit("+00:00"))
    return F.when(plain, own).otherwise(utc_iso(F.when(~plain, raw)))


def pads(key: str) -> tuple[str, str]:
    """The two blocks, as hexadecimal digits, that a key is folded into."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def keyed_digest(text: Column, key: str) -> Column:
    """HMAC-SHA256 of a text under one key, natively; null of null."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def document_id(org: Column, first_day: Column, last_day: Column, root: Column) -> Column:
    """A stable id of a report: the same tenant, period and chain root give the same id."""
    return F.concat(F.lit("FA-"), F.upper(F.substring(F.sha2(F.concat_ws("|", org, first_day, last_day, root), 256), 1, 12)))
