"""Sorts, tops and pages. Every order has a tie-break, so pages neither repeat nor lose rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import is_breach, risk


def recent_high_risk(ledger: DataFrame, least: int = 50, top: int = 10) -> DataFrame:
    return ledger.where(is_breach() & (risk() >= least)).orderBy(F.col("seq").desc()).limit(top)


def offset_page(df: DataFrame, page: int, size: int, *order) -> tuple[DataFrame, DataFrame]:
    """A page and the total over all rows."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size), df.agg(F.count("*").alias("total"))


def keyset_page(df: DataFrame, after: int, size: int, key: str = "seq") -> DataFrame:
    """Rows after a key, one more than asked for: the extra row says that there are more."""
    return df.where(F.col(key) > after).orderBy(key).limit(size + 1)


def breaches_since(ledger: DataFrame, seq: int, limit: int) -> DataFrame:
    return ledger.where(is_breach() & (F.col("seq") > seq)).orderBy("seq").limit(limit)


def top_by(facts: DataFrame, key: str, measure, names: DataFrame, top: int, label: str) -> DataFrame:
    """The greatest sums and, looked up for those few only, their names."""
    best = facts.groupBy(key).agg(measure.alias("total")).orderBy(F.col("total").desc(), key).limit(top)
    return best.join(names.select(key, label), key, "left").orderBy(F.col("total").desc(), key)


def inbox(items: DataFrame, cap: int = 500) -> DataFrame:
    """The most pressing items, newest first; the cap is the feature of an inbox."""
    return items.orderBy(F.col("priority").desc(), F.col("created_at").desc(), "id").limit(cap)


def merged_feed(left: DataFrame, right: DataFrame, at: str, cap: int) -> DataFrame:
    """Two feeds of different columns, newest first."""
    return left.unionByName(right, allowMissingColumns=True).orderBy(F.col(at).desc(), "kind", "ref").limit(cap)


def due(queue: DataFrame, now: str, n: int) -> DataFrame:
    return queue.where(F.col("next_attempt_at") <= F.to_timestamp(F.lit(now))).orderBy("row_id").limit(n)


def newest(df: DataFrame, at: str, key: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(at).desc(), F.col(key).desc())
    return out.limit(n) if n else out


def by_two(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.orderBy(first, second)
