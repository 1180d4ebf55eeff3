"""Dates and times, all in UTC; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc_day(ts: str | Column) -> Column:
    return F.to_date(ts)


def day_text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def utc_text(ts: Column) -> Column:
    """A time as ISO text in UTC, with six digits of a second's fraction where it has one; the session's zone is UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def whole_day_start(now: Column, days_back: int) -> Column:
    """Midnight of the day that lies ``days_back`` days before now's."""
    return F.date_trunc("DAY", now) - F.make_dt_interval(F.lit(days_back))


def clamp_days(days: int) -> int:
    return max(1, min(365, days))


def within(ts: str | Column, now: Column, days: int) -> Column:
    """A rolling window of whole 24 hours back from now."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts >= now - F.make_dt_interval(F.lit(clamp_days(days)))


def half_open(ts: str, first_day: str | None, last_day: str | None) -> Column:
    """From the first day's start up to but without the start of the day after the last; either end may be open."""
    cond = F.lit(True)
    if first_day:
        cond = cond & (F.col(ts) >= F.to_timestamp(F.lit(first_day)))
    if last_day:
        cond = cond & (F.col(ts) < F.to_timestamp(F.date_add(F.lit(last_day).cast("date"), 1)))
    return cond


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1_000_000


def day_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def month_starts(spark: SparkSession, first: str, last: str) -> DataFrame:
    start = F.trunc(F.lit(first).cast("date"), "MONTH")
    return spark.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))


def months_spanned(df: DataFrame, column: str) -> DataFrame:
    """The first days of all months from a table's first to its last date."""
    ends = df.agg(F.trunc(F.min(column), "MONTH").alias("first"), F.trunc(F.max(column), "MONTH").alias("last"))
    return ends.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))


def iso_week(day: Column) -> Column:
    """Like 2024-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def last_week_start(today: Column) -> Column:
    """Monday of the last completed ISO week."""
    return F.date_sub(F.date_trunc("WEEK", today).cast("date"), 7)


def age_days(day: Column, today: Column) -> Column:
    return F.datediff(today, day)


def is_stale(at: Column, now: Column, hours: int) -> Column:
    """Longer ago than the threshold; never having happened is stale too."""
    return at.isNull() | (now - at > F.make_dt_interval(F.lit(0), F.lit(hours)))
