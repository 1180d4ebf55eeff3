"""Window functions: gaps, latest rows, gapless numbers, first-seen tests. Each partitions by a key with many values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE_ROWS, numbered_rows, previous


def sequence_gaps(ledger: DataFrame, all_time: bool = True, width: int = RANGE_ROWS) -> DataFrame:
    """Missing ranges of each client's numbers. What comes before a client's first is a gap only over all time.

    Repeats make no gap and go before the shuffle; a client with most rows is spread over ranges of its numbers.
    """
    rows = ledger.where("client_id IS NOT NULL AND client_seq IS NOT NULL").select("client_id", "client_seq").distinct()
    seen = previous(rows, ["client_id"], "client_seq", ["client_seq"], width)
    gaps = seen.withColumn("before", F.coalesce("before_client_seq", F.lit(0 if all_time else None))).where(F.col("client_seq") > F.col("before") + 1)
    return gaps.select("client_id", (F.col("before") + 1).alias("gap_start"), (F.col("client_seq") - 1).alias("gap_end"), (F.col("client_seq") - F.col("before") - 1).alias("missing"))


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of greatest (order) for each key, found by an aggregate that combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def latest_failed(anchors: DataFrame) -> DataFrame:
    """Tenants whose latest anchor failed: the latest is picked first."""
    return latest_per(anchors, "org_id", "anchored_at", "id").where("status = 'failed'")


def latest_confirmed(anchors: DataFrame) -> DataFrame:
    """The latest anchor that was confirmed: those are picked first."""
    return latest_per(anchors.where("status = 'confirmed'"), "org_id", "anchored_at", "id")


def arrival_gaps(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """client_seq_gap of a batch in order of arrival: numbers skipped since the client's last, null for its first or an old number."""
    order = Window.partitionBy("client_id").orderBy("arrival")
    seen = F.max("client_seq").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = events.join(last_seen, "client_id", "left").withColumn("expected", F.greatest(seen, F.col("last_client_seq")) + 1)
    return joined.withColumn("client_seq_gap", F.when(F.col("client_seq") > F.col("expected"), F.col("client_seq") - F.col("expected"))).drop("expected")


def numbered(events: DataFrame, heads: DataFrame, order: str = "arrival", per_range: int = RANGE_ROWS) -> DataFrame:
    """Gapless numbers that continue each tenant's head; a tenant with most rows is spread over ranges of the order."""
    placed = numbered_rows(events, ["org_id"], order, "seq", per_range)
    return placed.join(heads, "org_id", "left").withColumn("seq", F.col("seq") + F.coalesce("head_seq", F.lit(0))).drop("head_seq")


def new_devices(logins: DataFrame) -> DataFrame:
    """Successful logins on a device the user had not used, though the user had logged in before."""
    ok = logins.where("success")
    user = Window.partitionBy("user_id").orderBy("created_at", "id")
    device = Window.partitionBy("user_id", "user_agent").orderBy("created_at", "id")
    return ok.withColumn("nth", F.row_number().over(user)).withColumn("nth_here", F.row_number().over(device)).where("nth > 1 AND nth_here = 1").drop("nth", "nth_here")


def against_week(days: DataFrame, key: str, measure: str) -> DataFrame:
    """Each day against the mean of the seven rows before it; null without a base."""
    base = F.avg(measure).over(Window.partitionBy(key).orderBy("day").rowsBetween(-7, -1))
    return days.withColumn("base", base).withColumn("delta_pct", F.when(F.col("base") > 0, F.bround((F.col(measure) - F.col("base")) / F.col("base") * 100).cast("int")))
