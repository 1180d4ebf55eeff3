"""Joins of facts with dimensions and of facts with side facts. Which physical join is used is left to the planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_labels(facts: DataFrame, dimension: DataFrame, key: str, *labels: str) -> DataFrame:
    """Left join of labels; a fact without a dimension row keeps null labels."""
    return facts.join(dimension.select(key, *labels), key, "left")


def with_counts(dimension: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Each dimension row with the number of its facts, 0 where there is none."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return dimension.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def that_have(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    return dimension.join(facts.select(key), key, "left_semi")


def that_lack(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    return dimension.join(facts.select(key), key, "left_anti")


def latest_of(dimension: DataFrame, facts: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Each dimension row with its facts' latest time: an aggregate and a join, in place of a subquery a row."""
    return dimension.join(facts.groupBy(key).agg(F.max(at).alias(name)), key, "left")


def first_fact(rows: DataFrame, facts: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Each row with the value of its earliest fact."""
    firsts = facts.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))
    return rows.join(firsts, key, "left")


def predecessor_hash(ledger: DataFrame, org: object, first_seq: int) -> DataFrame:
    """Chain hash of the greatest row before first_seq; one row, null if there is none."""
    return ledger.where((F.col("org_id") == org) & (F.col("seq") < first_seq)).agg(F.max_by("chain_hash", "seq").alias("prev_chain_hash"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    Both sides are sorted together and the values carried forward: one shuffle by key, no pairs.
    """
    from pyspark.sql import Window

    marked = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, *values).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(F.when(F.col("_side") == 0, F.col(v)), ignorenulls=True).over(order).alias(v) for v in values]
    return marked.select(*[c for c in left.columns if c not in values], "_side", *carried).where("_side = 1").drop("_side")


def acknowledged(alerts: DataFrame, acks: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with their newest acknowledgement, the unacknowledged first, then by level and id."""
    newest = acks.groupBy(key).agg(F.max_by("acked_by", "acked_at").alias("acked_by"), F.max("acked_at").alias("acked_at"))
    out = alerts.join(newest, key, "left").withColumn("acknowledged", F.col("acked_at").isNotNull())
    return out.orderBy("acknowledged", "level", key)


def unnotified(breaches: DataFrame, notified: DataFrame, newest: int = 20) -> DataFrame:
    """Of the newest breaches those without a notification; looking at the newest only is the feature."""
    top = breaches.orderBy(F.col("seq").desc()).limit(newest)
    return top.join(notified, ["kind", "target_id"], "left_anti")


def commitment_outcome(rows: DataFrame, known: DataFrame, check: Column) -> DataFrame:
    """Rows joined with known contents by event_id: match, mismatch, or unprovable without a commitment to check."""
    both = rows.join(known, "event_id")
    return both.withColumn("outcome", F.when(F.col("prompt_hash").isNull() | check.isNull(), "unprovable").when(check, "match").otherwise("mismatch"))


def with_reviews(ledger: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews with the ledger row that each is about; the tenant is part of the key on both sides."""
    own = reviews.select("org_id", "event_id", "review_id", "status", "resolution", F.col("created_at").alias("reviewed_at"))
    return ledger.join(own, ["org_id", "event_id"])
