"""Aggregations: each report is one pass with filtered measures, or one aggregate a grain, joined to a spine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_spine, iso_week, month_text, utc_day, within
from ..functions.numbers import delta_percent, rate
from .predicates import graded_by, has_decision, is_breach, is_graded_breach, is_unknown, risk, risk_band

STATUSES = ("pending", "in_progress", "graded", "failed")


def filtered(name: str, cond: Column) -> Column:
    return F.count_if(cond).alias(name)


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """All tiles of a tenant's overview in one pass: counts, rates over what is known, mean delay of grading."""
    graded = F.col("grading_status") == "graded"
    known = graded & ~is_unknown()  # a verdict without decision and reason is neither known nor unknown
    one = ledger.agg(
        F.count("*").alias("total_logged"),
        filtered("breaches", is_graded_breach()),
        filtered("known_graded", known),
        filtered("evaluator_unknown", graded & is_unknown()),
        filtered("human_review", graded & has_decision("human_review")),
        filtered("graded_by_ai", graded & graded_by("ai")),
        filtered("graded_by_rules", graded & graded_by("rules")),
        filtered("blocked", F.col("event_type") == "blocked"),
        filtered("response_blocked", F.col("event_type") == "response_blocked"),
        filtered("redacted", F.col("event_type") == "redacted"),
        *[filtered(f"status_{s}", F.col("grading_status") == s) for s in STATUSES],
        F.sum("token_count").alias("tokens"),
    )
    clean = F.col("known_graded") - F.col("breaches") - F.col("human_review")
    return one.withColumn("clean_rate", rate(clean, F.col("known_graded")))


def by_tag(ledger: DataFrame) -> DataFrame:
    return ledger.where(is_breach()).groupBy("policy_tag").agg(F.count("*").alias("breaches")).orderBy(F.col("breaches").desc(), "policy_tag")


def by_agent(ledger: DataFrame, top: int = 12) -> DataFrame:
    """Breaches and mean risk by agent. Rows without agent and rows of an agent named like their label stay apart."""
    groups = ledger.where(is_breach()).groupBy("agent").agg(F.count("*").alias("breaches"), F.avg(risk()).cast("int").alias("avg_risk"))
    return groups.orderBy(F.col("breaches").desc(), F.col("agent").asc_nulls_last()).limit(top).select(F.coalesce("agent", F.lit("unattributed")).alias("agent"), "breaches", "avg_risk")


def bands_by_day(ledger: DataFrame) -> DataFrame:
    band = risk_band(risk())
    return ledger.where(is_breach()).groupBy(utc_day("created_at").alias("day")).agg(filtered("high", band == "high"), filtered("medium", band == "medium"), filtered("low", band == "low"), F.count("*").alias("total"))


def usage_daily(ledger: DataFrame) -> DataFrame:
    """The rollup: per tenant and UTC day. A rerun over whole days replaces them."""
    return ledger.groupBy("org_id", utc_day("created_at").alias("day")).agg(
        F.count("*").alias("logs_count"),
        F.sum("token_count").alias("tokens_sum"),
        filtered("breach_count", is_breach()),
        filtered("graded_count", F.col("grading_status") == "graded"),
        filtered("failed_count", F.col("grading_status") == "failed"),
        filtered("pending_count", F.col("grading_status").isin("pending", "in_progress")),
    )


SKETCH_BITS = 12  # a sketch has 2**12 registers: a standard error of 1.04 / 2**6, or 1.6 %


def client_sketches(ledger: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """The rollup's distinct clients: per tenant and UTC day a mergeable sketch beside the exact number of the day.

    Days of sketches merge to weeks, months or any choice of days without reading an event again; the exact numbers do not.
    """
    clients = F.col("client_id").cast("string")
    return ledger.where("client_id IS NOT NULL").groupBy("org_id", utc_day("created_at").alias("day")).agg(F.count_distinct("client_id").alias("clients"), F.hll_sketch_agg(clients, bits).alias("sketch"))


def clients_over(sketches: DataFrame, *by) -> DataFrame:
    """Estimated distinct clients over merged days, and the error that two in three estimates stay within."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.max("clients").alias("least"))
    return merged.withColumn("estimate", F.greatest(F.hll_sketch_estimate("sketch"), F.col("least"))).withColumn("error", F.col("estimate") * 1.04 / 2 ** (SKETCH_BITS / 2)).drop("sketch", "least")


def whole_days(ledger: DataFrame, now: str, days_back: int = 2) -> DataFrame:
    """Rows of the days that a rollup pass recomputes: whole days only, so that a pass never makes a day smaller."""
    start = F.date_trunc("DAY", F.to_timestamp(F.lit(now))) - F.make_dt_interval(F.lit(days_back))
    return ledger.where(F.col("created_at") >= start)


def client_stats(ledger: DataFrame) -> DataFrame:
    return ledger.where("client_id IS NOT NULL AND client_seq IS NOT NULL").groupBy("client_id").agg(
        F.count("*").alias("events"), F.min("client_seq").alias("first_client_seq"), F.max("client_seq").alias("last_client_seq"),
        F.min("seq").alias("server_seq_start"), F.max("seq").alias("server_seq_end"), F.max("created_at").alias("last_seen_at"),
    )


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def histogram(df: DataFrame, column: str, seeds: tuple[str, ...]) -> DataFrame:
    """Counts with a row for every seed, 0 where nothing has it; other values are left out."""
    spark = df.sparkSession
    keys = spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return keys.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), "place")


def zero_filled(series: DataFrame, first: str, last: str, *measures: str, day: str = "day") -> DataFrame:
    """Every day of the period, 0 where the series has none."""
    spine = day_spine(series.sparkSession, first, last)
    return spine.join(series, day, "left").select(day, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def metric_with_delta(facts: DataFrame, at: str, measure: Column, first: str, last: str, before_first: str) -> DataFrame:
    """A zero-filled series with the period's total, the total of the window before and the change in per cent."""
    days = facts.where(F.col(at).cast("date").between(F.lit(before_first).cast("date"), F.lit(last).cast("date"))).groupBy(utc_day(at).alias("day")).agg(measure.alias("value"))
    inside = F.col("day") >= F.lit(first).cast("date")
    totals = days.agg(F.coalesce(F.sum(F.when(inside, F.col("value"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~inside, F.col("value"))), F.lit(0)).alias("prev_total"))
    totals = totals.withColumn("delta_pct", delta_percent(F.col("total"), F.col("prev_total")))
    return zero_filled(days.where(inside), first, last, "value").crossJoin(F.broadcast(totals))  # one row of totals


def traffic_series(traffic: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Hits a day for each site, and errors, in one scan."""
    return traffic.groupBy(utc_day("created_at").alias("day")).agg(*[F.sum(F.when(F.col("site") == s, 1).otherwise(0)).alias(s) for s in sites], F.sum(F.when(F.col("status_code") >= 500, 1).otherwise(0)).alias("errors"))


def plan_mix(orgs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    counts = orgs.groupBy(F.coalesce("plan_tier", F.lit("none")).alias("plan")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("plan"))
    return counts.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1)).orderBy("place", "plan")


def login_watch(logins: DataFrame, least: int = 5) -> DataFrame:
    """Those with at least so many failures."""
    return logins.groupBy("user_id").agg(filtered("failures", ~F.col("success")), filtered("successes", F.col("success"))).where(F.col("failures") >= least)


def logins_by_day(logins: DataFrame) -> DataFrame:
    return logins.groupBy(utc_day("created_at").alias("day")).agg(filtered("ok", F.col("success")), filtered("failed", ~F.col("success")))


def revenue_by_month_plan(invoices: DataFrame, orgs: DataFrame, plans: list[str]) -> DataFrame:
    """Cents by month, a column for each plan; the plans are stated, so no pass looks for them."""
    rows = invoices.join(orgs.select("org_id", "plan_tier"), "org_id")
    return rows.groupBy(month_text("created_at").alias("month")).pivot("plan_tier", plans).agg(F.sum("amount_cents")).na.fill(0)


def history(ledger: DataFrame) -> DataFrame:
    """Recent grades of a tenant and its breach rate."""
    one = ledger.groupBy("org_id").agg(filtered("recent_graded", F.col("grading_status") == "graded"), filtered("recent_breaches", is_graded_breach()))
    return one.withColumn("breach_rate_pct", rate(F.col("recent_breaches"), F.col("recent_graded")))


def week_digest(ledger: DataFrame) -> DataFrame:
    """Totals by tenant and ISO week."""
    return ledger.groupBy("org_id", iso_week(utc_day("created_at")).alias("week")).agg(F.count("*").alias("events"), filtered("breaches", is_breach()), F.sum("token_count").alias("tokens"))


def passport_policies(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("policy_tag").agg(F.count("*").alias("events"), filtered("breaches", is_breach()), F.bround(F.sum("token_count") / F.count("*")).cast("long").alias("avg_tokens"))


def passport_totals(ledger: DataFrame) -> DataFrame:
    """Enforcement tallies and compliance; an empty period is compliant."""
    one = ledger.agg(
        F.count("*").alias("total_events"),
        filtered("breach_events", is_breach()),
        filtered("blocked_events", F.col("event_type") == "blocked"),
        filtered("redacted_events", F.col("event_type") == "redacted"),
        filtered("response_blocked_events", F.col("event_type") == "response_blocked"),
        filtered("unknown_events", F.coalesce(is_unknown(), F.lit(False))),
        filtered("human_review_events", ~F.coalesce(is_unknown(), F.lit(False)) & has_decision("human_review")),
    )
    compliant = F.col("total_events") - F.col("breach_events") - F.col("human_review_events")
    return one.withColumn("compliance_rate", F.coalesce(rate(compliant, F.col("total_events")), F.lit(100.0)))


def with_unread(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count("*").alias("total"), filtered("unread", F.col("read_at").isNull()))


def quota(used: DataFrame, limits: DataFrame) -> DataFrame:
    """Month-to-date use against the limit; without a limit nothing remains to be counted."""
    out = limits.join(used, "org_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    left = F.greatest(F.col("monthly_log_quota") - F.col("used"), F.lit(0))
    return out.withColumn("remaining", left).withColumn("pct", rate(F.col("used"), F.col("monthly_log_quota")))


def coverage_percent(total: Column, missing: Column) -> Column:
    return F.when(total + missing > 0, F.bround(total / (total + missing) * 100).cast("int"))


def coverage_tone(pct: Column) -> Column:
    return F.when(pct.isNull(), "mute").when(pct >= 95, "ok").when(pct >= 80, "warn").otherwise("bad")


def verdict_mix(stats: DataFrame) -> DataFrame:
    """Clean is what is left of the graded rows, never below 0."""
    kept = F.col("status_graded") - F.col("breaches") - F.col("blocked") - F.col("response_blocked") - F.col("redacted") - F.col("evaluator_unknown") - F.col("human_review")
    return stats.select(F.greatest(kept, F.lit(0)).alias("clean"), "breaches", (F.col("blocked") + F.col("response_blocked")).alias("blocked"), "redacted", "evaluator_unknown", (F.col("status_pending") + F.col("status_in_progress")).alias("pending"), F.col("status_failed").alias("failed"))


def heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("org_id").agg(F.max("seq").alias("head_seq"), F.max_by("chain_hash", "seq").alias("head_hash"))


def chain_coverage(actions: DataFrame) -> DataFrame:
    """Chained and older rows in one pass."""
    return actions.agg(filtered("chained", F.col("seq").isNotNull()), filtered("unchained", F.col("seq").isNull()), F.max("seq").alias("head_seq"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row results as one row."""
    return reduce(DataFrame.crossJoin, rows)


def platform_totals(orgs: DataFrame, users: DataFrame, staff: DataFrame, rollup: DataFrame, leads: DataFrame, statuses: tuple[str, ...] = ("new", "trial", "converted", "churned")) -> DataFrame:
    """One row: live, active and suspended tenants, people, what the rollup adds up to, and leads by status. The ledger is not read."""
    live = F.col("deleted_at").isNull()
    tenants = orgs.agg(filtered("total_orgs", live), filtered("active_orgs", live & (F.col("subscription_status") == "active")), filtered("suspended_orgs", F.coalesce("suspended", F.lit(False))))
    logs = rollup.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("logs_count", "total_logs"), ("breach_count", "total_breaches"))])
    return side_by_side(tenants, users.agg(F.count("*").alias("total_users")), staff.agg(F.count("*").alias("total_staff")), logs, leads.agg(*[filtered(f"leads_{x}", F.col("status") == x) for x in statuses]))


def site_totals(traffic: DataFrame, now: Column, sites: tuple[str, ...], days: int = 7) -> DataFrame:
    """Hits of each site and errors of any, in the last ``days`` times 24 hours."""
    recent = traffic.where(within("created_at", now, days))
    return recent.agg(*[filtered(x, F.col("site") == x) for x in sites], filtered("errors", F.col("status_code") >= 400))


def revenue_summary(invoices: DataFrame, orgs: DataFrame, now: Column) -> DataFrame:
    """One row: paid cents of the last 30 days, and live tenants whose trial still runs."""
    paid = invoices.where((F.col("status") == "paid") & within("created_at", now, 30)).agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("revenue_30d_cents"))
    return side_by_side(paid, orgs.where(F.col("deleted_at").isNull()).agg(filtered("trialing", F.coalesce(F.col("trial_ends_at") > now, F.lit(False)))))


def subscription_mix(orgs: DataFrame) -> DataFrame:
    """Live tenants by subscription status."""
    return orgs.where(F.col("deleted_at").isNull()).groupBy(F.coalesce("subscription_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def health_trend(rollup: DataFrame, anchors: DataFrame, first: str, last: str) -> DataFrame:
    """Grading sums and anchors of each day of the period, 0 where there is none."""
    grading = rollup.groupBy("day").agg(*[F.sum(f"{x}_count").alias(x) for x in ("graded", "failed", "pending")])
    anchored = anchors.groupBy(utc_day("anchored_at").alias("day")).agg(F.count("*").alias("anchored"), filtered("confirmed", F.col("status") == "confirmed"))
    return zero_filled(grading.join(anchored, "day", "full"), first, last, "graded", "failed", "pending", "anchored", "confirmed")


def prior_reviews(reviewed: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """What people ruled on a tenant's earlier escalations, by tag. ``reviewed``: ``joins.with_reviews``."""
    ruled = lambda r: filtered(r, F.coalesce(F.col("resolution") == r, F.lit(False)))
    return reviewed.where(within("reviewed_at", now, days)).groupBy("org_id", "policy_tag").agg(F.count("*").alias("escalations"), *map(ruled, ("cleared", "confirmed_breach", "policy_gap")))
