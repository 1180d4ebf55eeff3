"""Decisions: deterministic grades, checks and merges of verdicts, evaluation figures, access states and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import document_hash
from ..functions.nested import bound
from ..functions.numbers import rate
from .predicates import ENFORCED

VERDICT = "struct<policy_breach:boolean,reason:string,risk_score:int,decision:string,rules:array<string>,judge_provider:string,judge_model:string,graded_by:string>"
RANK = {"clean": 0, "human_review": 1, "breach": 2}
MERGED = {"clean": "multi_judge_clean", "human_review": "multi_judge_human_review", "breach": "multi_judge_breach"}
DEFAULT_MOST_TOKENS = 50_000


def verdict(breach: Column, reason: Column, risk: Column, decision: Column, rules: Column, by: str, provider: Column | None = None, model: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        breach.alias("policy_breach"), reason.alias("reason"), risk.cast("int").alias("risk_score"), decision.alias("decision"), rules.alias("rules"),
        (none if provider is None else provider).alias("judge_provider"), (none if model is None else model).alias("judge_model"), F.lit(by).alias("graded_by"),
    )


def deterministic(signals: Column, tokens: Column, most_tokens: Column | None = None, detect_pii: Column | None = None) -> Column:
    """A breach where personal data was signalled or too many tokens went out; riskier the more rules hold."""
    most = F.coalesce(F.nullif(most_tokens, F.lit(0)), F.lit(DEFAULT_MOST_TOKENS)) if most_tokens is not None else F.lit(DEFAULT_MOST_TOKENS)
    wanted = F.coalesce(detect_pii, F.lit(True)) if detect_pii is not None else F.lit(True)
    rules = F.array_compact(F.array(F.when(wanted & (F.coalesce(F.size(signals), F.lit(0)) > 0), F.lit("local_pii_signal")), F.when(F.coalesce(tokens, F.lit(0)) > most, F.lit("token_threshold_exceeded"))))
    breach = F.size(rules) > 0
    reason = F.when(breach, "deterministic metadata policy rule matched").otherwise("deterministic metadata checks passed; semantic content not evaluated")
    return verdict(breach, reason, F.when(breach, F.least(F.lit(100), 50 + 10 * F.size(rules))).otherwise(0), F.when(breach, "breach").otherwise("clean"), rules, "rules")


def enforcement(event_type: Column, decision: Column, rules: Column, label: Column) -> Column:
    """What a host kept back is no breach: nothing unsafe left it."""
    kind = F.when(event_type.isin(*ENFORCED), event_type).when(decision.isin(*ENFORCED), decision).otherwise("blocked")
    name = F.substring(F.trim(F.coalesce(label, F.lit(""))), 1, 200)
    said = {"response_blocked": ("host_blocked_response:", "host withheld the model response from the calling application"), "redacted": ("host_redacted_response:", "host redacted the response before it left the host"), "blocked": ("host_blocked_egress:", "host blocked the prompt before it left the host")}
    reason = reduce(lambda out, k: F.when(kind == k, F.when(name != "", F.concat(F.lit(said[k][0]), name)).otherwise(said[k][1])).otherwise(out), said, F.lit(None).cast("string"))
    kept = F.transform(F.coalesce(rules, F.array().cast("array<string>")), lambda r: F.substring(r, 1, 80))
    return verdict(F.lit(False), reason, F.lit(0), kind, kept, "host_enforcement")


def problems(v: Column) -> Column:
    """What contradicts itself in a judge's verdict."""
    breach, decision = v["policy_breach"], v["decision"]
    checks = {
        "decision_out_of_schema": ~decision.isin(*RANK),
        "breach_flag_with_clean_decision": breach & (decision == "clean"),
        "clean_flag_with_breach_decision": ~breach & (decision == "breach"),
        "breach_flag_with_human_review_decision": breach & (decision == "human_review"),
        "empty_or_low_confidence_reason": F.length(F.trim(F.coalesce(v["reason"], F.lit("")))) < 3,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return F.when(decision == "unknown", F.array().cast("array<string>")).otherwise(found)


def validated(v: Column) -> Column:
    """The verdict, or an honest unknown in its place."""
    bad = problems(v)
    empty = F.array().cast("array<string>")
    unknown = verdict(F.lit(False), F.concat(F.lit("evaluator_unknown:"), F.array_join(bad, ",")), F.lit(0), F.lit("unknown"), empty, "none", v["judge_provider"], v["judge_model"])
    return F.when(F.size(bad) > 0, unknown.cast(VERDICT)).otherwise(v.cast(VERDICT))


def effective(v: Column) -> Column:
    return F.when((v["decision"] == "clean") & v["policy_breach"], "breach").otherwise(v["decision"])


def rank(decision: Column) -> Column:
    return reduce(lambda out, k: F.when(decision == k, RANK[k]).otherwise(out), RANK, F.lit(None).cast("int"))


def unprefixed(reason: Column) -> Column:
    """One merge's label is taken off, not more."""
    return F.regexp_replace(reason, f"^(?:{'|'.join(MERGED.values())}): ", "")


def merged(verdicts: Column) -> Column:
    """One verdict from an array of them: the strongest known outcome, the greatest risk, and all rules, reasons and judges in order."""

    def of_known(known: Column) -> Column:
        top = F.array_max(F.transform(known, lambda v: rank(effective(v))))
        decision = F.element_at(F.array(*[F.lit(k) for k in RANK]), top + 1)
        label = F.element_at(F.array(*[F.lit(v) for v in MERGED.values()]), top + 1)
        reasons = F.filter(F.transform(known, lambda v: F.when(F.coalesce(v["reason"], F.lit("")) != "", unprefixed(v["reason"]))), lambda r: r.isNotNull())
        named = lambda f: F.nullif(F.array_join(F.filter(F.transform(known, lambda v: v[f]), lambda x: F.coalesce(x, F.lit("")) != ""), ","), F.lit(""))
        out = verdict(
            decision == "breach", F.concat(label, F.lit(": "), F.array_join(reasons, "; ")), F.array_max(F.transform(known, lambda v: v["risk_score"])), decision,
            F.array_distinct(F.flatten(F.transform(known, lambda v: F.coalesce(v["rules"], F.array().cast("array<string>"))))), "ai", named("judge_provider"), named("judge_model"),
        )
        return out.cast(VERDICT)

    known = lambda vs: F.filter(vs, lambda v: rank(effective(v)).isNotNull())
    return bound(verdicts, lambda vs: bound(known(vs), lambda k: F.when((F.size(k) == 0) | (F.size(vs) == 1), F.element_at(vs, 1)).otherwise(of_known(k))))


def combine(first: Column, second: Column) -> Column:
    """The stronger known outcome of two; an unknown is no grade, and two unknowns leave the first."""
    return combine_all([first, second])


def combine_all(verdicts: list[Column]) -> Column:
    """The verdicts of several judges, in the providers' order; each is worked out once however many there are."""
    return merged(F.array(*[v.cast(VERDICT) for v in verdicts]))


def with_fallback(judged: Column, rules_verdict: Column) -> Column:
    """Where no judge could be reached the rules decide, and the reason is kept."""
    gone = (judged["decision"] == "unknown") & judged["reason"].startswith("evaluator_unavailable")
    kept = F.struct(*[(F.concat(judged["reason"], F.lit("; "), rules_verdict["reason"]) if f == "reason" else rules_verdict[f]).alias(f) for f in ("policy_breach", "reason", "risk_score", "decision", "rules", "judge_provider", "judge_model", "graded_by")])
    return F.when(gone, kept.cast(VERDICT)).otherwise(judged.cast(VERDICT))


def snapshot_ok(snapshot: Column, digest: Column) -> Column:
    """A policy snapshot counts only if it is what its digest was taken of."""
    return F.coalesce(document_hash(snapshot) == digest, F.lit(False))


def is_known(decision: Column) -> Column:
    return decision.isin("clean", "breach")


def agreement(pairs: DataFrame) -> DataFrame:
    """Two judges on the same rows (id, a, b: structs of policy_breach, risk_score, decision)."""
    both = pairs.where(is_known(F.col("a.decision")) & is_known(F.col("b.decision")))
    same, gap = F.col("a.policy_breach") == F.col("b.policy_breach"), F.abs(F.col("a.risk_score") - F.col("b.risk_score"))
    one = both.agg(F.count("*").alias("rows_both_known"), F.count_if(same).alias("agree"), F.bround(F.avg(gap), 1).alias("risk_gap_mean"), F.median(gap).alias("risk_gap_median"), F.max(gap).alias("risk_gap_max"))
    return one.withColumn("agree_pct", rate(F.col("agree"), F.col("rows_both_known")))


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_known(F.col("a.decision")) & is_known(F.col("b.decision")) & (F.col("a.policy_breach") != F.col("b.policy_breach"))).select("id")


def stability(runs: DataFrame) -> DataFrame:
    """Repeated runs of one judge (id, policy_breach, risk_score, decision): flips and spread of risk."""
    known = is_known(F.col("decision"))
    rows = runs.groupBy("id").agg(F.count("*").alias("runs"), F.count_distinct(F.when(known, F.col("policy_breach"))).alias("kinds"), (F.max(F.when(known, F.col("risk_score"))) - F.min(F.when(known, F.col("risk_score")))).alias("spread")).where("runs > 1")
    one = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("kinds") > 1).alias("flipped_rows"), F.bround(F.avg("spread"), 1).alias("risk_spread_mean"), F.max("spread").alias("risk_spread_max"))
    return one.withColumn("flip_rate_pct", rate(F.col("flipped_rows"), F.col("rows")))


def accuracy(rows: DataFrame) -> DataFrame:
    """Labelled rows (id, expected: boolean, got: boolean, decision): what was answered, right, wrongly raised and missed."""
    known = is_known(F.col("decision"))
    right = F.col("got") == F.col("expected")
    one = rows.where("expected IS NOT NULL").agg(F.count("*").alias("labelled"), F.count_if(known).alias("answered"), F.count_if(known & right).alias("correct"), F.count_if(known & F.col("got") & ~F.col("expected")).alias("false_positives"), F.count_if(known & ~F.col("got") & F.col("expected")).alias("false_negatives"))
    return one.withColumn("accuracy_pct", rate(F.col("correct"), F.col("answered")))


def contradictions(rows: DataFrame) -> DataFrame:
    """Where a judge (judge_breach) and the rules (rule_breach) differ, among answered rows."""
    return rows.where(is_known(F.col("decision")) & (F.col("judge_breach") != F.col("rule_breach")))


def reliability(calls: DataFrame) -> DataFrame:
    """Calls (transport_failed, reason, attempts) that came to nothing or needed another try."""
    one = calls.agg(F.count("*").alias("calls"), F.count_if("transport_failed").alias("unavailable"), F.count_if(F.col("reason").startswith("evaluator_unknown")).alias("quarantined"), F.count_if(F.col("attempts") > 1).alias("retried"))
    return one.withColumn("unknown_rate_pct", rate(F.col("unavailable") + F.col("quarantined"), F.col("calls")))


def probe_outcome() -> Column:
    """What became of a probe (expect, enforced, prevented, changed, empty_reply, answered, fault)."""
    assist = F.when(F.col("prevented") | F.col("changed"), "over_blocked").when(F.col("empty_reply"), "error").when(F.col("answered"), "assisted").otherwise("over_blocked")
    return (
        F.when(F.col("fault"), "error")
        .when(F.col("expect") == "block", F.when(F.col("enforced"), "caught").otherwise("missed"))
        .when(F.col("expect") == "assist", assist)
        .otherwise(F.when(F.col("enforced"), "gap_closed").otherwise("gap_open"))
    )


OUTCOMES = ("caught", "missed", "assisted", "over_blocked", "gap_open", "gap_closed", "error")
FAILING = ("missed", "over_blocked", "error")


def scoreboard(probes: DataFrame, sector: str = "sector") -> DataFrame:
    """Outcomes by sector; an open gap fails no run."""
    out = probes.withColumn("outcome", probe_outcome()).groupBy(sector).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if(F.col("expect") == "block").alias("enforcement_total"), F.count_if(F.col("expect") == "assist").alias("assistance_total"))
    return out.withColumn("ok", reduce(lambda c, o: c & (F.col(o) == 0), FAILING, F.lit(True)))


def derived_alerts(health: DataFrame, anchors: DataFrame, now: Column, stale_hours: int) -> DataFrame:
    """Alerts from a health row a component (component, ok, detail) and the latest anchor a tenant."""
    sick = health.where(~F.col("ok")).select(F.concat(F.lit("health:"), F.col("component")).alias("alert_id"), F.lit("critical").alias("level"), F.col("detail").alias("message"))
    failed = anchors.where("status = 'failed'").select(F.concat(F.lit("anchor_failed:"), F.col("org_id")).alias("alert_id"), F.lit("warning").alias("level"), F.lit("the latest anchor failed").alias("message"))
    old = anchors.where((F.col("status") == "confirmed") & (now - F.col("confirmed_at") > F.make_dt_interval(F.lit(0), F.lit(stale_hours))))
    stale = old.select(F.concat(F.lit("anchor_stale:"), F.col("org_id")).alias("alert_id"), F.lit("warning").alias("level"), F.lit("the latest anchor is old").alias("message"))
    return sick.unionByName(failed).unionByName(stale)


#: Plans without a subscription, and subscription states: fixed values.
UNPAID_PLANS = ("", "free")
ENDED = ("cancelled", "unpaid")
NEVER_ACTIVATED = ("incomplete", "incomplete_expired")


def low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def pending_approval() -> Column:
    return F.when(low("approval_status") == "pending", "account_pending")


def evaluation_expired(now: Column) -> Column:
    return F.when(F.col("evaluation_offer_id").isNotNull() & (F.col("evaluation_ends_at") <= now), "evaluation_expired")


def dashboard_lock(now: Column, grace_days: int = 7, require_card: bool = False, cards_since: Column | None = None) -> Column:
    """What locks a tenant's dashboard, the first that applies: pending, evaluation, trial, subscription, card.

    Tenants created before ``cards_since`` need no card; without that date none does.
    """
    trial = F.when((low("approval_status") == "approved") & (low("plan_tier") == "free") & (F.col("trial_ends_at") <= now), "trial_expired")
    overdue = F.col("past_due_since") + F.make_dt_interval(F.lit(grace_days)) <= now
    subscription = F.when(~low("plan_tier").isin(*UNPAID_PLANS), F.when(low("subscription_status").isin(*NEVER_ACTIVATED), "subscription_incomplete").when((low("subscription_status") == "past_due") & overdue, "subscription_past_due"))
    card = F.lit(None).cast("string")
    if require_card and cards_since is not None:
        card = F.when(~F.col("card_on_file") & (F.col("created_at") >= cards_since), "card_required")
    return F.coalesce(pending_approval(), evaluation_expired(now), trial, subscription, card)


def capture_block(now: Column, pending: int = 1) -> Column:
    """What stops a tenant from recording: pending, trial, ended plan, evaluation, then its credits for a batch as a whole."""
    trial = F.when((low("plan_tier") == "free") & (F.col("trial_ends_at") <= now), "trial_expired")
    ended = F.when(~low("plan_tier").isin(*UNPAID_PLANS) & low("subscription_status").isin(*ENDED), "subscription_inactive")
    spent = F.coalesce(F.col("evaluation_credits_used"), F.lit(0)) + pending > F.coalesce(F.col("evaluation_credit_limit"), F.lit(0))
    credits = F.when(F.col("evaluation_offer_id").isNotNull() & F.lit(pending > 0) & spent, "evaluation_credits_exhausted")
    return F.coalesce(pending_approval(), trial, ended, evaluation_expired(now) if pending > 0 else F.lit(None).cast("string"), credits)
