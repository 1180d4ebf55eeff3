"""Predicates and labels over ledger rows. Three-valued logic is kept: an unknown stays unknown under NOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import field

VERDICT = "gemini_verdict"
#: Decisions of a host that kept something back, and rank of judged decisions: fixed values.
ENFORCED = ("blocked", "redacted", "response_blocked")
PENDING = ("pending", "in_progress", "failed")


def is_breach(verdict: str = VERDICT) -> Column:
    """The verdict says so in so many words; null where there is no verdict."""
    return field(verdict, "policy_breach") == "true"


def is_graded_breach(verdict: str = VERDICT) -> Column:
    return (F.col("grading_status") == "graded") & is_breach(verdict)


def is_unknown(verdict: str = VERDICT) -> Column:
    reason = field(verdict, "reason")
    return (field(verdict, "decision") == "unknown") | reason.like("evaluator_unavailable:%") | (reason == "evaluator_unavailable")


def graded_by(who: str, verdict: str = VERDICT) -> Column:
    return field(verdict, "graded_by") == who


def has_decision(decision: str, verdict: str = VERDICT) -> Column:
    return field(verdict, "decision") == decision


def risk(verdict: str = VERDICT) -> Column:
    return field(verdict, "risk_score").try_cast("int")


def matches(q: str) -> Column:
    """Text search over four columns, whatever the case; wildcards stay live."""
    cond = F.lit(False)
    for c in ("prompt_hash", "chain_hash", "policy_tag", "agent"):
        cond = cond | F.coalesce(F.col(c), F.lit("")).ilike(f"%{q}%")
    return cond


def ledger_filter(ledger: DataFrame, q: str | None = None, tag: str | None = None, agent: str | None = None, since: str | None = None, until: str | None = None, verdict: str | None = None) -> DataFrame:
    """The ledger view's filters together; both ends of the period are inclusive."""
    if since:
        ledger = ledger.where(F.col("created_at") >= F.to_timestamp(F.lit(since)))
    if until:
        ledger = ledger.where(F.col("created_at") <= F.to_timestamp(F.lit(until)))
    if tag:
        ledger = ledger.where(F.col("policy_tag") == tag)
    if agent:
        ledger = ledger.where(F.col("agent") == agent)
    if q:
        ledger = ledger.where(matches(q))
    if verdict:
        ledger = ledger.where(verdict_filter(verdict))
    return ledger


def verdict_filter(kind: str) -> Column:
    """Rows of one kind of verdict: what is not graded yet is pending, and the judged kinds need a grade."""
    graded = F.col("grading_status") == "graded"
    kinds = {
        "pending": ~graded,
        "breach": graded & is_breach(),
        "clean": graded & has_decision("clean") & ~is_breach(),
        "human_review": graded & has_decision("human_review"),
        "unknown": graded & is_unknown(),
        "blocked": F.col("event_type").isin("blocked", "response_blocked"),
        "redacted": F.col("event_type") == "redacted",
    }
    return kinds[kind]


def after(seq: int) -> Column:
    return F.col("seq") > seq


def non_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(F.trim(c)) > 0)


def mine_or_all(c: str, me: object) -> Column:
    return (F.col(c) == me) | F.col(c).isNull()


def equals_text(c: str, value: str) -> Column:
    return F.col(c).cast("string") == value


def starts_like(c: str, prefix: str) -> Column:
    return F.col(c).ilike(f"{prefix}%")


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def verdict_label(verdict: str = VERDICT) -> Column:
    """What a row shows, the first that applies: what a host did comes before what a judge found."""
    reason = F.coalesce(field(verdict, "reason"), F.lit(""))
    unknown = reason.startswith("evaluator_unavailable") | reason.startswith("evaluator_unknown") | F.coalesce(has_decision("unknown", verdict), F.lit(False))
    return (
        F.when(F.col("event_type").isin("blocked", "response_blocked"), "blocked")
        .when(F.col("event_type") == "redacted", "redacted")
        .when(unknown, "unknown")
        .when(is_breach(verdict), "breach")
        .when(has_decision("human_review", verdict), "human review")
        .when(F.col("grading_status") == "graded", "safe")
        .when(F.col("grading_status") == "failed", "flag")
        .otherwise("pending")
    )


def record_status(intact: Column, verdict: str = VERDICT) -> Column:
    """One record: tampered before anything else."""
    return F.when(~intact, "tampered").when(is_breach(verdict), "breach").when(F.col("grading_status") == "graded", "safe").when(F.col("grading_status") == "failed", "flag").otherwise("pending")


#: What of an event may reach a judge: fixed values.
SAFE_COLUMNS = ("prompt_hash", "response_hash", "token_count", "policy_tag", "pii_signals", "event_id", "event_type", "commitment_alg", "client_id", "client_seq")
SAFE_METADATA = ("request_id", "trace_id", "session_id", "provider", "model", "id", "choice_count", "tool_names", "retrieval_refs", "client_seq_gap")


def content_blind(df: DataFrame, metadata: str = "event_metadata") -> DataFrame:
    """Only allowed columns and, of the metadata map, only allowed keys."""
    allowed = F.array(*[F.lit(k) for k in SAFE_METADATA])
    keep = [c for c in SAFE_COLUMNS if c in df.columns]
    return df.select(*keep, *([F.map_filter(metadata, lambda k, v: F.array_contains(allowed, k)).alias(metadata)] if metadata in df.columns else []))


def validated(df: DataFrame, allowed_keys: tuple[str, ...] = SAFE_METADATA) -> DataFrame:
    """Ingest checks as columns: is_valid, and reject_reason naming all that failed."""
    hexed = lambda c: F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    keys = F.array(*[F.lit(k) for k in allowed_keys])
    meta = F.coalesce(F.col("event_metadata"), F.create_map().cast("map<string,string>"))
    checks = {
        "prompt_hash": hexed("prompt_hash"),
        "response_hash": hexed("response_hash"),
        "token_count": F.coalesce(F.col("token_count").between(0, 10_000_000), F.lit(False)),
        "policy_tag": F.coalesce(F.col("policy_tag").rlike("^[a-z0-9_]{1,32}$"), F.lit(False)),
        "client_seq": F.coalesce(F.col("client_seq") >= 1, F.lit(True)),
        "metadata_keys": F.size(F.array_except(F.map_keys(meta), keys)) == 0,
        "metadata_items": F.size(F.map_keys(meta)) <= 64,
        "metadata_values": ~F.exists(F.map_values(meta), lambda v: F.length(v) > 256),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("reject_reason", F.nullif(F.array_join(failed, ","), F.lit(""))).withColumn("is_valid", F.col("reject_reason").isNull())


def attributed(events: DataFrame, systems: DataFrame) -> DataFrame:
    """Each event with the state of the system it names: none, unknown, retired or ok. Systems are a small dimension."""
    found = events.join(systems.select("org_id", "system_id", "lifecycle_status"), ["org_id", "system_id"], "left")
    state = F.when(F.col("system_id").isNull(), "none").when(F.col("lifecycle_status").isNull(), "unknown").when(F.col("lifecycle_status") == "retired", "retired").otherwise("ok")
    return found.withColumn("attribution", state).drop("lifecycle_status")


def notice_wanted(mode: Column, notify: Column) -> Column:
    return (notify == "immediate") | ((mode == "block") & (notify == "digest"))


def email_allowed(mode: Column, notify: Column) -> Column:
    return notice_wanted(mode, notify) & (mode != "monitor")


def clashing_names(df: DataFrame, key: str, name: str, live: Column, exclude: object = None) -> DataFrame:
    """Names that more than one live row of a tenant has; retired names are free again."""
    rows = df.where(live)
    if exclude is not None:
        rows = rows.where(F.col("id") != exclude)
    return rows.groupBy(key, F.lower(name).alias(name)).agg(F.count("*").alias("n")).where("n > 1")
