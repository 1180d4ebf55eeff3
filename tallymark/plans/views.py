"""The audit ledger projected from the driver's tables, and the same projection as DuckDB SQL.

An event is a ledger row: the tenant is ``user_id % 8``, the client the user, the verdict a JSON document made from the
event's type and number. ``seq`` is the event's number: increasing within a tenant; where a gapless number is needed
the queries number rows by client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(table(spark, sf_dir, "events"))


def projected(e: DataFrame, *more: str) -> DataFrame:
    """Events, also those of a stream, as ledger rows; ``more`` are columns that go along, such as a number made before."""
    n = F.col("event_id")
    status = F.when(n % 19 == 0, "pending").when(n % 23 == 0, "failed").when(n % 29 == 0, "in_progress").otherwise("graded")
    kind = F.when(n % 11 == 0, "blocked").when(n % 13 == 0, "redacted").when(n % 17 == 0, "response_blocked").otherwise("interaction")
    decision = F.when(n % 37 == 0, "unknown").when(F.col("event_type") == "error", "breach").when(n % 31 == 0, "human_review").otherwise("clean")
    reason = F.when(n % 37 == 0, "evaluator_unavailable:timeout").otherwise(F.concat(F.lit("seen "), F.col("event_type")))
    score = F.get_json_object("props", "$.k").cast("int")
    verdict = F.to_json(F.struct((decision == "breach").alias("policy_breach"), reason.alias("reason"), score.alias("risk_score"), decision.alias("decision"), F.when(n % 2 == 0, "ai").otherwise("rules").alias("graded_by")))
    return e.select(
        "event_id",
        n.alias("seq"),
        (F.col("user_id") % 8).alias("org_id"),
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("policy_tag"),
        F.when(n % 5 == 0, None).when(n % 7 == 0, "unattributed").otherwise(F.concat(F.lit("agent-"), (n % 20).cast("string"))).alias("agent"),
        F.floor("value").cast("int").alias("token_count"),
        kind.alias("event_type"),
        status.alias("grading_status"),
        F.when(status == "graded", verdict).alias("gemini_verdict"),
        F.sha2(n.cast("string"), 256).alias("prompt_hash"),
        F.sha2(F.concat(F.lit("r"), n.cast("string")), 256).alias("response_hash"),
        *more,
    )


#: The same projection; verdict fields are columns. Begins a WITH list.
LEDGER_SQL = """
    l0 AS (SELECT event_id, event_id AS n, user_id, ts, event_type AS et, value,
                  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS score FROM events),
    l1 AS (SELECT *, CASE WHEN n % 19 = 0 THEN 'pending' WHEN n % 23 = 0 THEN 'failed' WHEN n % 29 = 0 THEN 'in_progress' ELSE 'graded' END AS grading_status,
                  CASE WHEN n % 37 = 0 THEN 'unknown' WHEN et = 'error' THEN 'breach' WHEN n % 31 = 0 THEN 'human_review' ELSE 'clean' END AS d FROM l0),
    l AS (SELECT event_id, event_id AS seq, user_id % 8 AS org_id, user_id AS client_id, ts AS created_at, et AS policy_tag,
                 CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN 'unattributed' ELSE 'agent-' || CAST(n % 20 AS VARCHAR) END AS agent,
                 CAST(floor(value) AS INTEGER) AS token_count,
                 CASE WHEN n % 11 = 0 THEN 'blocked' WHEN n % 13 = 0 THEN 'redacted' WHEN n % 17 = 0 THEN 'response_blocked' ELSE 'interaction' END AS event_type,
                 grading_status, grading_status = 'graded' AS graded,
                 CASE WHEN grading_status = 'graded' THEN d = 'breach' END AS breach,
                 CASE WHEN grading_status = 'graded' THEN d END AS decision,
                 CASE WHEN grading_status = 'graded' THEN CASE WHEN n % 37 = 0 THEN 'evaluator_unavailable:timeout' ELSE 'seen ' || et END END AS reason,
                 CASE WHEN grading_status = 'graded' THEN score END AS risk,
                 CASE WHEN grading_status = 'graded' THEN CASE WHEN n % 2 = 0 THEN 'ai' ELSE 'rules' END END AS graded_by,
                 sha256(CAST(n AS VARCHAR)) AS prompt_hash, sha256('r' || CAST(n AS VARCHAR)) AS response_hash
          FROM l1)
"""


def over_ledger(select: str, *more: str) -> str:
    """A query over the projection, with further common tables before it."""
    return "WITH RECURSIVE " + ", ".join([LEDGER_SQL, *more]) + " " + select


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("org_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("org_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan_tier"), F.col("c_nationkey").alias("nation_id"))


ORGS_SQL = """
    orgs AS (SELECT c_custkey AS org_id, c_name AS name, c_mktsegment AS plan_tier, c_nationkey AS nation_id FROM customer),
    inv AS (SELECT o_orderkey AS invoice_id, o_custkey AS org_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
                   o_orderdate AS created_at, o_orderstatus AS status FROM orders)
"""


def over_orgs(select: str, *more: str) -> str:
    return "WITH " + ", ".join([ORGS_SQL, *more]) + " " + select
