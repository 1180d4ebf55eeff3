"""Queries of the ledger's dashboards, reports and rollups, each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, nested, numbers
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import paging as T
from ..operators import predicates as P
from ..operators import sets as U
from ..operators import windows as W
from ..sources.ledger import browse, public_columns
from ..sources.registry import entry, overview
from ..sources.sinks import export_projection, upsert_days
from .registry import query
from .texts import _shared
from .views import invoices, ledger, organisations, over_ledger, over_orgs, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(over_ledger("""SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS logs_count, CAST(sum(token_count) AS BIGINT) AS tokens_sum,
    count(*) FILTER (WHERE breach) AS breach_count, count(*) FILTER (WHERE graded) AS graded_count,
    count(*) FILTER (WHERE grading_status = 'failed') AS failed_count,
    count(*) FILTER (WHERE grading_status IN ('pending', 'in_progress')) AS pending_count FROM l GROUP BY 1, 2"""))
def usage_daily(spark, sf):
    return A.usage_daily(ledger(spark, sf))


@query(over_ledger("""SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS logs_count, CAST(sum(token_count) AS BIGINT) AS tokens_sum,
    count(*) FILTER (WHERE breach) AS breach_count FROM l WHERE created_at >= TIMESTAMP '2024-01-18' GROUP BY 1, 2"""))
def rollup_pass(spark, sf):
    return A.usage_daily(A.whole_days(ledger(spark, sf), "2024-01-20 15:30:00")).select("org_id", "day", "logs_count", "tokens_sum", "breach_count")


@query(over_ledger("""SELECT org_id, strftime(created_at, '%Y-%m') AS month, count(DISTINCT client_id) AS clients, TRUE AS close FROM l GROUP BY 1, 2 UNION ALL SELECT NULL, 'all', count(DISTINCT event_id // 3), TRUE FROM l"""))
def distinct_clients(spark, sf):
    """Distinct clients by month from a stored rollup of sketches by day, held against the exact number; and over all tenants, more of them."""
    rows = ledger(spark, sf)
    path = f"{_shared(spark)}/sketches-{uuid.uuid4().hex}"
    upsert_days(A.client_sketches(rows.select("org_id", "created_at", "client_id")), f"{path}/by-client")
    upsert_days(A.client_sketches(rows.select("org_id", "created_at", F.floor(F.col("event_id") / 3).alias("client_id"))), f"{path}/by-third")
    month = F.date_format("day", "yyyy-MM").alias("month")
    exact = rows.groupBy("org_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count_distinct("client_id").alias("clients"))
    mine = exact.join(A.clients_over(spark.read.parquet(f"{path}/by-client"), "org_id", month), ["org_id", "month"])
    thirds = rows.agg(F.count_distinct(F.floor(F.col("event_id") / 3)).alias("clients")).select(F.lit(None).cast("long").alias("org_id"), F.lit("all").alias("month"), "clients")
    both = mine.unionByName(thirds.crossJoin(A.clients_over(spark.read.parquet(f"{path}/by-third"))))  # two single rows
    return both.select("org_id", "month", "clients", (F.abs(F.col("estimate") - F.col("clients")) <= 3 * F.col("error")).alias("close"))


@query(over_ledger("""SELECT event_id, policy_tag, agent, created_at FROM l WHERE org_id = 3 AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
    AND policy_tag = 'error' AND graded AND breach"""))
def ledger_filter(spark, sf):
    rows = ledger(spark, sf).where(F.col("org_id") == 3)
    return P.ledger_filter(rows, tag="error", since="2024-01-05", until="2024-01-20", verdict="breach").select("event_id", "policy_tag", "agent", "created_at")


@query(over_ledger("""SELECT event_id, agent FROM l WHERE prompt_hash ILIKE '%abc%' OR policy_tag ILIKE '%abc%' OR coalesce(agent, '') ILIKE '%abc%' ORDER BY event_id DESC LIMIT 50"""))
def ledger_search(spark, sf):
    rows = P.ledger_filter(ledger(spark, sf).withColumn("chain_hash", F.lit("")), q="abc")
    return T.offset_page(rows, 1, 50, F.col("seq").desc())[0].select("event_id", "agent")


@query(over_ledger("""SELECT k AS kind, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT graded THEN 'pending' END, CASE WHEN graded AND breach THEN 'breach' END,
    CASE WHEN graded AND decision = 'clean' AND NOT breach THEN 'clean' END, CASE WHEN graded AND decision = 'human_review' THEN 'human_review' END,
    CASE WHEN graded AND decision = 'unknown' THEN 'unknown' END, CASE WHEN event_type IN ('blocked', 'response_blocked') THEN 'blocked' END,
    CASE WHEN event_type = 'redacted' THEN 'redacted' END]) AS k FROM l) WHERE k IS NOT NULL GROUP BY 1"""))
def verdict_filters(spark, sf):
    kinds = ("pending", "breach", "clean", "human_review", "unknown", "blocked", "redacted")
    found = F.array_compact(F.array(*[F.when(P.verdict_filter(k), F.lit(k)) for k in kinds]))
    return ledger(spark, sf).select(F.explode(found).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(over_ledger("""SELECT CASE WHEN event_type IN ('blocked', 'response_blocked') THEN 'blocked' WHEN event_type = 'redacted' THEN 'redacted'
    WHEN decision = 'unknown' THEN 'unknown' WHEN breach THEN 'breach' WHEN decision = 'human_review' THEN 'human review' WHEN graded THEN 'safe'
    WHEN grading_status = 'failed' THEN 'flag' ELSE 'pending' END AS label, count(*) AS n FROM l GROUP BY 1"""))
def verdict_label(spark, sf):
    return ledger(spark, sf).groupBy(P.verdict_label().alias("label")).agg(F.count("*").alias("n"))


STATS_SQL = """SELECT count(*) AS total_logged, count(*) FILTER (WHERE graded AND breach) AS breaches, count(*) FILTER (WHERE graded AND decision <> 'unknown') AS known_graded,
    count(*) FILTER (WHERE graded AND decision = 'unknown') AS evaluator_unknown, count(*) FILTER (WHERE decision = 'human_review') AS human_review,
    count(*) FILTER (WHERE graded_by = 'ai') AS graded_by_ai, count(*) FILTER (WHERE graded_by = 'rules') AS graded_by_rules,
    count(*) FILTER (WHERE event_type = 'blocked') AS blocked, count(*) FILTER (WHERE event_type = 'response_blocked') AS response_blocked,
    count(*) FILTER (WHERE event_type = 'redacted') AS redacted, count(*) FILTER (WHERE grading_status = 'pending') AS status_pending,
    count(*) FILTER (WHERE grading_status = 'in_progress') AS status_in_progress, count(*) FILTER (WHERE graded) AS status_graded,
    count(*) FILTER (WHERE grading_status = 'failed') AS status_failed, CAST(sum(token_count) AS BIGINT) AS tokens FROM l"""


@query(over_ledger(f"SELECT *, round_even(100.0 * (known_graded - breaches - human_review) / known_graded, 1) AS clean_rate FROM ({STATS_SQL})"))
def stats_tiles(spark, sf):
    return A.ledger_stats(ledger(spark, sf))


@query(over_ledger(f"""SELECT greatest(status_graded - breaches - blocked - response_blocked - redacted - evaluator_unknown - human_review, 0) AS clean, breaches,
    blocked + response_blocked AS blocked, redacted, evaluator_unknown, status_pending + status_in_progress AS pending, status_failed AS failed FROM ({STATS_SQL})"""))
def verdict_mix(spark, sf):
    return A.verdict_mix(A.ledger_stats(ledger(spark, sf)))


@query(over_ledger("SELECT policy_tag, count(*) AS breaches FROM l WHERE breach GROUP BY 1"))
def threat_top_policies(spark, sf):
    return A.by_tag(ledger(spark, sf))


@query(over_ledger("SELECT event_id, org_id, risk FROM l WHERE breach AND risk >= 50 ORDER BY seq DESC LIMIT 10"))
def recent_high_risk(spark, sf):
    return T.recent_high_risk(ledger(spark, sf)).select("event_id", "org_id", P.risk().alias("risk"))


@query(over_ledger("""SELECT coalesce(agent, 'unattributed') AS agent, breaches, avg_risk FROM (SELECT agent, count(*) AS breaches, CAST(trunc(avg(risk)) AS INTEGER) AS avg_risk
    FROM l WHERE breach GROUP BY agent ORDER BY breaches DESC, agent NULLS LAST LIMIT 12)"""))
def threats_by_agent(spark, sf):
    return A.by_agent(ledger(spark, sf))


@query(over_ledger("""SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (WHERE risk >= 70) AS high, count(*) FILTER (WHERE risk >= 40 AND risk < 70) AS medium,
    count(*) FILTER (WHERE risk < 40) AS low, count(*) AS total FROM l WHERE breach GROUP BY 1"""))
def threat_timeseries_bands(spark, sf):
    return A.bands_by_day(ledger(spark, sf))


@query(over_ledger("""SELECT CAST(d.day AS DATE) AS day, coalesce(v.n, 0) AS value, t.total, t.prev_total, CASE WHEN prev_total <> 0 THEN round_even(100.0 * (total - prev_total) / prev_total, 1) END AS delta_pct
    FROM (SELECT unnest(generate_series(DATE '2024-01-16', DATE '2024-01-31', INTERVAL 1 DAY)) AS day) d
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM l GROUP BY 1) v ON v.day = d.day
    CROSS JOIN (SELECT count(*) FILTER (WHERE CAST(created_at AS DATE) >= DATE '2024-01-16') AS total, count(*) FILTER (WHERE CAST(created_at AS DATE) < DATE '2024-01-16') AS prev_total
                FROM l WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') t"""))
def metric_timeseries_delta(spark, sf):
    return A.metric_with_delta(ledger(spark, sf), "created_at", F.count("*"), "2024-01-16", "2024-01-31", "2024-01-01")


@query("""SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click,
    CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS signup, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1""")
def traffic_series(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("site"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("ts").alias("created_at"))
    return A.traffic_series(t, ("view", "click", "signup"))


@query(over_ledger("""SELECT s.grading_status, coalesce(n, 0) AS n, place FROM (VALUES ('pending', 0), ('in_progress', 1), ('graded', 2), ('failed', 3), ('dead', 4)) s(grading_status, place)
    LEFT JOIN (SELECT grading_status, count(*) AS n FROM l GROUP BY 1) USING (grading_status)"""))
def status_histogram(spark, sf):
    return A.histogram(ledger(spark, sf), "grading_status", ("pending", "in_progress", "graded", "failed", "dead"))


@query(over_orgs("SELECT coalesce(plan_tier, 'none') AS plan, count(*) AS n, coalesce(list_position(['BUILDING', 'MACHINERY', 'none'], coalesce(plan_tier, 'none')), 4) AS place FROM orgs GROUP BY ALL"))
def plan_mix(spark, sf):
    return A.plan_mix(organisations(spark, sf), ("BUILDING", "MACHINERY", "none"))


@query(over_orgs("SELECT strftime(created_at, '%Y-%m') AS month, " + ", ".join(f"CAST(coalesce(sum(amount_cents) FILTER (WHERE plan_tier = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in SEGMENTS) + " FROM inv JOIN orgs USING (org_id) GROUP BY 1"))
def revenue_by_month_plan(spark, sf):
    return A.revenue_by_month_plan(invoices(spark, sf), organisations(spark, sf), SEGMENTS)


@query(over_orgs("SELECT org_id, CAST(sum(amount_cents) AS BIGINT) AS total, any_value(name) AS name FROM inv LEFT JOIN orgs USING (org_id) GROUP BY org_id ORDER BY total DESC, org_id LIMIT 20"))
def top_orgs_named(spark, sf):
    return T.top_by(invoices(spark, sf), "org_id", F.sum("amount_cents"), organisations(spark, sf), 20, "name")


def logins(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("ua-"), (F.col("event_id") % 3).cast("string")).alias("user_agent"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type <> 'error') AS successes FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 5")
def login_watchlist(spark, sf):
    return A.login_watch(logins(spark, sf))


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def logins_by_day(spark, sf):
    return A.logins_by_day(logins(spark, sf))


@query("""SELECT id, user_id, user_agent FROM (SELECT event_id AS id, user_id, 'ua-' || CAST(event_id % 3 AS VARCHAR) AS user_agent,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS b
    FROM events WHERE event_type <> 'error') WHERE a > 1 AND b = 1""")
def new_device(spark, sf):
    return W.new_devices(logins(spark, sf)).select("id", "user_id", "user_agent")


@query("""SELECT o_orderkey AS id, o_orderstatus AS action, c_name AS actor, n_name AS org FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderpriority ILIKE '1-%'""")
def audit_view_outer(spark, sf):
    actions = table(spark, sf, "orders").where(P.starts_like("o_orderpriority", "1-")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").alias("c_custkey"))
    staff = table(spark, sf, "customer").where("c_acctbal > 0").withColumnRenamed("c_nationkey", "n_nationkey")
    seen = J.with_labels(actions, staff, "c_custkey", "c_name", "n_nationkey")
    return J.with_labels(seen, table(spark, sf, "nation"), "n_nationkey", "n_name").select("id", "action", F.col("c_name").alias("actor"), F.col("n_name").alias("org"))


@query(over_orgs("SELECT org_id, name, (SELECT count(*) FROM inv i WHERE i.org_id = o.org_id) AS n FROM orgs o"))
def invoice_counts(spark, sf):
    return J.with_counts(organisations(spark, sf).select("org_id", "name"), invoices(spark, sf), "org_id")


@query(over_orgs("SELECT org_id, name FROM orgs o WHERE EXISTS (SELECT 1 FROM inv i WHERE i.org_id = o.org_id)"))
def orgs_with_events(spark, sf):
    return J.that_have(organisations(spark, sf), invoices(spark, sf), "org_id").select("org_id", "name")


@query(over_orgs("SELECT org_id, name FROM orgs o WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.org_id = o.org_id AND i.status = 'P')"))
def orphan_rollups(spark, sf):
    """Tenants without an invoice in processing: every tenant has some other one."""
    return J.that_lack(organisations(spark, sf), invoices(spark, sf).where("status = 'P'"), "org_id").select("org_id", "name")


@query(over_orgs("SELECT org_id FROM orgs WHERE plan_tier = 'BUILDING' INTERSECT SELECT org_id FROM inv"))
def key_intersection(spark, sf):
    return U.both(organisations(spark, sf).where("plan_tier = 'BUILDING'"), invoices(spark, sf), "org_id")


@query(over_orgs("SELECT org_id FROM orgs WHERE plan_tier = 'BUILDING' UNION SELECT org_id FROM inv WHERE status = 'F'"))
def key_union(spark, sf):
    return U.either(organisations(spark, sf).where("plan_tier = 'BUILDING'"), invoices(spark, sf).where("status = 'F'"), "org_id")


@query(over_orgs("SELECT o.org_id, o.name, (SELECT max(created_at) FROM inv i WHERE i.org_id = o.org_id) AS last_event FROM orgs o"))
def last_event_per_org(spark, sf):
    return J.latest_of(organisations(spark, sf).select("org_id", "name"), invoices(spark, sf), "org_id", "created_at", "last_event")


@query("SELECT o_orderkey, (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey LIMIT 1) AS l_partkey FROM orders")
def first_fact_per_row(spark, sf):
    facts = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.first_fact(table(spark, sf, "orders").select("o_orderkey"), facts, "o_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")


def anchors(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"), F.col("o_orderdate").alias("anchored_at"))


ANCHORS_SQL = "a AS (SELECT o_orderkey AS id, o_custkey AS org_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, o_orderdate AS anchored_at FROM orders)"


@query(f"WITH {ANCHORS_SQL} SELECT * FROM (SELECT DISTINCT ON (org_id) * FROM a ORDER BY org_id, anchored_at DESC, id DESC) WHERE status = 'failed'")
def latest_anchor_failed(spark, sf):
    return W.latest_failed(anchors(spark, sf))


@query(f"WITH {ANCHORS_SQL} SELECT DISTINCT ON (org_id) * FROM a WHERE status = 'confirmed' ORDER BY org_id, anchored_at DESC, id DESC")
def latest_anchor_confirmed(spark, sf):
    return W.latest_confirmed(anchors(spark, sf))


@query(over_ledger("SELECT org_id, isoyear(created_at) || '-W' || lpad(CAST(week(created_at) AS VARCHAR), 2, '0') AS week, count(*) AS events, count(*) FILTER (WHERE breach) AS breaches, CAST(sum(token_count) AS BIGINT) AS tokens FROM l GROUP BY 1, 2"))
def iso_week_digest(spark, sf):
    return A.week_digest(ledger(spark, sf))


@query(over_ledger("SELECT policy_tag, count(*) AS events, count(*) FILTER (WHERE breach) AS breaches, CAST(round_even(CAST(sum(token_count) AS DOUBLE) / count(*), 0) AS BIGINT) AS avg_tokens FROM l GROUP BY 1"))
def passport_policy_table(spark, sf):
    return A.passport_policies(ledger(spark, sf))


@query(over_ledger("""SELECT *, round_even(100.0 * (total_events - breach_events - human_review_events) / total_events, 1) AS compliance_rate FROM (SELECT count(*) AS total_events, count(*) FILTER (WHERE breach) AS breach_events,
    count(*) FILTER (WHERE event_type = 'blocked') AS blocked_events, count(*) FILTER (WHERE event_type = 'redacted') AS redacted_events, count(*) FILTER (WHERE event_type = 'response_blocked') AS response_blocked_events,
    count(*) FILTER (WHERE decision = 'unknown') AS unknown_events, count(*) FILTER (WHERE decision = 'human_review') AS human_review_events FROM l)"""))
def passport_totals(spark, sf):
    return A.passport_totals(ledger(spark, sf))


@query(over_ledger("""SELECT rule, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'blocked' THEN ['secret.key', 'response_scan.degraded'] WHEN 'redacted' THEN ['pii.email', 'secret.key'] ELSE ['response_scan.unreadable'] END) AS rule
    FROM l WHERE event_type <> 'interaction') WHERE NOT starts_with(rule, 'response_scan.') GROUP BY 1"""))
def passport_rules(spark, sf):
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rules = F.when(F.col("event_type") == "blocked", words("secret.key", "response_scan.degraded")).when(F.col("event_type") == "redacted", words("pii.email", "secret.key")).otherwise(words("response_scan.unreadable"))
    rows = ledger(spark, sf).where(F.col("event_type").isin(*P.ENFORCED)).withColumn("policy_rules", rules)
    return nested.enforced_rules(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(over_ledger("""SELECT q.org_id, q.monthly_log_quota, coalesce(u.used, 0) AS used, greatest(q.monthly_log_quota - coalesce(u.used, 0), 0) AS remaining, round_even(100.0 * coalesce(u.used, 0) / q.monthly_log_quota, 1) AS pct
    FROM (SELECT range AS org_id, 300 + 100 * range AS monthly_log_quota FROM range(8)) q LEFT JOIN (SELECT org_id, count(*) AS used FROM l WHERE created_at >= TIMESTAMP '2024-01-15' GROUP BY 1) u USING (org_id)"""))
def quota_meter(spark, sf):
    used = ledger(spark, sf).where("created_at >= timestamp '2024-01-15'").groupBy("org_id").agg(F.count("*").alias("used"))
    return A.quota(used, spark.range(8).select(F.col("id").alias("org_id"), (300 + 100 * F.col("id")).alias("monthly_log_quota")))


@query(over_ledger("SELECT org_id, count(*) FILTER (WHERE graded) AS recent_graded, count(*) FILTER (WHERE graded AND breach) AS recent_breaches, round_even(100.0 * count(*) FILTER (WHERE graded AND breach) / count(*) FILTER (WHERE graded), 1) AS breach_rate_pct FROM l GROUP BY 1"))
def org_history(spark, sf):
    return A.history(ledger(spark, sf))


@query(over_ledger("""SELECT org_id, day, n, base, CASE WHEN base > 0 THEN CAST(round_even((n - base) / base * 100, 0) AS INTEGER) END AS delta_pct FROM (SELECT *, avg(n) OVER (PARTITION BY org_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base
    FROM (SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM l GROUP BY 1, 2))"""))
def today_against_week(spark, sf):
    days = ledger(spark, sf).groupBy("org_id", dates.utc_day("created_at").alias("day")).agg(F.count("*").alias("n"))
    return W.against_week(days, "org_id", "n")


@query(over_ledger("SELECT event_id, org_id FROM l WHERE breach AND seq > 500 ORDER BY seq LIMIT 100"))
def breach_poll(spark, sf):
    return T.breaches_since(ledger(spark, sf), 500, 100).select("event_id", "org_id")


@query(over_ledger("SELECT event_id FROM l WHERE org_id = 2 AND seq > 300 ORDER BY seq LIMIT 51"))
def keyset_page(spark, sf):
    return T.keyset_page(ledger(spark, sf).where(F.col("org_id") == 2), 300, 50).select("event_id")


@query(over_ledger("""SELECT kind, ref, created_at FROM (SELECT 'ledger' AS kind, event_id AS ref, created_at FROM l WHERE breach UNION ALL SELECT 'login', event_id, ts FROM events WHERE event_type = 'signup')
    ORDER BY created_at DESC, kind, ref LIMIT 40"""))
def merged_feed(spark, sf):
    one = ledger(spark, sf).where(P.is_breach()).select(F.lit("ledger").alias("kind"), F.col("event_id").alias("ref"), "created_at", "policy_tag")
    two = table(spark, sf, "events").where("event_type = 'signup'").select(F.lit("login").alias("kind"), F.col("event_id").alias("ref"), F.col("ts").alias("created_at"))
    return T.merged_feed(one, two, "created_at", 40).select("kind", "ref", "created_at")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%7%' ORDER BY c_custkey DESC LIMIT 25 OFFSET 25")
def table_browser(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("x").alias("key_hash"))
    return browse(df, ["c_mktsegment"], {"c_mktsegment": "BUILDING"}, ["c_name"], "7", "c_custkey", 2, 25)[0]


#: The given tables as a registry: key, searched and filterable columns; and a question to each.
REGISTRY = {
    "region": entry("r_regionkey", "r_name", "r_name"), "nation": entry("n_nationkey", "n_name", "n_regionkey"), "customer": entry("c_custkey", "c_name c_mktsegment", "c_mktsegment c_nationkey"), "supplier": entry("s_suppkey", "s_name", "s_nationkey"),
    "part": entry("p_partkey", "p_name p_type", "p_brand p_size"), "orders": entry("o_orderkey", "o_orderpriority", "o_orderstatus o_custkey"), "lineitem": entry("l_orderkey", "", "l_returnflag l_linestatus"), "events": entry("event_id", "event_type", "user_id event_type"),
    "documents": entry("doc_id", "source lang", "lang source"), "embeddings": entry("vec_id", "", "label"), "pages": entry("page_id", "url", ""), "benchmark": entry("item_id", "text", ""), "labels": entry("doc_id", "", "quality toxic"), "conversations": entry("conv_id", "role", "role turn"),
}
ASKED = {
    "region": {"q": "A"}, "nation": {"filters": {"n_regionkey": "2", "n_name": "ignored"}}, "customer": {"filters": {"c_mktsegment": "BUILDING"}, "q": "7", "page": 2, "limit": 25}, "supplier": {"q": "1", "limit": 10}, "part": {"filters": {"p_size": "7"}},
    "orders": {"filters": {"o_orderstatus": "F"}, "page": 3, "limit": 200}, "lineitem": {"filters": {"l_returnflag": "R", "l_orderkey": "1"}, "limit": 200}, "events": {"filters": {"event_type": "click"}, "limit": 100}, "documents": {"filters": {"lang": "fr"}, "q": "src1"},
    "embeddings": {"filters": {"label": "3"}}, "pages": {"q": "1"}, "benchmark": {"q": "e", "page": 2, "limit": 15}, "labels": {"filters": {"toxic": "1"}}, "conversations": {"filters": {"turn": "0"}, "q": "user"},
}


def registry_sql() -> str:
    """What each question comes to in SQL; filters that a table does not allow are left out."""
    parts = []
    for name, how in ASKED.items():
        spec = REGISTRY[name]
        conditions = [f"CAST({c} AS VARCHAR) = '{v}'" for c, v in how.get("filters", {}).items() if c in spec.filterable]
        if how.get("q") and spec.search:
            conditions.append("(" + " OR ".join(f"coalesce(CAST({c} AS VARCHAR), '') ILIKE '%{how['q']}%'" for c in spec.search) + ")")
        where, limit = " AND ".join(conditions) or "TRUE", how.get("limit", 50)
        page = f"SELECT CAST({spec.key} AS VARCHAR) AS key FROM {name} WHERE {where} ORDER BY {spec.key} DESC LIMIT {limit} OFFSET {(how.get('page', 1) - 1) * limit}"
        parts.append(f"SELECT '{name}' AS table_name, total, key FROM (SELECT count(*) AS total FROM {name} WHERE {where}) LEFT JOIN ({page}) ON TRUE")
    return " UNION ALL ".join(parts)


@query(registry_sql())
def table_registry(spark, sf):
    """Every given table through the registry: the honest total and the keys of the page that was asked for."""
    return overview(lambda name: table(spark, sf, name), REGISTRY, ASKED)


@query(over_ledger("""SELECT seq, event_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, policy_tag, agent, token_count, grading_status FROM l WHERE org_id = 1"""))
def export_columns(spark, sf):
    rows = export_projection(public_columns(ledger(spark, sf).where(F.col("org_id") == 1).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))))
    return rows.select("seq", "event_type", "created_at", "policy_tag", "agent", "token_count", "grading_status")


@query(over_ledger("SELECT (SELECT prompt_hash FROM l WHERE org_id = 4 AND seq < 700 ORDER BY seq DESC LIMIT 1) AS prev_chain_hash"))
def predecessor_as_of(spark, sf):
    return J.predecessor_hash(ledger(spark, sf).withColumn("chain_hash", F.col("prompt_hash")), 4, 700)


@query("""SELECT e.event_id, e.user_id, s.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT DISTINCT ON (user_id, ts) * FROM events WHERE event_type = 'signup' ORDER BY user_id, ts, event_id DESC) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def as_of_join(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("last_signup"))
    return J.as_of(left, right, "user_id", "ts", "last_signup").select("event_id", "user_id", "last_signup")


@query("SELECT doc_id, CAST(greatest(floor(length(text) / 4), len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", numbers.estimated_tokens(F.col("text")).alias("tokens"))


@query("""SELECT n_name, regexp_replace(lower(trim(n_name)), '[ -]', '_', 'g') AS tag, 'FA-' || upper(substr(sha256(n_name || '|2024-01-01|2024-01-31|' || CAST(n_nationkey AS VARCHAR)), 1, 12)) AS document_id FROM nation""")
def tags_and_ids(spark, sf):
    from ..functions.hashes import document_id

    n = table(spark, sf, "nation")
    return n.select("n_name", nested.tag_name("n_name").alias("tag"), document_id(F.col("n_name"), F.lit("2024-01-01"), F.lit("2024-01-31"), F.col("n_nationkey").cast("string")).alias("document_id"))


@query("""SELECT CAST(month AS DATE) AS month, count(o_orderkey) AS orders FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS month FROM orders)
    LEFT JOIN orders ON date_trunc('month', o_orderdate) = month AND o_orderkey % 7 = 0 GROUP BY 1""")
def month_starts(spark, sf):
    """Every month that the orders span, with the orders of a few customers: months without any are there too."""
    orders = table(spark, sf, "orders")
    some = orders.where("o_orderkey % 7 = 0").groupBy(F.trunc("o_orderdate", "MONTH").alias("month")).agg(F.count("*").alias("orders"))
    return dates.months_spanned(orders, "o_orderdate").join(some, "month", "left").select("month", F.coalesce("orders", F.lit(0)).alias("orders"))
