"""What is dealt over the cluster: rows once, narrow, and without the texts that are hashed."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.operators import chain as C
from tallymark.operators import ranges
from tallymark.schemas import GENESIS
from tallymark.sources import exports as X
from tallymark.sources import sinks as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_along_keeps_columns_and_deals_once(spark):
    rows = [(n % 3, n, f"x{n}") for n in range(60)]
    df = spark.createDataFrame(rows, "org_id long, at long, more string")
    numbered = df.withColumn("seq", F.row_number().over(Window.partitionBy("org_id").orderBy("at")).cast("long"))
    done = C.fold_along(numbered, order="at", texts=lambda r: r.withColumn("blob", F.concat("more", F.lit("!"))))
    assert len(re.findall(r"Exchange \w+partitioning", plan(done))) == 1 and "Join" not in plan(done)
    heads: dict[int, str] = {}
    for r in sorted(done.collect(), key=lambda r: r["at"]):
        before = heads.get(r["org_id"], GENESIS)
        heads[r["org_id"]] = hashlib.sha256(f"x{r['at']}!{before}".encode()).hexdigest()
        assert (r["seq"], r["more"], r["prev_hash"], r["chain_hash"]) == (r["at"] // 3 + 1, f"x{r['at']}", before, heads[r["org_id"]])


def test_verification_leaves_texts_where_they_are(spark):
    chain = spark.createDataFrame([(1, 1, "a", GENESIS, "h")], "org_id long, seq long, blob string, prev_hash string, chain_hash string").repartition(2)
    for df in (C.verify(chain), C.checked(chain).select("seq", "problem")):
        text = plan(df)
        below = text[text.rindex("Exchange hashpartitioning(org_id", 0, text.index("Union")) : text.index("Union")]
        assert "blob" not in below and "blob" not in text[: text.index("Union")]


def test_previous_with_sums_and_columns_of_the_key(spark):
    rows = [(k, n, n * 7 % 5) for k in (1, 2, None) for n in range(1, 40) if (n + (k or 0)) % 9]
    beside = spark.createDataFrame([(1, 12)], "k long, upto long")
    got = ranges.previous(spark.createDataFrame(rows, "k long, seq long, v long"), ["k"], "seq", ["seq", "v"], 4, ("v",), beside).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [x for x in rows if x[0] == r["k"] and x[1] < r["seq"]]
        assert (r["before_seq"], r["before_v"]) == ((before[-1][1], before[-1][2]) if before else (None, None))
        assert (r["total_v"], r["upto"]) == (sum(x[2] for x in before), 12 if r["k"] == 1 else None)


def test_pages_are_dealt_by_one_pass(spark):
    rows = spark.createDataFrame([(1, n, "p", "c", 10 * n) for n in range(1, 50)], "org_id long, seq long, prev_hash string, chain_hash string, size long")
    got = sorted(K.paged(rows, most_rows=7, most_bytes=900, size=F.col("size"), width=8).collect(), key=lambda r: r["seq"])
    assert [(r["part"]["by_rows"], r["part"]["by_bytes"]) for r in got] == [((n - 1) // 7, 10 * (n - 1) * n // 2 // 900) for n in range(1, 50)]
    assert "BroadcastHashJoin" not in plan(K.paged(rows, size=F.col("size")))


def test_one_canonical_form_a_row(spark):
    names = "agent string, client_id string, client_seq long, commitment_alg string, event_id string, event_type string, occurred_at string, org_id long, pii_signals array<string>, policy_tag string, prompt_hash string, response_hash string, seq long, token_count int, verdict_hash string, event_metadata string, chain_version int"
    df = spark.createDataFrame([("a", "c", 1, None, "e", None, "2024-01-01 00:00:00", 1, None, "p", "q", "r", 1, 2, "v", '{"b":"é"}', v) for v in (1, 2, 3, 4, 5, 6)], names)
    done = C.with_blob(df)
    assert len(re.findall(r"put\(", plan(done).split("ArrowEvalPython", 1)[1].split("\n")[0])) == 1
    for r in done.collect():
        v, blob = r["chain_version"], r["blob"]
        assert (blob is None) == (v == 6)
        if 1 < v < 6:
            assert ('"chain_version":%d' % v in blob) == (v >= 3) and ('"verdict_hash":"v"' in blob) == (v >= 4)
            assert ('"2024-01-01T00:00:00+00:00"' in blob) == (v == 5) and '"event_metadata":{"b":"\\u00e9"}' in blob


def test_site_without_a_chain_has_no_published_root(spark, tmp_path):
    from tallymark.plans import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(6)
    events.withColumn("user_id", F.when(F.row_number().over(Window.orderBy("event_id")) <= 2, 1).otherwise(5).cast("long")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["client_id"]: (r["head_seq"], r["anchored_seq"], r["kind"]) for r in QUERIES["staff_anchor_check"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, None, None), 5: (2, 1, None)}


def test_documents_are_read_and_written_where_their_rows_are(spark, tmp_path):
    """Pages are compressed, made where their rows were dealt, and read without windows over their pieces."""
    rows = spark.createDataFrame([(k, n, GENESIS if n == 1 else f"h{n - 1}", f"h{n}", 10) for k in (1, 2) for n in range(1, 30)], "org_id long, seq long, prev_hash string, chain_hash string, size long")
    paged = K.paged(rows, most_rows=7, size=F.col("size"))
    K.write_pages(paged, K.page_manifest(paged, most_rows=7), str(tmp_path / "pages"), shape=lambda r: r.withColumn("agent", F.lit("a}{")), codec="gzip")
    assert len(list((tmp_path / "pages").glob("*/*/*.txt.gz"))) == 10
    units = X.export_units(spark, str(tmp_path / "pages"))
    assert "MapInArrow" in plan(units) and not re.search(r"Window \[.*\[file#\d+, split#", plan(units))
    got = X.export_rows(units, X.export_headers(units))
    assert re.search(r"BroadcastHashJoin \[file#\d+, rank#", plan(got))
    assert {(r["org_id"], r["seq"], r["chain_hash"], r["agent"]) for r in got.collect()} == {(str(k), n, f"h{n}", "a}{") for k in (1, 2) for n in range(1, 30)}


def test_rows_made_for_export_keep_what_they_were_dealt_by(spark):
    from tallymark.plans import evidence as E

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("org_id", F.col("user_id") % 8).withColumn("seq", F.col("event_id"))
    done = E.exported(events.repartition("org_id")).groupBy("org_id").count()
    assert len(re.findall(r"Exchange hashpartitioning", plan(done))) == 1


def test_plain_rows_have_their_canonical_form_natively(spark, monkeypatch):
    """Every kind of text: what Python gives of a whole event is what is put together; only documents and other than plain texts go through it."""
    kinds = ["plain", 'q"u\\o', "tab\t\n", "\\u0041", "\x01", "\x7f", "é", "\U0001f600", "", None, "a/b", "\u2028", "\\", '"\\u"']
    times = ["2024-02-03 04:05:06", "2024-02-03T04:05:06.5", "2024-02-30 00:00:00", "2024-01-31 23:59:59.000", "0000-01-01 00:00:00", "2024-02-03 24:00:00", "2024-02-03T04:05:06Z", "no time", None, "2024-02-03 04:05:06.1234567", " 2024-02-03 04:05:06"]
    documents = [None, "{}", '{"b": "é", "a": [1, 2.50]}', "null", '"x"', "[]"]
    names = "agent string, client_id string, client_seq long, commitment_alg string, event_id string, event_type string, occurred_at string, org_id long, pii_signals array<string>, policy_tag string, prompt_hash string, response_hash string, seq long, token_count double, verdict_hash string, event_metadata string, chain_version int"
    rows = [(t, "c", k, None, "e", None, times[k % len(times)], 1, [t, None] if k % 3 else None, "p", "q", "r", k, 1e7 + k, "v", documents[k % len(documents)], 2 + k % 4) for k, t in enumerate(kinds * 12)]
    for kind in ("double", "int"):
        df = spark.createDataFrame(rows, names).withColumn("token_count", F.col("token_count").cast(kind))
        got = {r["seq"]: r["blob"] for r in C.with_blob(df).collect()}
        for r in df.collect():
            at = r["occurred_at"]
            if r["chain_version"] == 5:
                at = {"2024-02-03 04:05:06": "2024-02-03T04:05:06+00:00", "2024-02-03T04:05:06.5": "2024-02-03T04:05:06.500000+00:00", "2024-01-31 23:59:59.000": "2024-01-31T23:59:59+00:00", "2024-02-03T04:05:06Z": "2024-02-03T04:05:06+00:00", " 2024-02-03 04:05:06": "2024-02-03T04:05:06+00:00", "2024-02-03 04:05:06.1234567": "2024-02-03T04:05:06.123456+00:00"}.get(at, at)
            event = {c: r[c] for c in C.EVENT_FIELDS} | {"org_id": "1", "occurred_at": at, "event_type": "interaction", "commitment_alg": "sha256-legacy", "event_metadata": r["event_metadata"] and json.loads(r["event_metadata"])}
            event |= {"chain_version": r["chain_version"]} if r["chain_version"] >= 3 else {}
            event |= {"verdict_hash": "v"} if r["chain_version"] >= 4 else {}
            assert got[r["seq"]] == json.dumps(event, sort_keys=True, separators=(",", ":"))

    @F.pandas_udf("string")
    def put(event, document):
        if event.notna().any():
            raise ValueError("Python was asked for")
        return event

    monkeypatch.setattr(C, "canonical_event", put)
    assert C.with_blob(spark.createDataFrame([r for r in rows if r[0] == "plain" and r[15] is None], names).withColumn("token_count", F.lit(1))).where("blob IS NULL").count() == 0


def test_clients_numbers_are_dealt_by_rows(spark, monkeypatch):
    """Tasks grow in number with the events, and no later step deals them together again."""
    from tallymark.operators import windows as W
    from tallymark.plans import evidence as E

    monkeypatch.setattr(E, "TASK_ROWS", 100)
    text = plan(W.sequence_gaps(E.sent(spark, "/root/testdata/sf0.001")))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert set(re.findall(r"Exchange hashpartitioning\((.*)\), (\w+)", text)) and all(int(n) == -(-events // 100) for n in re.findall(r"Exchange hashpartitioning\(user_id#\d+L, (\d+)\)", text))
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L, \d+\), REPARTITION_BY_NUM", text)
