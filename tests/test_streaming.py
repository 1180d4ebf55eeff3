"""Streams over file sources, compared with the batch result."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tallymark.operators.chain import verify, with_blob
from tallymark.plans.views import ledger, projected
from tallymark.streaming import ingest as S
from tallymark.streaming import lifecycle as Y

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path, df, n=3):
    """The rows as n files in order, one a micro-batch."""
    path = str(tmp_path / "in")
    for k in range(n):
        df.where(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_each_event_once(spark, tmp_path):
    rows = ledger(spark, SF).select("event_id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("client_id"))
    twice = rows.unionByName(rows.where("event_id % 4 = 0"))
    got = run(S.once(parts(spark, tmp_path, twice, 1)), tmp_path, "append", "once")
    assert got.count() == rows.count() == got.select("event_id").distinct().count()


def test_client_numbers_have_no_gaps(spark, tmp_path):
    rows = ledger(spark, SF).select("event_id", "client_id")
    got = run(S.numbered_by_client(parts(spark, tmp_path, rows)), tmp_path, "append", "numbered")
    bad = got.groupBy("client_id").agg(F.max("client_seq").alias("m"), F.count_distinct("client_seq").alias("n"), F.count("*").alias("c")).where("m <> n OR n <> c")
    assert bad.count() == 0 and got.count() == rows.count()


def test_chained_batches_form_one_chain(spark, tmp_path):
    rows = ledger(spark, SF).select("event_id", "org_id", "prompt_hash", "response_hash", "token_count", "policy_tag", "agent")
    path = str(tmp_path / "chain")
    q = parts(spark, tmp_path, rows).writeStream.foreachBatch(S.chain_writer(spark, path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.parquet(path)
    assert written.count() == rows.count() and written.select("batch").distinct().count() == 3
    assert verify(with_blob(written, (1,))).where("NOT ok").count() == 0
    heads = written.groupBy("org_id").agg(F.max("seq").alias("head_seq"), F.max_by("chain_hash", "seq").alias("head_hash"))
    kept = S.stored_heads(spark, path, 3)
    assert sorted(map(tuple, kept.select(*heads.columns).collect())) == sorted(map(tuple, heads.collect())) and "slot=0" in kept.inputFiles()[0]
    before = {(r.org_id, r.seq): r.chain_hash for r in written.collect()}
    last = written.where("batch = 2").select(*rows.columns)
    again = spark.createDataFrame(last.collect(), last.schema)
    S.chain_writer(spark, path)(again, 2)  # the last batch once more
    assert {(r.org_id, r.seq): r.chain_hash for r in spark.read.parquet(path).collect()} == before


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = ledger(spark, SF).select("event_id", "org_id", F.col("created_at").cast("timestamp").alias("created_at"), "token_count")
    got = run(S.rollup_stream(parts(spark, tmp_path, rows, 1)), tmp_path, "update", "rolled")
    last = got.groupBy("org_id", "day").agg(F.max("logs_count").alias("n"))
    want = rows.groupBy("org_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def files_read(df):
    """How many files the scans of an executed plan read, and whether partitions were pruned at run time."""
    plan, n, text = df._jdf.queryExecution().executedPlan(), 0, df._jdf.queryExecution().executedPlan().toString()
    leaves = (plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in text[:40] else plan).collectLeaves()
    todo = [leaves.apply(k) for k in range(leaves.size())]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            inner = node.plan().collectLeaves()
            todo += [inner.apply(k) for k in range(inner.size())]
        elif node.nodeName().startswith("Scan parquet"):
            n += node.metrics().get("numFiles").get().value()
    return n, "dynamicpruning" in text


def test_a_batch_reads_only_its_days(spark, tmp_path):
    """Forty days are stored and a batch touches two: two days' files are read, and late rows are in their days' totals."""
    at = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    path = str(tmp_path / "ledger")
    rows = lambda pairs: projected(spark.createDataFrame([(k, at(d, k % 24), k % 5, "click", float(k), "{}") for k, d in pairs], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    S.day_writer(path)(rows([(k, k % 40) for k in range(400)]), 0)
    late = rows([(1000, 3), (1001, 3), (1002, 17)])
    for _ in range(2):
        S.day_writer(path)(late, 1)
    stored = spark.read.parquet(path)
    touched = S.touched_rows(stored, late)
    assert touched.count() == 10 + 2 + 10 + 1
    counted = S.touched_rows(stored, late).groupBy().agg(F.sum("token_count"))
    counted.collect()
    n, pruned = files_read(counted)
    assert pruned and 0 < n <= len([f for d in ("2024-01-04", "2024-01-18") for f in Path(path).glob(f"day={d}/*/*.parquet")]) + 3
    table = str(tmp_path / "rollup")
    S.rollup_writer(lambda: spark.read.parquet(path), table)(stored, 0)
    S.rollup_writer(lambda: spark.read.parquet(path), table)(late, 1)
    got = {(r.day, r.org_id): r.logs_count for r in spark.read.parquet(table).collect()}
    want = {(r.day, r.org_id): r.n for r in stored.groupBy(F.to_date("created_at").alias("day"), "org_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_scan_carries_over_batches(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "stream_id long, place long, body string"
    for chunk in ([(1, 0, "a <scr"), (2, 0, "x")], [(1, 1, "ipt>"), (2, 1, "<script>")], [(1, 2, "clean " * 60), (2, 2, "ok")]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(S.scanned_stream(stream), tmp_path, "append", "scanned")
    hit = {(r.stream_id, r.place) for r in got.collect() if "response_markup.script_tag" in r.rules}
    assert {(1, 1), (2, 1)} <= hit and (1, 0) not in hit and (2, 0) not in hit


def test_event_time_windows(spark, tmp_path):
    rows = ledger(spark, SF).select("event_id", "client_id", F.col("created_at").cast("timestamp").alias("created_at"))
    n = rows.count()
    assert S.tumbling(rows, "1 day").agg(F.sum("n")).first()[0] == n
    assert S.sliding(rows, "2 days", "1 day").agg(F.sum("n")).first()[0] == 2 * n
    assert S.sessions(rows, "client_id", "2 hours").agg(F.sum("n")).first()[0] == n


# ---- state with timers and expiry ---------------------------------------------------------------


def batches(spark, path, schema, groups, start=0):
    """Each group of rows as one file, in order of time, so that one is one micro-batch."""
    for k, rows in enumerate(groups, start):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={k:03}")
        for f in Path(f"{path}/part={k:03}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def append(stream, tmp_path, name, **more):
    with Y.settings(stream.sparkSession, **more):
        stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def test_repeats_cost_no_number(spark, tmp_path):
    """Repeats within a batch, in later batches and after a restart keep the number they have; numbers have no gap."""
    schema, path = "client_id long, event_id long", str(tmp_path / "sent")
    first = [[(1, 10), (1, 11), (1, 10), (2, 10)], [(1, 11), (1, 12), (2, 9)]]
    got = append(Y.enqueued(batches(spark, path, schema, first)), tmp_path, "numbers", **Y.WITHOUT_IDLE_BATCHES)
    assert sorted(map(tuple, got)) == [(1, 10, 1, False), (1, 10, 1, True), (1, 11, 2, False), (1, 11, 2, True), (1, 12, 3, False), (2, 9, 2, False), (2, 10, 1, False)]
    again = append(Y.enqueued(batches(spark, path, schema, [[(1, 10), (1, 13), (2, 8), (3, 1)]], 2)), tmp_path, "numbers", **Y.WITHOUT_IDLE_BATCHES)
    assert sorted(set(map(tuple, again)) - set(map(tuple, got))) == [(1, 13, 4, False), (2, 8, 3, False), (3, 1, 1, False)]
    assert len(again) == len(got) + 4


def test_order_holds_over_arrow_batches(spark, tmp_path):
    """A key's rows that reach Python in several Arrow batches, and not in order, are worked off in order."""
    n = 40
    ids = [(k * 17) % n + 1 for k in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sent = batches(spark, str(tmp_path / "sent"), "client_id long, event_id long", [[(1, k) for k in ids]])
        numbers = append(S.numbered_by_client(sent), tmp_path, "plain")
        queued = append(Y.enqueued(sent), tmp_path, "queued", **Y.WITHOUT_IDLE_BATCHES)
        at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
        effects = batches(spark, str(tmp_path / "effects"), "org_id long, at timestamp", [[(1, at(k)) for k in ids]])
        through = append(Y.marked(effects, "org_id", window_hours=10, late="400 hours"), tmp_path, "through")
        kinds = ["failed"] * 4 + ["ok", "new"]
        lives = batches(spark, str(tmp_path / "happens"), "row_id long, kind string, at timestamp, jitter double", [[(1, kind, at(10 - k if kind == "failed" else 20 if kind == "ok" else 1), 1.0) for k, kind in enumerate(kinds)]])
        lived = append(Y.deliveries(lives), tmp_path, "lives", **Y.WITHOUT_IDLE_BATCHES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.event_id, r.client_seq) for r in numbers) == [(k, k) for k in range(1, n + 1)]
    assert sorted((r.event_id, r.client_seq, r.repeated) for r in queued) == [(k, k, False) for k in range(1, n + 1)]
    assert sorted(r.at for r in through) == [at(1), at(11), at(21), at(31)]
    assert sorted((r.outcome, r.attempts) for r in lived) == [("done", 4), ("due", 0), *[("waiting", k) for k in (1, 2, 3, 4)]]


def test_life_of_a_delivery(spark, tmp_path):
    """Failures wait longer each time and a timer makes them due; the fifth is dead; a restart repeats nothing."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema, path = "row_id long, kind string, at timestamp, jitter double", str(tmp_path / "happens")
    tick = lambda s: (0, "ok", at(s), 0.0)  # moves the watermark
    first = [[(1, "new", at(0), 1.0), (1, "new", at(0), 1.0), (2, "new", at(0), 1.0), (3, "failed", at(1), 1.0), (1, "failed", at(1), 1.0)], [tick(30)], [tick(31)], [(1, "ok", at(31), 1.0), (1, "failed", at(32), 1.0), (1, "new", at(33), 1.0), tick(40)]]
    stream = lambda groups, start: Y.deliveries(batches(spark, path, schema, groups, start).withWatermark("at", "0 seconds"), by="EventTime")
    got = append(stream(first, 0), tmp_path, "lives")
    mine = sorted((r.row_id, r.outcome, r.attempts, r.at) for r in got if r.row_id == 1)
    assert mine == [(1, "done", 1, at(31)), (1, "due", 0, at(0)), (1, "due", 1, at(5)), (1, "waiting", 1, at(5))]
    assert not [r for r in got if r.row_id in (0, 3)]  # a result of what was never sent changes nothing
    failures = [g for k in range(5) for g in ([(2, "failed", at(100 + 700 * k), 0.0)], [tick(500 + 700 * k)], [tick(501 + 700 * k)])]
    again = append(stream([*failures, [(2, "failed", at(4000), 0.0), tick(4001)], [(2, "requeue", at(4100), 0.0), tick(4101)]], 4), tmp_path, "lives")
    two = sorted((r.at, r.outcome, r.attempts) for r in again if r.row_id == 2)
    waits = [(at(100 + 700 * k + 2**k * 2), k + 1) for k in range(4)]  # half of a ceiling of 4, 8, 16, 32 seconds
    assert [x for x in two if x[1] == "waiting"] == [(w, "waiting", n) for w, n in waits]
    assert [x for x in two if x[1] == "due" and x[2] > 0] == [(w, "due", n) for w, n in waits]
    assert [x for x in two if x[1] == "dead"] == [(at(2900), "dead", 5)]
    assert (at(4100), "due", 0) in two and len(again) - len(got) == 4 + 4 + 1 + 1
    batch = spark.createDataFrame([tuple(r) for r in again], Y.LIFE)
    for _ in range(2):  # a batch that runs again
        Y.delivery_writer(str(tmp_path / "sink"))(batch, 7)
    assert spark.read.parquet(str(tmp_path / "sink/log")).count() == len(again) and [r.row_id for r in spark.read.parquet(str(tmp_path / "sink/dead")).collect()] == [2]


def test_neighbours_share_a_key(spark, tmp_path):
    """The store holds a row for a group of neighbouring items; ids that are negative, far apart or null live all the same, also after a restart."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema, path = "row_id long, kind string, at timestamp, jitter double", str(tmp_path / "happens")
    ids = [*range(1000), -1, -2, -129, 2**62, 2**40 + 1, None]
    fails = lambda i: (i or 0) % 7
    first = [(i, kind, at(100 * k), 1.0) for i in ids for k, kind in enumerate(("new", *["failed"] * fails(i), "ok"))]
    later = [(i, kind, at(100 * k), 1.0) for i in ids for k, kind in ((20, "new"), (21, "failed"), (22, "requeue"), (23, "ok"))]

    def lives(groups, start):
        stream = Y.deliveries(batches(spark, path, schema, groups, start))
        with Y.settings(spark, **Y.WITHOUT_IDLE_BATCHES):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "lives")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "lives")).collect()), key=str), q.lastProgress["stateOperators"][0]["numRowsTotal"]

    want = []
    for i in ids:
        f = fails(i)
        want += [(i, "due", 0, at(0)), *((i, "waiting", k, at(100 * k + 2 * 2**k)) for k in range(1, min(f, 4) + 1))]
        want.append((i, "dead", 5, at(500)) if f >= 5 else (i, "done", f, at(100 * (f + 1))))
    got, keys = lives([first[::-1]], 0)  # not in order
    assert got == sorted(want, key=str) and keys == 8 + 5
    want += [x for i in ids if fails(i) >= 5 for x in ((i, "due", 0, at(2200)), (i, "done", 0, at(2300)))]
    got, keys = lives([later], 1)
    assert got == sorted(want, key=str) and keys == 8 + 5


def test_neighbours_are_due_one_by_one(spark, tmp_path):
    """Items that share a timer are due in the batch whose watermark reaches their time, and one that is received meanwhile is not."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema, path = "row_id long, kind string, at timestamp, jitter double", str(tmp_path / "happens")
    tick = lambda s: (1000, "ok", at(s), 0.0)  # moves the watermark of the next batch
    groups = [[(i, "new", at(0), 1.0) for i in range(5)], [*((i, "failed", at(i + 1), 1.0) for i in range(4)), (4, "failed", at(3), 1.0)], [tick(6)], [(4, "ok", at(6.5), 1.0), tick(7)], [tick(8)], [(0, "failed", at(8), 1.0), tick(12)], [tick(13)]]
    due = []

    def note(batch, k):
        due.extend((k, r.row_id, r.attempts, r.at) for r in batch.where("outcome = 'due' AND attempts > 0").collect())

    stream = Y.deliveries(batches(spark, path, schema, groups).withWatermark("at", "0 seconds"), by="EventTime")
    with Y.settings(spark):
        stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(due) == [(3, 0, 1, at(5)), (3, 1, 1, at(6)), (4, 2, 1, at(7)), (5, 3, 1, at(8))]  # item 0 waits again, to a second that has not come


def test_effects_repeat_after_their_window(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    schema, path = "org_id long, kind string, at timestamp", str(tmp_path / "effects")
    groups = [[(1, "digest", at(0)), (1, "digest", at(5)), (2, "digest", at(3)), (1, "breach", at(3))], [(1, "digest", at(23)), (1, "digest", at(24)), (1, "digest", at(25))], [(1, "digest", at(47.9)), (1, "digest", at(48)), (2, "digest", at(200))]]
    got = append(Y.marked(batches(spark, path, schema, groups), "org_id", "kind", window_hours=24, late="400 hours"), tmp_path, "through")
    assert sorted((r.org_id, r.kind, r.at) for r in got) == [(1, "breach", at(3)), (1, "digest", at(0)), (1, "digest", at(24)), (1, "digest", at(48)), (2, "digest", at(3)), (2, "digest", at(200))]
    more = append(Y.marked(batches(spark, path, schema, [[(1, "digest", at(700)), (1, "digest", at(701))], [(1, "digest", at(723)), (1, "digest", at(724))]], 3), "org_id", "kind", window_hours=24, late="400 hours"), tmp_path, "through")
    assert sorted((r.org_id, r.at) for r in more if r.at > at(300)) == [(1, at(700)), (1, at(724))]
