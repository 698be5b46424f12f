import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tools.check_oracles import rows_of
from vigil.operators import queue as Q
from vigil.plans import ORACLES, QUERIES, load_all
from vigil.streaming import ops as SO
from vigil.streaming.runner import run_to_table, scratch_path


def test_stream_router_equals_batch_router(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"j{i % 7}", i, t + dt.timedelta(seconds=i), i % 4 == 3) for i in range(80)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp, ok boolean")
    src = scratch_path(spark, "route-test")
    df.orderBy(F.rand(3)).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = run_to_table(stream, "route-test-out", foreach_batch=SO.route_batch)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.event_id, r.attempt, r.outcome) for r in spark.read.parquet(out + "/data").collect())
    want = sorted((r.event_id, r.attempt, r.outcome) for r in Q.route_attempts(df).collect())
    assert got == want


def test_stream_dedupe_keeps_one_per_key(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, t + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    src = scratch_path(spark, "dedupe-test")
    df.write.parquet(src)
    out = run_to_table(SO.stream_dedupe(spark.readStream.schema(df.schema).parquet(src), ["user_id"]), "dd")
    assert spark.read.parquet(out + "/data").select("user_id").distinct().count() == 5
    assert spark.read.parquet(out + "/data").count() == 5


def _batches(spark, schema, *batches):
    return [spark.createDataFrame(list(b), schema) for b in batches]


def test_route_state_carries_over_batches_and_replays(spark):
    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(9)]
    bs = _batches(spark, "job_id string, event_id long, ts timestamp, ok boolean",
                  [("a", 1, t[1], False), ("a", 0, t[0], False), ("b", 2, t[2], True), (None, 7, t[2], False)],
                  [("a", 3, t[3], False), ("b", 4, t[4], False), ("a", 5, t[5], True), (None, 8, t[8], True)],
                  [("b", 6, t[6], True)])
    out = scratch_path(spark, "route-epochs")
    for epoch in (0, 1, 1, 2):  # epoch 1 is replayed
        SO.route_batch(bs[epoch], epoch, out)
    got = {r.event_id: (r.attempt, r.outcome) for r in spark.read.parquet(out + "/data").collect()}
    assert got == {0: (1, "retrying"), 1: (2, "retrying"), 2: (1, "completed"), 3: (3, "dlq"), 4: (2, "skipped_duplicate"),
                   5: (4, "skipped_duplicate"), 6: (3, "skipped_duplicate"), 7: (1, "retrying"), 8: (2, "completed")}
    dead = spark.read.parquet(out + "/dlq").collect()
    assert [(r.job_id, r.event_id, r.sent_to_dlq_at) for r in dead] == [("a", 3, t[3])]


def test_severity_state_carries_over_batches(spark):
    t = [dt.datetime(2024, 1, i + 1) for i in range(6)]
    bs = _batches(spark, "model_name string, window_start timestamp, severity string",
                  [("m", t[1], "warning"), ("m", t[0], "normal"), ("k", t[0], "normal")],
                  [("m", t[3], "normal"), ("m", t[2], "warning")], [("k", t[4], "critical")])
    out = scratch_path(spark, "severity-epochs")
    for epoch in (0, 1, 1, 2):
        SO.severity_changes(bs[epoch], epoch, out)
    got = {(r.model_name, r.window_start, r.previous_severity, r.new_severity)
           for r in spark.read.parquet(out + "/data").collect()}
    assert got == {("m", t[1], "normal", "warning"), ("m", t[3], "warning", "normal"), ("k", t[4], "normal", "critical")}


def _greedy(rows, ttl):
    last, kept = {}, set()
    for user, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        if user not in last or ts - last[user] >= ttl:
            last[user] = ts
            kept.add(event)
    return kept


@pytest.mark.parametrize("hot", [10_000, 20])
def test_dedupe_expires_keys_inside_a_batch(spark, monkeypatch, hot):
    monkeypatch.setattr(SO, "HOT_TIMES", hot)
    rnd, t = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), i, t + dt.timedelta(hours=rnd.randint(0, 240))) for i in range(120)]
    rows += [(4, 200, t), (4, 201, t + dt.timedelta(hours=24)), (4, 202, t + dt.timedelta(hours=47, minutes=59))]
    schema = "user_id long, event_id long, ts timestamp"
    want, write = _greedy(rows, dt.timedelta(hours=24)), SO.dedupe_batch(["user_id"])
    # one batch, or cut in time order into three of which one is replayed
    by_time = sorted(rows, key=lambda r: (r[2], r[1]))
    for parts, epochs in (([rows], [0]), ([by_time[:40], by_time[40:80], by_time[80:]], [0, 1, 1, 2])):
        out, batches = scratch_path(spark, "dedupe-epochs"), _batches(spark, schema, *parts)
        for epoch in epochs:
            write(batches[epoch], epoch, out)
        assert {r.event_id for r in spark.read.parquet(out + "/data").collect()} == want
        assert spark.read.parquet(out + "/aside").count() == 0
    write(_batches(spark, schema, [(4, 300, t - dt.timedelta(days=3)), (4, 301, None)])[0], 3, out)
    assert {r.event_id for r in spark.read.parquet(out + "/aside").collect()} == {300, 301}


def test_dedupe_rows_match_oracle(spark):
    load_all()
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.001/events.parquet')")
    for name in ("stream_dedupe", "stream_dedupe_rows"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        res = con.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_stream_score_quarantines_bad_rows(spark):
    import os
    load_all()
    src = scratch_path(spark, "score-tables")
    given = "/root/testdata/sf0.001"
    os.makedirs(src)
    for t in os.listdir(given):
        if t != "lineitem.parquet":
            os.symlink(f"{given}/{t}", f"{src}/{t}")
    rows = spark.read.parquet(f"{given}/lineitem.parquet")
    at = F.col("l_orderkey") % 50
    rows = rows.withColumn("l_quantity", F.when(at != 1, F.col("l_quantity"))).withColumn(
        "l_linestatus", F.when(at != 2, F.col("l_linestatus")))
    rows.write.parquet(f"{src}/lineitem.parquet")
    got = QUERIES["stream_score"](spark, src)
    bad = rows.where("l_quantity IS NULL OR l_linestatus IS NULL").count()
    assert bad > 0 and got.count() == rows.count()
    assert got.where("error IS NOT NULL AND probability IS NULL AND predicted_class IS NULL").count() == bad
    assert got.where("error IS NULL AND probability IS NOT NULL").count() == rows.count() - bad
