import datetime as dt

from vigil.operators import ledger as L
from vigil.operators import queue as Q


def test_upsert_matches_null_keys(spark):
    tgt = spark.createDataFrame([("m", None, "local"), ("m", "1", "local"), ("n", "1", "local")],
                                "model_name string, model_version string, stage string")
    src = spark.createDataFrame([("m", None, "production"), ("n", "2", "candidate")],
                                "model_name string, model_version string, stage string")
    out = {(r.model_name, r.model_version): r.stage for r in L.upsert(tgt, src, ["model_name", "model_version"]).collect()}
    assert out == {("m", None): "production", ("m", "1"): "local", ("n", "1"): "local", ("n", "2"): "candidate"}


def test_insert_if_absent_first_write_wins(spark):
    stored = spark.createDataFrame([("a",)], "k string")
    inc = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, ts int")
    for fn in (L.insert_if_absent, L.insert_if_absent_agg):
        assert [(r.k, r.ts) for r in fn(stored, inc, ["k"], ["ts"]).collect()] == [("b", 2)]


def test_job_state_fold_is_order_independent(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [("j", t, 1, "running", 1, None, None, None), ("j", t, 2, "retrying", 1, "boom", t, None),
          ("j", t, 3, "running", 2, None, None, None), ("j", t, 4, "completed", None, None, None, None)]
    schema = ("job_id string, ts timestamp, seq int, status string, attempts int, error_message string, "
              "next_retry_at timestamp, dlq_reason string")
    a = L.job_state(spark.createDataFrame(ev, schema)).first()
    b = L.job_state(spark.createDataFrame(list(reversed(ev)), schema).repartition(3)).first()
    assert a == b
    assert (a.status, a.attempts, a.error_message, a.n_retries, a.sent_to_dlq) == ("completed", 2, None, 1, False)


def test_route_attempts_retry_then_dlq(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j", i, t + dt.timedelta(seconds=i), False) for i in range(4)] + \
        [("k", 10 + i, t + dt.timedelta(seconds=i), i == 1) for i in range(3)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp, ok boolean")
    r = {(x.job_id, x.attempt): (x.outcome, x.delay_seconds) for x in Q.route_attempts(df).collect()}
    assert r[("j", 1)] == ("retrying", 2) and r[("j", 2)] == ("retrying", 4)
    assert r[("j", 3)][0] == "dlq" and r[("j", 4)][0] == "skipped_duplicate"
    assert r[("k", 2)][0] == "completed" and r[("k", 3)][0] == "skipped_duplicate"


def test_investigation_resolved_at_first_then_explicit(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("i", t, 1, "resolved", "update"), ("i", t + dt.timedelta(days=1), 2, "resolved", "update"),
            ("i", t + dt.timedelta(days=2), 3, None, "update")]
    df = spark.createDataFrame(rows, "investigation_id string, ts timestamp, seq int, status string, op string")
    for c in ("current_step", "recommended_action", "summary"):
        df = df.withColumn(c, df.status.cast("string").substr(0, 0).cast("string"))
    s = L.investigation_state(df).first()
    assert s.resolved_at == t and s.status == "resolved"
