"""Streaming queries: each drains a stream over the given tables (availableNow) into a checkpointed sink
and returns the sink as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import drift as D
from vigil.operators import stats as S
from vigil.operators import validate as V
from vigil.plans.drift_q import G, checks
from vigil.plans.registry import query, r6
from vigil.plans.sqlparts import LOG_CTE, checks_cte, drift_cte, events_cte, reference_cte, sql_lstr
from vigil.sources.standins import LOG_CATEGORICAL, LOG_NUMERIC, PROBABILITY_SHIFT, prediction_log, reference_rows
from vigil.streaming import ops as SO
from vigil.streaming.runner import epoch_writer, read_latest, run_to_table


def _log_stream(spark, sf_dir):
    ev = SO.event_stream(spark, sf_dir, "events")
    p = F.col("value") / (F.col("value") + F.lit(PROBABILITY_SHIFT))
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("model_name"),
                     F.col("ts").alias("created_at"), "value",
                     F.get_json_object("props", "$.k").cast("long").alias("k"),
                     (F.col("user_id") % 10).cast("string").alias("user_segment"), p.alias("probability"))


def _dedupe(spark, sf_dir):
    ev = SO.event_stream(spark, sf_dir, "events")
    out = run_to_table(ev, "dedupe", foreach_batch=SO.dedupe_batch(["user_id", "event_type"], "ts"))
    return spark.read.parquet(out + "/data")


@query("stream_dedupe", sql="SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """The (user, event type) keys that come out of the dedupe with a 24 h TTL; ``stream_dedupe_rows`` has its rows."""
    return _dedupe(spark, sf_dir).select("user_id", "event_type").distinct()


# the recursion steps from a kept row to the key's first one 24 h or more later
@query("stream_dedupe_rows", sql="""WITH RECURSIVE t AS (SELECT DISTINCT user_id, event_type, ts FROM events),
nx AS (SELECT a.user_id, a.event_type, a.ts, min(b.ts) AS later FROM t a JOIN t b ON b.user_id = a.user_id
  AND b.event_type = a.event_type AND b.ts >= a.ts + INTERVAL 24 HOUR GROUP BY ALL),
kept AS (SELECT user_id, event_type, min(ts) AS ts FROM t GROUP BY ALL
  UNION ALL SELECT k.user_id, k.event_type, nx.later FROM kept k JOIN nx USING (user_id, event_type, ts))
SELECT k.user_id, k.event_type, strftime(k.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, min(e.event_id) AS event_id
FROM kept k JOIN events e USING (user_id, event_type, ts) GROUP BY ALL""")
def stream_dedupe_rows(spark, sf_dir):
    """Events kept by the dedupe on (user, event type): the first, then each one 24 h or more after the last kept."""
    return _dedupe(spark, sf_dir).select("user_id", "event_type", F.date_format(
        "ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id")


@query("stream_windowed_drift", sql=f"WITH {checks_cte()} SELECT model_name, window_label, sample_size, severity, "
       "round(overall_score, 6) AS overall_score FROM checks")
def stream_windowed_drift(spark, sf_dir):
    """Daily drift as a stream: windowed slot counts with a watermark (append), PSI per closed window from them."""
    log = prediction_log(spark, sf_dir)
    ref = S.reference_stats(reference_rows(log), G, LOG_NUMERIC, LOG_CATEGORICAL, "probability").persist()
    counts = SO.stream_slot_counts(_log_stream(spark, sf_dir), ref, G, LOG_NUMERIC, LOG_CATEGORICAL,
                                   "probability", "created_at", "1 day", "1 day")
    # update mode: open windows are visible with their counts so far; closed ones are final
    out = run_to_table(counts, "windowed-counts", output_mode="update", foreach_batch=epoch_writer)
    per_slot = read_latest(spark, out, [*G, "window_start", "feature", "_slot"])
    sizes = (per_slot.where(F.col("feature") == "__output__").groupBy(*G, "window_start")
             .agg(F.sum("_n").alias("sample_size")))
    enough = sizes.where(F.col("sample_size") >= 30).select(*G, "window_start")
    feats = D.drift_from_counts(per_slot, ref, enough, [*G, "window_start"], ref_group_cols=G)
    best = feats.groupBy(*G, "window_start").agg(F.max("score").alias("_max"))
    s = sizes.join(best, [*G, "window_start"], "left")
    ok = F.col("sample_size") >= 30
    overall = F.when(ok, F.coalesce("_max", F.lit(0.0))).otherwise(F.lit(0.0))
    from vigil.functions.drift import severity_from_score
    return s.select(*G, F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_label"), "sample_size",
                    F.when(ok, severity_from_score(overall)).otherwise(F.lit("insufficient_data")).alias("severity"),
                    r6(overall).alias("overall_score"))


@query("stream_severity", sql=f"WITH {checks_cte()} SELECT model_name, window_label, previous_severity, "
       "new_severity FROM (SELECT *, lag(severity) OVER (PARTITION BY model_name ORDER BY window_start) "
       "AS previous_severity, severity AS new_severity FROM checks) "
       "WHERE previous_severity IS NOT NULL AND previous_severity <> new_severity")
def stream_severity(spark, sf_dir):
    """Severity-change detector with per-model state over a stream of check results."""
    summary, _ = checks(spark, sf_dir)
    from vigil.streaming.runner import scratch_path
    src = scratch_path(spark, "checks-src")
    summary.select(*G, F.col("window_start").cast("timestamp").alias("window_start"), "severity") \
        .write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = run_to_table(stream, "severity", foreach_batch=SO.severity_changes)
    return spark.read.parquet(out + "/data").select(
        "model_name", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_label"),
        "previous_severity", "new_severity")


@query("stream_dlq_route", sql="""WITH att AS (SELECT 'job_' || CAST(user_id AS VARCHAR) || '_' ||
  strftime(ts, '%Y%m%d') AS job_id, event_id, ts, event_type <> 'error' AS ok FROM events),
num AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM att),
fo AS (SELECT job_id, min(attempt) FILTER (WHERE ok) AS first_ok FROM num GROUP BY ALL),
rt AS (SELECT n.*, least(coalesce(fo.first_ok, 3), 3) AS term FROM num n JOIN fo USING (job_id))
SELECT job_id, event_id, attempt, CASE WHEN attempt < term THEN 'retrying' WHEN attempt = term AND ok THEN 'completed'
  WHEN attempt = term THEN 'dlq' ELSE 'skipped_duplicate' END AS outcome,
  CASE WHEN attempt < term THEN strftime(ts + to_seconds(CAST(2 * power(2, attempt - 1) AS BIGINT)),
  '%Y-%m-%d %H:%M:%S') END AS not_before,
  CASE WHEN attempt = term AND NOT ok THEN 'attempt ' || CAST(attempt AS VARCHAR) || ' failed' END AS error_message,
  CASE WHEN attempt = term AND NOT ok THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS sent_to_dlq_at FROM rt""")
def stream_dlq_route(spark, sf_dir):
    """Retry / DLQ routing of a stream of delivery attempts with per-job state; dead letters come from their table."""
    ev = SO.event_stream(spark, sf_dir, "events")
    att = ev.select(F.concat(F.lit("job_"), F.col("user_id").cast("string"), F.lit("_"),
                             F.date_format("ts", "yyyyMMdd")).alias("job_id"), "event_id", "ts",
                    (F.col("event_type") != "error").alias("ok"))
    out = run_to_table(att, "route", foreach_batch=SO.route_batch)
    dead = spark.read.parquet(out + "/dlq").select("job_id", "event_id", "error_message", "sent_to_dlq_at")
    r = spark.read.parquet(out + "/data").join(dead, ["job_id", "event_id"], "left")
    at = "yyyy-MM-dd HH:mm:ss"
    return r.select("job_id", "event_id", "attempt", "outcome", F.date_format("not_before", at).alias("not_before"),
                    "error_message", F.date_format("sent_to_dlq_at", at).alias("sent_to_dlq_at"))


@query("stream_contract_check", sql=f"WITH {events_cte()} SELECT event_id, CASE WHEN model_name = 'error' THEN "
       "'quarantine' ELSE 'valid' END AS route FROM ev")
def stream_contract_check(spark, sf_dir):
    """Drift events as a stream, checked against the contract; violations go to a quarantine table."""
    from vigil.plans.decide_q import drift_event_table
    from vigil.streaming.runner import scratch_path
    ev = drift_event_table(spark, sf_dir).drop("payload")
    ev = ev.withColumn("model_name", F.when(F.col("model_name") == "error", F.lit("")).otherwise(F.col("model_name")))
    src = scratch_path(spark, "events-src")
    ev.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = run_to_table(stream, "contract", foreach_batch=SO.contract_split(V.event_contract))
    valid = spark.read.parquet(out + "/valid").select("event_id", F.lit("valid").alias("route"))
    bad = spark.read.parquet(out + "/quarantine").select("event_id", F.lit("quarantine").alias("route"))
    return valid.unionByName(bad)


@query("stream_drift", sql="WITH " + LOG_CTE + ", " + reference_cte("model_name") + ", " + drift_cte("model_name", 200, 30, source="log")
       + " SELECT 0 AS epoch, model_name, sample_size, severity, round(overall_score, 6) AS overall_score FROM summary")
def stream_drift(spark, sf_dir):
    """Continuous drift check: the state is the newest 200 rows per model; each micro-batch is added to the prediction log
    and one check row per model is written."""
    return _stream_checks(spark, sf_dir).select("epoch", *G, "sample_size", "severity",
                                                r6("overall_score").alias("overall_score"))


def _stream_checks(spark, sf_dir):
    log = prediction_log(spark, sf_dir)
    ref = S.reference_stats(reference_rows(log), G, LOG_NUMERIC, LOG_CATEGORICAL, "probability")
    out = run_to_table(_log_stream(spark, sf_dir), "stream-drift", foreach_batch=SO.drift_batch(
        ref, G, LOG_NUMERIC, LOG_CATEGORICAL, "probability"))
    return spark.read.parquet(out + "/checks")


@query("drift_check_log", sql="WITH " + LOG_CTE + ", " + reference_cte("model_name") + ", " + drift_cte("model_name", 200, 30, source="log")
       + ", made AS (SELECT model_name, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS checked_at FROM rec GROUP BY ALL) "
       "SELECT s.model_name, s.min_required_samples, 0.10::DOUBLE AS warning_threshold, 0.25::DOUBLE AS critical_threshold, "
       "checked_at, CAST(checked_at[:10] AS VARCHAR) AS dt, f.feature, round(f.score, 6) AS score, f.severity, "
       f"{sql_lstr('f.expected')} AS expected, {sql_lstr('f.actual')} AS actual "
       "FROM summary s JOIN made USING (model_name) LEFT JOIN feat f ON f.model_name = s.model_name AND f.feature <> '__output__'")
def drift_check_log(spark, sf_dir):
    """The drift-check table that the continuous check appends to, by feature: thresholds, time, and the report's details."""
    from vigil.sources.sinks import append_drift_checks
    from vigil.streaming.runner import scratch_path
    path = scratch_path(spark, "check-log")
    append_drift_checks(_stream_checks(spark, sf_dir).drop("epoch"), path)
    kind = "struct<features:array<struct<feature:string,score:double,severity:string,details:map<string,string>>>>"
    rows = spark.read.parquet(path).withColumn("f", F.explode_outer(F.from_json("report", kind)["features"]))

    def numbers(name):
        return F.array_join(F.from_json(F.col("f.details")[name], "array<bigint>"), ",")
    return rows.select(*G, "min_required_samples", "warning_threshold", "critical_threshold",
                       F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("checked_at"), F.col("dt").cast("string").alias("dt"),
                       "f.feature", r6("f.score").alias("score"), "f.severity", numbers("expected_distribution").alias("expected"),
                       numbers("actual_distribution").alias("actual"))


@query("stream_score")
def stream_score(spark, sf_dir):
    """Streaming scorer: lineitem rows as a stream, validated and scored by the fitted model. Rows with an error are
    quarantined and come back with it, without a probability."""
    from vigil.operators import ml as M
    from vigil.operators import train as TRN
    from vigil.sources.standins import TRAIN_CATEGORICAL, TRAIN_KEY, TRAIN_NUMERIC, training_frame
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    train = t.where(F.col("split") == "train").select(*TRAIN_NUMERIC, *TRAIN_CATEGORICAL, "y").persist()  # read many times
    model = TRN.fit(train, TRAIN_NUMERIC, TRAIN_CATEGORICAL, "y")
    train.unpersist()
    stream = SO.event_stream(spark, sf_dir, "lineitem", ts_col="l_shipdate")
    feats = stream.select(*TRAIN_KEY, *TRAIN_NUMERIC, *TRAIN_CATEGORICAL)
    out = run_to_table(feats, "stream-score", foreach_batch=SO.score_split(model, TRAIN_KEY, 0.5, "stream"))
    scored, bad = spark.read.parquet(out + "/data"), spark.read.parquet(out + "/quarantine")
    return scored.unionByName(bad).select(*TRAIN_KEY, "probability", "predicted_class", "error")
