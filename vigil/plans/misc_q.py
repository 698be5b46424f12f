"""Transition, join and run-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import decide as DC
from vigil.operators import promotion as P
from vigil.operators import runs as RU
from vigil.operators import transitions as TR
from vigil.operators.drift import latest_per_group
from vigil.plans.decide_q import drift_event_table
from vigil.plans.drift_q import checks
from vigil.plans.ledger_q import APR_SQL, ATT_SQL, INV_SQL
from vigil.plans.registry import query
from vigil.plans.sqlparts import checks_cte, events_cte
from vigil.sources.standins import approvals_ledger, investigations_ledger, job_results, training_frame
from vigil.sources.tables import read_table
from vigil.streaming.runner import written

CUT = "2024-01-15"

JR_SQL = ATT_SQL + f""",
jr AS (SELECT rt.job_id, 'inv_' || CAST(rt.user_id AS VARCHAR) AS investigation_id,
  CASE rt.user_id % 3 WHEN 0 THEN 'replay_test' WHEN 1 THEN 'retrain' ELSE 'rollback' END AS job_type,
  rt.outcome AS status, e.value, rt.ts AS finished_at,
  CASE WHEN rt.outcome = 'dlq' THEN 'max attempts reached' END AS error_message
  FROM rt JOIN (SELECT event_id, value FROM events) e USING (event_id) WHERE rt.outcome IN ('completed', 'dlq')),
jr2 AS (SELECT *, CASE WHEN value > 20 THEN 'v' || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) END AS ver,
  status = 'completed' AND job_type = 'retrain' AND value > 5 AND value > 20 AS valid FROM jr),
prior AS (SELECT DISTINCT investigation_id, ver FROM jr2 WHERE valid AND finished_at < TIMESTAMP '{CUT}'),
batch AS (SELECT b.*, p.investigation_id IS NOT NULL AS has_prior,
  CASE WHEN valid THEN sum(CAST(valid AS INTEGER)) OVER (PARTITION BY b.investigation_id, b.ver
    ORDER BY finished_at, job_id ROWS UNBOUNDED PRECEDING) END AS nth
  FROM jr2 b LEFT JOIN prior p ON p.investigation_id = b.investigation_id AND p.ver = b.ver
  WHERE finished_at >= TIMESTAMP '{CUT}')"""


@query("apply_job_results", sql=f"""WITH {JR_SQL}
SELECT job_id, job_type, status,
  CASE WHEN status = 'completed' AND job_type = 'replay_test' THEN CASE WHEN value > 10 THEN 'resolved' ELSE 'failed' END
       WHEN status = 'completed' AND job_type = 'retrain' AND NOT value > 5 THEN 'failed'
       WHEN status = 'completed' AND job_type = 'retrain' AND ver IS NULL THEN 'failed'
       WHEN valid THEN 'waiting_for_approval'
       WHEN status = 'completed' AND job_type = 'rollback' THEN 'resolved'
       WHEN status = 'dlq' THEN 'failed' END AS new_status,
  CASE WHEN status = 'completed' AND job_type = 'replay_test' THEN
         CASE WHEN value > 10 THEN 'replay_test_completed' ELSE 'replay_test_failed' END
       WHEN status = 'completed' AND job_type = 'retrain' AND NOT value > 5 THEN 'retrain_result_invalid'
       WHEN status = 'completed' AND job_type = 'retrain' AND ver IS NULL THEN 'candidate_model_missing'
       WHEN valid THEN 'promotion_approval_pending'
       WHEN status = 'completed' AND job_type = 'rollback' THEN 'rollback_completed'
       WHEN status = 'dlq' THEN 'job_dlq' END AS current_step,
  coalesce(valid AND NOT (has_prior OR nth > 1), false) AS creates_approval
FROM batch""")
def apply_job_results(spark, sf_dir):
    """Job results after the cut applied against the promotion approvals created before it."""
    res = written(job_results(spark, sf_dir), "job-results")  # read many times
    cut = F.lit(CUT).cast("timestamp_ntz")
    before = TR.apply_job_results(res.where(F.col("finished_at") < cut))
    prior = before.where("creates_approval").select(
        "investigation_id", F.lit("promote_to_production").alias("requested_action"),
        F.col("candidate_model_version").alias("model_version"), F.lit("pending").alias("status"))
    out = TR.apply_job_results(res.where(F.col("finished_at") >= cut), prior)
    return out.select("job_id", "job_type", "status", "new_status", "current_step", "creates_approval")


DEC_SQL = APR_SQL + """,
dec AS (SELECT 'apr_' || CAST(o_orderkey AS VARCHAR) AS approval_id,
  CASE WHEN o_totalprice > 200000 THEN 'approve' ELSE 'reject' END AS decision FROM orders)"""


@query("apply_approvals", sql=f"""WITH {DEC_SQL}
SELECT d.approval_id, d.decision,
  CASE WHEN a.status <> 'pending' THEN 'Approval ' || d.approval_id || ' is not pending. Current status: ' || a.status
  END AS error,
  CASE WHEN a.status = 'pending' THEN CASE WHEN d.decision = 'approve' THEN 'approved' ELSE 'rejected' END
       ELSE a.status END AS new_status,
  CASE WHEN a.status = 'pending' AND d.decision = 'approve' THEN a.requested_action || '_approved'
       WHEN a.status = 'pending' THEN 'approval_rejected' END AS investigation_step,
  CASE WHEN a.status = 'pending' AND d.decision = 'approve' THEN
    CASE a.requested_action WHEN 'rollback_production' THEN 'rollback_job' WHEN 'retrain' THEN 'retrain_job'
      WHEN 'promote_to_production' THEN 'promotion_request' END
  END AS side_effect
FROM dec d LEFT JOIN apr a USING (approval_id)""")
def apply_approvals(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    dec = o.select(
        F.concat(F.lit("apr_"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.when(F.col("o_totalprice") > 200000, "approve").otherwise("reject").alias("decision"),
        F.lit("ops").alias("actor"), F.lit("price check").alias("reason"))
    apr = approvals_ledger(spark, sf_dir).withColumn("model_version", F.lit(None).cast("string"))
    out = TR.apply_approvals(dec, apr)
    return out.select("approval_id", "decision", "error", "new_status", "investigation_step", "side_effect")


_APR_VERSION = "CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE strftime(created_at, '%Y') END"


@query("existing_promotion", sql=f"""WITH {INV_SQL}, {APR_SQL}, v AS (SELECT *, {_APR_VERSION} AS model_version FROM apr)
SELECT investigation_id, strftime(opened_at, '%Y') AS model_version FROM inv WHERE EXISTS (SELECT 1 FROM v
  WHERE v.investigation_id = inv.investigation_id AND v.model_version = strftime(inv.opened_at, '%Y')
    AND requested_action = 'promote_to_production' AND status IN ('pending', 'approved'))""")
def existing_promotion(spark, sf_dir):
    """Investigation and candidate version that already hold a pending or approved promotion approval of that version."""
    apr = approvals_ledger(spark, sf_dir).withColumn("model_version", F.when(
        F.col("o_orderkey") % 3 == 0, "other").otherwise(F.date_format("created_at", "yyyy")))
    inv = investigations_ledger(spark, sf_dir).select("investigation_id", F.date_format("opened_at", "yyyy").alias("model_version"))
    return TR.existing_promotions(inv, apr)


@query("record_job_results", sql=f"""WITH {JR_SQL},
u AS (SELECT *, CAST(substr(investigation_id, 5) AS BIGINT) % 11 = 0 AS unknown,
  CAST(substr(investigation_id, 5) AS BIGINT) % 7 = 0 AS lost FROM jr2),
apr AS (SELECT investigation_id, ver, arg_max('apr_' || job_id, (finished_at, 'apr_' || job_id)) AS stored_id FROM u
  WHERE valid AND finished_at < TIMESTAMP '{CUT}' GROUP BY ALL),
n AS (SELECT u.*, stored_id, valid AND NOT unknown AND NOT lost AS counts FROM u LEFT JOIN apr USING (investigation_id, ver)
  WHERE finished_at >= TIMESTAMP '{CUT}'),
o AS (SELECT *, counts AND stored_id IS NULL AND row_number() OVER (PARTITION BY investigation_id, ver, counts
  ORDER BY finished_at, job_id) = 1 AS creates FROM n)
SELECT job_id, CASE WHEN unknown THEN 'unknown_job' WHEN lost THEN 'investigation_missing' WHEN counts AND NOT creates
    THEN 'existing_approval' ELSE 'applied' END AS outcome,
  CASE WHEN unknown THEN 'Unknown job_id: ' || job_id END AS error, CASE WHEN NOT unknown THEN status END AS job_status,
  CASE WHEN NOT unknown THEN job_type END AS node_name,
  CASE WHEN NOT unknown THEN 'Job ' || job_id || CASE status WHEN 'completed' THEN ' completed.' ELSE ' moved to DLQ.' END
    END AS content,
  CASE WHEN NOT unknown THEN status END AS meta_status, CASE WHEN NOT unknown THEN ver END AS meta_version,
  CASE WHEN NOT unknown THEN error_message END AS meta_error,
  creates AS creates_approval, CASE WHEN counts THEN coalesce(stored_id,
    'approval_' || substr(sha256(investigation_id || '|' || ver), 1, 12)) END AS approval_id,
  CASE WHEN unknown OR lost THEN NULL WHEN status = 'dlq' THEN 'job_dlq' WHEN job_type = 'rollback' THEN 'rollback_completed'
    WHEN job_type = 'replay_test' THEN CASE WHEN value > 10 THEN 'replay_test_completed' ELSE 'replay_test_failed' END
    WHEN NOT value > 5 THEN 'retrain_result_invalid' WHEN ver IS NULL THEN 'candidate_model_missing'
    ELSE 'promotion_approval_pending' END AS current_step
FROM o""")
def record_job_results(spark, sf_dir):
    """Results after the cut against the ledger (every eleventh user's jobs are unknown), the investigations (every seventh
    is missing) and the approvals created before the cut, whose ids are kept."""
    res = written(job_results(spark, sf_dir), "job-results")  # read many times
    user, cut = F.substring("investigation_id", 5, 20).cast("long"), F.lit(CUT).cast("timestamp_ntz")
    before = res.where(F.col("finished_at") < cut)
    first = TR.apply_job_results(before).where(F.col("approval_id").isNotNull())
    approvals = first.join(before.select("job_id", "finished_at").hint("merge"), "job_id").select(
        F.concat(F.lit("apr_"), "job_id").alias("approval_id"), "investigation_id",
        F.lit("promote_to_production").alias("requested_action"), F.col("candidate_model_version").alias("model_version"),
        F.lit("pending").alias("status"), F.col("finished_at").alias("created_at"))
    out = TR.record_job_results(res.where(F.col("finished_at") >= cut), res.where(user % 11 != 0).select("job_id"),
                                res.where(user % 7 != 0).select("investigation_id"), approvals)
    meta = {"meta_status": "$.status", "meta_version": "$.result.model_version", "meta_error": "$.error_message"}
    return out.select("job_id", "outcome", "error", "job_status", "node_name", "content", *[
        F.get_json_object("metadata", p).alias(c) for c, p in meta.items()], "creates_approval", "approval_id", "current_step")


@query("event_investigation", sql=f"""WITH {events_cte()}
SELECT event_id, CASE WHEN window_start < TIMESTAMP '2024-01-20' THEN investigation_id END AS investigation_id
FROM tri""")
def event_investigation(spark, sf_dir):
    """Events ⟕ investigations opened so far (those of events before Jan 20)."""
    ev = drift_event_table(spark, sf_dir)
    inv = DC.investigate(ev.where(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))).select(
        "event_id", "investigation_id")
    return ev.select("event_id").join(inv, "event_id", "left")


@query("gate_latest_drift", sql=f"""WITH {checks_cte()},
latest AS (SELECT severity FROM checks ORDER BY window_start DESC, model_name DESC LIMIT 1),
versions AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS model_version FROM lineitem)
SELECT model_version, latest.severity AS latest_drift_severity, latest.severity = 'normal' AS passed
FROM versions, latest""")
def gate_latest_drift(spark, sf_dir):
    """Every candidate version gated on the single latest drift check (a one-row broadcast)."""
    summary, _ = checks(spark, sf_dir)
    latest = latest_per_group(summary.withColumn("_one", F.lit(1)), ["_one"], ["window_start", "model_name"]).select(
        F.col("severity").alias("latest_drift_severity"))
    versions = training_frame(spark, sf_dir).select(F.year("l_shipdate").cast("string").alias("model_version")) \
        .distinct()
    return attach(versions, latest).withColumn(
        "passed", F.col("latest_drift_severity").isin(*P.ALLOWED_DRIFT))


RUN_SQL = """req AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS run_id, min(l_shipdate) + INTERVAL 300 DAY AS started_at
  FROM lineitem GROUP BY ALL),
arts AS (SELECT unnest(range(9)) AS i),
required AS (SELECT run_id, i, started_at FROM req, arts),
produced AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS run_id, l_linenumber - 1 AS i, max(l_shipdate) AS produced_at
  FROM lineitem GROUP BY ALL),
chk AS (SELECT r.run_id, r.i, p.produced_at IS NULL AS missing,
  p.produced_at IS NOT NULL AND p.produced_at < r.started_at - INTERVAL 2 SECOND AS stale
  FROM required r LEFT JOIN produced p USING (run_id, i))"""


def _runs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    run = F.year("l_shipdate").cast("string").alias("run_id")
    req = li.groupBy(run).agg((F.min("l_shipdate") + F.expr("INTERVAL 300 DAYS")).alias("started_at"))
    arts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("artifact")) for i, a in enumerate(RU.REQUIRED_ARTIFACTS)])
    required = req.select("*", F.inline(arts))  # each run requires the fixed list of artifacts
    produced = li.groupBy(run, (F.col("l_linenumber") - 1).alias("i")).agg(F.max("l_shipdate").alias("produced_at"))
    names = F.element_at(F.transform(arts, lambda x: x["artifact"]), F.col("i") + 1)
    produced = produced.where((F.col("i") >= 0) & (F.col("i") < len(RU.REQUIRED_ARTIFACTS))).select(
        "run_id", "i", names.alias("artifact"), "produced_at").drop("i")
    return required, produced


@query("delivery_check", sql=f"WITH {RUN_SQL} SELECT run_id, i AS artifact_index, "
       f"{RU.REQUIRED_ARTIFACTS!r}[i + 1] AS artifact, missing, stale FROM chk")
def delivery_check(spark, sf_dir):
    """Per yearly run: the 9 required files against those produced (file i = line number i+1; two are never produced)."""
    required, produced = _runs(spark, sf_dir)
    return RU.delivery_check(required, produced).select("run_id", F.col("i").alias("artifact_index"), "artifact", "missing",
                                                        "stale")


@query("run_acceptance", sql=f"""WITH {RUN_SQL},
runs AS (SELECT run_id, CASE WHEN run_id = '1995' THEN 1 ELSE 0 END AS exit_code FROM req),
per AS (SELECT run_id, count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE stale) AS n_stale
  FROM chk GROUP BY ALL)
SELECT run_id, CASE WHEN exit_code <> 0 THEN 'exit_code' WHEN n_missing > 0 THEN 'artifacts_missing'
  WHEN n_stale > 0 THEN 'artifacts_stale' END AS failure FROM runs JOIN per USING (run_id)""")
def run_acceptance(spark, sf_dir):
    required, produced = _runs(spark, sf_dir)
    checked = RU.delivery_check(required, produced)
    runs = required.select("run_id").distinct().select(
        "run_id", F.when(F.col("run_id") == "1995", 1).otherwise(0).alias("exit_code"),
        F.lit(True).alias("summary_present"), F.lit(True).alias("summary_valid"), F.lit(True).alias("completed"))
    return RU.run_acceptance(runs, checked).select("run_id", "failure")


# ---- scalar families over the tables -------------------------------------------------------------------------
from vigil.functions import text as TX  # noqa: E402
from vigil.operators.joins import attach
from vigil.operators.queue import backoff_seconds  # noqa: E402


@query("fn_scoring", sql="""SELECT event_id, round(1 / (1 + exp(-(value - 50) / 25)), 6) AS sigmoid_p,
  CAST(1 / (1 + exp(-(value - 50) / 25)) >= coalesce(nullif(floor(value / 100) / 10, 0.0), nullif(0.0, 0.0), 0.5)
    AS INTEGER) AS predicted_class,
  coalesce(nullif(floor(value / 100) / 10, 0.0), nullif(0.0, 0.0), 0.5) AS threshold FROM events""")
def fn_scoring(spark, sf_dir):
    """Sigmoid of a decision score, class at a threshold, threshold fallback (0 counts as absent)."""
    ev = read_table(spark, sf_dir, "events")
    thr = TX.threshold_fallback(F.floor(F.col("value") / 100) / 10, F.lit(0.0))
    p = TX.sigmoid((F.col("value") - 50) / 25)
    return ev.select("event_id", F.round(p, 6).alias("sigmoid_p"), TX.predicted_class(p, thr).alias(
        "predicted_class"), thr.alias("threshold"))


@query("fn_keys", sql="""SELECT o_orderkey,
  'inv_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS investigation_id,
  'retrain:inv_' || CAST(o_orderkey AS VARCHAR) || ':' || CASE WHEN o_orderstatus = 'P' THEN 'unknown'
     ELSE o_orderstatus END AS job_key,
  'promotion_inv_' || CAST(o_orderkey AS VARCHAR) || '_' || CASE WHEN o_orderstatus = 'P' THEN 'unknown'
     ELSE o_orderstatus END || '_production' AS request_id,
  'rollback_inv_' || CAST(o_orderkey AS VARCHAR) || '_apr_' || CAST(o_orderkey AS VARCHAR) || '_' ||
     CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END || '_production' AS rollback_request_id,
  2 * (1 << greatest(CAST(o_orderkey % 5 AS INTEGER) - 1, 0)) AS backoff_seconds
FROM orders""")
def fn_keys(spark, sf_dir):
    """Deterministic ids and idempotency keys, backoff (versions missing on status P)."""
    o = read_table(spark, sf_dir, "orders")
    inv = F.concat(F.lit("inv_"), F.col("o_orderkey").cast("string"))
    ver = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return o.select(
        "o_orderkey", TX.short_id("inv", "o_orderkey").alias("investigation_id"),
        TX.job_key(F.lit("retrain"), inv, ver).alias("job_key"),
        TX.promotion_request_id(inv, ver).alias("request_id"),
        P.rollback_request_id(inv, F.concat(F.lit("apr_"), F.col("o_orderkey").cast("string")), ver)
        .alias("rollback_request_id"),
        backoff_seconds((F.col("o_orderkey") % 5).cast("int")).alias("backoff_seconds"))


@query("fn_text", sql="""SELECT doc_id, right(text, 40) AS tail, left(text, 30) AS head,
  CASE WHEN length(text) > 25 THEN substr(text, 1, 24) || '…' ELSE text END AS short,
  length(text) AS n_chars, lang, trim(regexp_extract(text, 'Artifacts saved to:\\s*(.+)', 1)) AS artifacts_path
FROM documents""")
def fn_text(spark, sf_dir):
    """Last / first characters and truncation with an ellipsis over whole documents."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.last_chars("text", 40).alias("tail"), TX.first_chars("text", 30).alias("head"),
                    TX.truncate("text", 25).alias("short"), F.length("text").alias("n_chars"), "lang",
                    TX.artifacts_path("text").alias("artifacts_path"))


@query("fn_status_bucket", sql="""SELECT bucket, count(*) AS n FROM (SELECT CASE
  WHEN lower(s) IN ('healthy', 'ok', 'normal', 'completed', 'resolved', 'approved', 'passed', 'true') THEN 'ok'
  WHEN lower(s) IN ('warning', 'pending', 'waiting_for_approval', 'waiting_for_job', 'queued') THEN 'waiting'
  WHEN lower(s) IN ('critical', 'failed', 'blocked', 'promotion_blocked', 'rejected', 'dlq', 'false') THEN 'bad'
  WHEN lower(s) IN ('running', 'processing', 'in_progress') THEN 'running'
  WHEN lower(s) IN ('candidate', 'promote_to_production', 'retrain') THEN 'candidate' ELSE 'other' END AS bucket
  FROM (SELECT event_type AS s FROM events UNION ALL SELECT CASE o_orderstatus WHEN 'O' THEN 'running'
        WHEN 'P' THEN 'waiting_for_approval' ELSE 'resolved' END FROM orders)) GROUP BY ALL""")
def fn_status_bucket(spark, sf_dir):
    s = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("s")).unionByName(
        investigations_ledger(spark, sf_dir).select(F.col("status").alias("s")))
    return s.groupBy(TX.status_bucket("s").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_json", sql="""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k,
  coalesce(json_extract_string(props, '$.missing.deep'), 'none') AS deep,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""")
def fn_json(spark, sf_dir):
    """Nested JSON lookup with a default; compact UTC stamp."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", TX.safe_get("props", "$.k", "none").alias("k"),
                     TX.safe_get("props", "$.missing.deep", "none").alias("deep"), TX.compact_stamp("ts").alias("stamp"))


@query("fn_comma_set", sql="""SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(
  string_split(coalesce(role || ', ' || text, ''), ','), lambda x: trim(x)), lambda x: x <> ''))) AS items
FROM conversations""")
def fn_comma_set(spark, sf_dir):
    """Comma list → trimmed, non-empty, distinct items (sorted for comparison)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_sort(TX.comma_set(F.concat_ws(", ", "role", "text"))).alias("items"))


@query("registry_list", sql="""WITH reg AS (SELECT p_brand AS model_name, CASE WHEN p_size % 10 = 0 THEN NULL
  ELSE CAST(p_size AS VARCHAR) END AS model_version, p_retailprice, p_size FROM part),
r AS (SELECT model_name, model_version, round(avg(p_retailprice) / 2000, 6) AS threshold,
  round(max(p_retailprice) / 2500, 6) AS auc, round(min(p_retailprice) / 2500, 6) AS recall FROM reg GROUP BY ALL)
SELECT model_name, model_version, 'local' AS model_stage, threshold, metric, value FROM
  (UNPIVOT r ON auc, recall INTO NAME metric VALUE value)""")
def registry_list(spark, sf_dir):
    """Registry rows with their metrics map exploded (read-only listing)."""
    p = read_table(spark, sf_dir, "part")
    reg = p.select(F.col("p_brand").alias("model_name"),
                   F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(
                       F.col("p_size").cast("string")).alias("model_version"), "p_retailprice")
    r = reg.groupBy("model_name", "model_version").agg(
        F.round(F.avg("p_retailprice") / 2000, 6).alias("threshold"),
        F.create_map(F.lit("auc"), F.round(F.max("p_retailprice") / 2500, 6), F.lit("recall"),
                     F.round(F.min("p_retailprice") / 2500, 6)).alias("metrics"))
    return r.select("model_name", "model_version", F.lit("local").alias("model_stage"), "threshold",
                    F.explode("metrics").alias("metric", "value"))


@query("max_version", sql="""SELECT p_brand AS model_name, max(p_size) FILTER (WHERE p_size % 10 <> 0) AS max_version
FROM part GROUP BY ALL""")
def max_version(spark, sf_dir):
    """Highest registered version per model, comparing versions as numbers, not strings."""
    p = read_table(spark, sf_dir, "part")
    v = F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("p_size").cast("string"))
    versions = p.select(F.col("p_brand").alias("model_name"), v.alias("version"))
    return versions.groupBy("model_name").agg(F.max(F.col("version").cast("int")).alias("max_version"))


@query("stale_approvals", sql=f"""WITH {APR_SQL}
SELECT approval_id FROM apr WHERE status = 'pending'
  AND created_at < (SELECT max(created_at) FROM apr) - INTERVAL 60 MINUTE""")
def stale_approvals(spark, sf_dir):
    """Pending approvals older than 60 minutes at the newest time in the table."""
    apr = approvals_ledger(spark, sf_dir)
    now = apr.agg(F.max("created_at").alias("_now"))
    return (attach(apr.where(F.col("status") == "pending"), now)
            .where(F.col("created_at") < F.col("_now") - F.expr("INTERVAL 60 MINUTES")).select("approval_id"))


@query("flatten_jobs", sql=f"""WITH {JR_SQL}
SELECT job_id, investigation_id, job_type, status, CAST(value > 10 AS VARCHAR) AS passed,
  CAST(value > 5 AS VARCHAR) AS completed, ver AS model_version FROM jr2""")
def flatten_jobs(spark, sf_dir):
    """Job rows with their result map flattened for reporting."""
    r = job_results(spark, sf_dir)
    return r.select("job_id", "investigation_id", "job_type", "status", F.col("result")["passed"].alias("passed"),
                    F.col("result")["completed"].alias("completed"),
                    F.col("result")["model_version"].alias("model_version"))


@query("audit_messages", sql=f"""WITH {events_cte()}
SELECT role, node_name, count(*) AS n FROM (
  SELECT 'system' AS role, 'webhook' AS node_name FROM act2
  UNION ALL SELECT 'agent', unnest(CASE WHEN production_action_required THEN
    ['supervisor', 'triage', 'supervisor', 'action', 'supervisor', 'approval', 'supervisor', 'comms', 'supervisor',
     'completion', 'supervisor'] ELSE ['supervisor', 'triage', 'supervisor', 'action', 'supervisor', 'comms',
     'supervisor', 'completion', 'supervisor'] END) FROM act2
  UNION ALL SELECT 'tool', 'queue' FROM act2 WHERE queue_job_required) GROUP BY ALL""")
def audit_messages(spark, sf_dir):
    """Audit rows of every investigation: the system opening message, the agent trace, a tool row per job."""
    from vigil.operators.audit import audit_messages as am
    inv = DC.investigate(drift_event_table(spark, sf_dir))
    return am(inv).groupBy("role", "node_name").agg(F.count(F.lit(1)).alias("n"))


@query("current_drift", sql=f"""WITH {events_cte()},
lc AS (SELECT model_name, severity, overall_score FROM checks WHERE sample_size >= 30
       QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY window_start DESC) = 1),
li AS (SELECT model_name, new_severity AS severity, overall_score FROM ev
       QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY window_start DESC) = 1)
SELECT coalesce(lc.model_name, li.model_name) AS model_name, CASE WHEN lc.model_name IS NOT NULL THEN 'check'
  ELSE 'investigation' END AS source, coalesce(lc.severity, li.severity) AS severity,
  round(coalesce(lc.overall_score, li.overall_score), 6) AS overall_score
FROM lc FULL OUTER JOIN li ON lc.model_name = li.model_name""")
def current_drift(spark, sf_dir):
    """Current drift per model: the latest usable check, else the report of the latest investigation."""
    summary, feats = checks(spark, sf_dir)
    lc = latest_per_group(summary.where(F.col("sample_size") >= 30), ["model_name"], ["window_start"]).select(
        "model_name", F.col("severity").alias("c_sev"), F.col("overall_score").alias("c_score"))
    from vigil.operators.events import drift_events
    ev = drift_events(summary, feats, ["model_name"], ["window_start"])
    li = latest_per_group(ev.select("model_name", "created_at", "new_severity", "overall_score"), ["model_name"],
                          ["created_at"]).select("model_name", F.col("new_severity").alias("i_sev"),
                                                 F.col("overall_score").alias("i_score"))
    j = lc.join(li, "model_name", "full_outer")
    return j.select("model_name", F.when(F.col("c_sev").isNotNull(), "check").otherwise("investigation").alias(
        "source"), F.coalesce("c_sev", "i_sev").alias("severity"),
        F.round(F.coalesce("c_score", "i_score"), 6).alias("overall_score"))


@query("versioned_stats", sql="""WITH r AS (SELECT event_type AS model_name, value,
  strftime(ts, '%Y%m%d') AS day FROM events WHERE ts < TIMESTAMP '2024-01-21'),
v AS (SELECT model_name, 'w' || CAST(week(strptime(day, '%Y%m%d')) AS VARCHAR) AS version, count(*) AS n_rows,
  round(avg(value), 6) AS mean_value FROM r GROUP BY ALL)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY CAST(substr(version, 2) AS INTEGER) DESC) = 1""")
def versioned_stats(spark, sf_dir):
    """Weekly reference snapshots written under version partitions; the newest version per model read back."""
    from vigil.sources.sinks import read_newest, write_versioned
    from vigil.sources.standins import prediction_log, reference_rows
    from vigil.streaming.runner import scratch_path
    ref = reference_rows(prediction_log(spark, sf_dir))
    snap = ref.groupBy("model_name", F.concat(F.lit("w"), F.weekofyear("created_at").cast("string")).alias(
        "version")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"))
    path = scratch_path(spark, "versioned-stats")
    write_versioned(snap, path)
    return read_newest(spark, path, ["model_name"]).select("model_name", "version", "n_rows", "mean_value")


@query("retrain_payload", sql=f"""WITH {APR_SQL},
r AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(created_at, '%Y') ELSE '' END AS av,
  CASE WHEN o_orderkey % 2 = 0 THEN 'state' END AS sv, CASE WHEN o_orderkey % 5 <> 0 THEN 'evt_' || o_orderkey END AS se,
  CASE WHEN o_orderkey % 4 = 0 THEN 'critical' END AS ss FROM apr WHERE requested_action = 'retrain' AND status = 'approved')
SELECT 'retrain:' || investigation_id || ':' || coalesce(nullif(av, ''), sv, 'unknown') AS idempotency_key, investigation_id,
  approval_id, 'ops' AS approved_by, 'm' || o_orderkey % 9 AS model_name, coalesce(nullif(av, ''), sv) AS model_version,
  'candidate' AS target_environment, coalesce(se, 'req_' || o_orderkey) AS event_id, coalesce(ss, 'warning') AS severity,
  CASE WHEN o_orderkey % 7 = 0 THEN '{{"from":"state"}}' ELSE '{{"from":"request"}}' END AS drift_report,
  'retrain' AS recommended_action, 'retrain' AS requested_action FROM r""")
def retrain_payload(spark, sf_dir):
    """Retrain job payloads of approved retrain approvals: the approval's model and version first, the state's event, severity
    and report before the request's."""
    k = F.col("o_orderkey")
    apr = approvals_ledger(spark, sf_dir).where("requested_action = 'retrain' AND status = 'approved'")
    apr = apr.select(
        "approval_id", "investigation_id", F.lit("ops").alias("approved_by"), F.concat(F.lit("m"), (k % 9).cast("string")).alias("model_name"),
        F.when(k % 3 != 0, F.date_format("created_at", "yyyy")).otherwise("").alias("model_version"),
        F.lit("candidate").alias("target_environment"), "requested_action",
        F.create_map(F.lit("event_id"), F.concat(F.lit("req_"), k.cast("string")), F.lit("severity"), F.lit("warning"),
                     F.lit("drift_report"), F.lit('{"from":"request"}')).alias("request_payload"))
    inv = investigations_ledger(spark, sf_dir).select("investigation_id", F.create_map(
        F.lit("model_version"), F.when(k % 2 == 0, "state"), F.lit("event_id"), F.when(k % 5 != 0, F.concat(F.lit("evt_"), k.cast("string"))),
        F.lit("severity"), F.when(k % 4 == 0, "critical"), F.lit("drift_report"), F.when(k % 7 == 0, '{"from":"state"}')).alias("state"))
    return TR.retrain_jobs(apr, inv).select("idempotency_key", "payload.*")


@query("job_dispatch", sql=f"""WITH {JR_SQL}
SELECT job_id, CASE job_type WHEN 'replay_test' THEN 'replay_test_handler' WHEN 'retrain' THEN 'retrain_handler'
  WHEN 'rollback' THEN 'rollback_handler' END AS handler,
  CASE WHEN job_type NOT IN ('replay_test', 'retrain', 'rollback') THEN 'Unsupported job type: ' || job_type END AS error
FROM jr""")
def job_dispatch(spark, sf_dir):
    """Job rows routed to their handler by type; an unknown type becomes an error row."""
    from vigil.operators.queue import dispatch
    return dispatch(job_results(spark, sf_dir)).select("job_id", "handler", "error")


@query("fn_json_safe", sql="""SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE value END AS safe_value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events""")
def fn_json_safe(spark, sf_dir):
    """NaN → null before JSON, ISO timestamps (values under 1 stand for failed computations here)."""
    ev = read_table(spark, sf_dir, "events")
    raw = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    out = ev.select("event_id", TX.json_safe_double(raw).alias("safe_value"), TX.iso_stamp("ts").alias("created_at"))
    return out


@query("fn_metadata_merge", sql="""SELECT event_id, event_type AS source, json_extract_string(props, '$.k') AS k,
  'local' AS environment FROM events""")
def fn_metadata_merge(spark, sf_dir):
    """Metadata maps merged with the right side winning on shared keys."""
    ev = read_table(spark, sf_dir, "events")
    left = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("source"), F.lit("events"),
                        F.lit("environment"), F.lit("local"))
    right = F.create_map(F.lit("source"), F.col("event_type"))
    m = TX.merge_metadata(left, right)
    return ev.select("event_id", m["source"].alias("source"), m["k"].alias("k"), m["environment"].alias("environment"))
