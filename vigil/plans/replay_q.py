"""Replay, promotion and rollback queries.

Stand-ins: replay of ``orders`` (expected probability from the order price, actual
scored now with a known perturbation on every 97th order key, expected side
missing for status P); candidate models = yearly versions of the lineitem
return model, gated on their metrics, replay, artifacts and the latest drift check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import drift as D
from vigil.operators import ml as M
from vigil.operators import promotion as P
from vigil.operators import replay as RP
from vigil.operators.joins import attach
from vigil.plans.drift_q import checks
from vigil.plans.registry import query, r6
from vigil.plans.sqlparts import checks_cte
from vigil.sources.standins import approvals_ledger, training_frame
from vigil.sources.tables import read_table

MODEL = "lineitem_returns"
PRICE_SCALE = 250000.0
PERTURB = 0.25

REPLAY_SQL = f"""ract AS (SELECT o_orderkey AS row_index, CAST(year(o_orderdate) AS VARCHAR) AS model_version,
  o_totalprice / (o_totalprice + {PRICE_SCALE}) + CASE WHEN o_orderkey % 97 = 0 THEN {PERTURB} ELSE 0.0 END
    AS actual_probability FROM orders),
rexp AS (SELECT o_orderkey AS row_index, CAST(year(o_orderdate) AS VARCHAR) AS model_version,
  o_totalprice / (o_totalprice + {PRICE_SCALE}) AS expected_probability FROM orders WHERE o_orderstatus <> 'P'),
cmp AS (SELECT a.row_index, a.model_version, abs(a.actual_probability - e.expected_probability) AS probability_difference,
  CAST(a.actual_probability >= 0.5 AS INTEGER) = CAST(e.expected_probability >= 0.5 AS INTEGER) AS prediction_matches
  FROM ract a LEFT JOIN rexp e USING (row_index, model_version)),
rsum AS (SELECT model_version, count(*) AS total_rows, coalesce(max(probability_difference), 0.0)
  AS max_probability_difference, count(*) FILTER (WHERE NOT prediction_matches) AS prediction_mismatches
  FROM cmp GROUP BY ALL)"""


def _replay(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    p = F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(PRICE_SCALE))
    version = F.year("o_orderdate").cast("string").alias("model_version")
    actual = o.select(F.col("o_orderkey").alias("row_index"), version,
                      (p + F.when(F.col("o_orderkey") % 97 == 0, F.lit(PERTURB)).otherwise(F.lit(0.0)))
                      .alias("actual_probability"))
    actual = actual.withColumn("actual_prediction", (F.col("actual_probability") >= 0.5).cast("int"))
    expected = o.where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("row_index"), version, p.alias("expected_probability"),
        (p >= 0.5).cast("int").alias("expected_prediction"))
    return RP.replay_compare(actual, expected, "row_index", ["model_version"])


@query("replay_compare", sql=f"WITH {REPLAY_SQL} SELECT row_index, model_version, round(probability_difference, 6) "
       "AS probability_difference, prediction_matches FROM cmp")
def replay_compare(spark, sf_dir):
    c = _replay(spark, sf_dir)
    return c.select("row_index", "model_version", r6("probability_difference").alias("probability_difference"),
                    "prediction_matches")


@query("replay_summary", sql=f"WITH {REPLAY_SQL} SELECT model_version, total_rows, round(max_probability_difference, "
       "6) AS max_probability_difference, prediction_mismatches, prediction_mismatches = 0 AS passed, "
       "prediction_mismatches <= 0 AND max_probability_difference <= 1e-12 AS gate_passed FROM rsum")
def replay_summary(spark, sf_dir):
    s = RP.replay_summary(_replay(spark, sf_dir), ["model_version"])
    return s.select("model_version", "total_rows", r6("max_probability_difference").alias(
        "max_probability_difference"), "prediction_mismatches", "passed", "gate_passed")


def candidates(spark, sf_dir):
    """One promotion candidate per yearly model version."""
    t = training_frame(spark, sf_dir).withColumn("model_version", F.year("l_shipdate").cast("string"))
    ev = M.evaluate(t, ["model_version"], threshold=0.5)
    metrics = ev.select("model_version", F.create_map(*[x for m in ("accuracy", "auc", "f1", "precision", "recall")
                                                        for x in (F.lit(m), F.col(m))]).alias("metrics"))
    rs = RP.replay_summary(_replay(spark, sf_dir), ["model_version"]).select(
        "model_version", "prediction_mismatches", "max_probability_difference")
    summary, _ = checks(spark, sf_dir)
    latest = D.latest_per_group(summary.withColumn("_one", F.lit(1)), ["_one"], ["window_start", "model_name"]).select(
        F.col("severity").alias("latest_drift_severity"))
    newest = t.agg(F.max("model_version").alias("loaded_model_version"))
    c = attach(attach(metrics.join(rs, "model_version", "left"), latest), newest)
    art = F.create_map(*[x for a in P.ARTIFACTS for x in (
        F.lit(a), (F.lit(a) != "model_card_artifact_exists") | (F.col("model_version") != F.col("loaded_model_version")))])
    return c.select(
        F.concat(F.lit("promote_"), F.col("model_version")).alias("request_id"),
        F.lit(MODEL).alias("model_name"), "model_version", art.alias("artifacts"), F.lit(True).alias("model_loaded"),
        F.lit(MODEL).alias("loaded_model_name"), "loaded_model_version", F.lit(True).alias("human_approved"),
        "metrics", "prediction_mismatches", "max_probability_difference",
        F.lit(None).cast("string").alias("replay_error"), "latest_drift_severity",
        F.when(F.col("model_version") >= "2000", F.struct(
            F.concat(F.lit("drift_check_"), F.col("model_version")).alias("event_id"),
            F.lit("critical").alias("severity"))).alias("drift_context"))


def _cand_sql() -> str:
    from vigil.plans.ml_q import T_SQL, _sql_auc, _sql_metrics
    return f"""{checks_cte()}, {T_SQL}, {REPLAY_SQL},
ty AS (SELECT t.*, CAST(year(l_shipdate) AS VARCHAR) AS model_version FROM t),
met AS (SELECT * FROM {_sql_metrics('ty', 'model_version', '0.5')} JOIN {_sql_auc('ty', 'model_version')}
        USING (model_version)),
latest AS (SELECT severity AS sev FROM checks ORDER BY window_start DESC, model_name DESC LIMIT 1),
newest AS (SELECT max(model_version) AS loaded FROM ty),
cand AS (SELECT m.*, r.prediction_mismatches, r.max_probability_difference, latest.sev, newest.loaded
         FROM met m LEFT JOIN rsum r USING (model_version), latest, newest),
chk AS (
  SELECT model_version, 0 AS seq, 'model_artifact_exists' AS name, true AS passed FROM cand
  UNION ALL SELECT model_version, 1, 'schema_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 2, 'runtime_config_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 3, 'reference_stats_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 4, 'metrics_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 5, 'environment_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 6, 'replay_fixture_artifact_exists', true FROM cand
  UNION ALL SELECT model_version, 7, 'model_card_artifact_exists', model_version <> loaded FROM cand
  UNION ALL SELECT model_version, 8, 'model_loaded', true FROM cand
  UNION ALL SELECT model_version, 9, 'human_approval_present', true FROM cand
  UNION ALL SELECT model_version, 10, 'requested_model_name_matches_registry', true FROM cand
  UNION ALL SELECT model_version, 11, 'requested_model_version_matches_loaded_model', model_version = loaded FROM cand
  UNION ALL SELECT model_version, 12, 'metric_accuracy', coalesce(accuracy >= 0.8, false) FROM cand
  UNION ALL SELECT model_version, 13, 'metric_precision', coalesce(precision >= 0.7, false) FROM cand
  UNION ALL SELECT model_version, 14, 'metric_recall', coalesce(recall >= 0.75, false) FROM cand
  UNION ALL SELECT model_version, 15, 'metric_f1', coalesce(f1 >= 0.7, false) FROM cand
  UNION ALL SELECT model_version, 16, 'metric_auc', coalesce(auc >= 0.8, false) FROM cand
  UNION ALL SELECT model_version, 17, 'replay_prediction_mismatches', prediction_mismatches <= 0 FROM cand
  UNION ALL SELECT model_version, 18, 'replay_probability_difference', max_probability_difference <= 1e-12 FROM cand
  UNION ALL SELECT model_version, 19,
    CASE WHEN model_version >= '2000' THEN 'promotion_has_drift_context' ELSE 'latest_drift_severity' END,
    CASE WHEN model_version >= '2000' THEN true ELSE sev = 'normal' END FROM cand)"""


@query("promotion_checklist", sql=f"WITH {_cand_sql()} SELECT model_version, seq, name, passed FROM chk")
def promotion_checklist(spark, sf_dir):
    return P.promotion_checklist(candidates(spark, sf_dir)).select("model_version", "seq", "name", "passed")


@query("promotion_decide", sql=f"WITH {_cand_sql()} SELECT 'promote_' || model_version AS request_id, model_version, "
       "promoted, n_failed, CASE WHEN promoted THEN "
       f"'Model ''{MODEL}'' version ''' || model_version || ''' promoted to Production.' ELSE "
       "'Promotion blocked because checklist failed.' END AS message FROM (SELECT model_version, bool_and(passed) AS "
       "promoted, count(*) FILTER (WHERE NOT passed) AS n_failed FROM chk GROUP BY model_version)")
def promotion_decide(spark, sf_dir):
    d = P.promotion_decide(candidates(spark, sf_dir))
    return d.select("request_id", "model_version", "promoted", "n_failed", "message")


@query("metric_rows", sql=f"WITH {_cand_sql()} SELECT model_version, metric, round(value, 6) AS value FROM (UNPIVOT "
       "(SELECT model_version, accuracy, auc, f1, precision, recall FROM cand) ON accuracy, auc, f1, precision, recall "
       "INTO NAME metric VALUE value)")
def metric_rows(spark, sf_dir):
    """Metric map → one row per metric (the registry / dashboard view)."""
    c = candidates(spark, sf_dir)
    return c.select("model_version", F.explode("metrics").alias("metric", "value")).select(
        "model_version", "metric", r6("value").alias("value"))


ROLLBACK_SQL = """apr AS (SELECT 'apr_' || CAST(o_orderkey AS VARCHAR) AS approval_id,
  'inv_' || CAST(o_orderkey AS VARCHAR) AS investigation_id, o_orderdate AS created_at, o_orderpriority,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'rejected' WHEN 'F' THEN 'approved' END AS status
  FROM orders),
req AS (SELECT investigation_id, approval_id, 'rollback_production' AS requested_action, 'production' AS
  target_environment, 'lineitem_returns' AS model_name,
  CASE WHEN status = 'approved' THEN CAST(year(created_at) AS VARCHAR) END AS model_version FROM apr
  WHERE o_orderpriority = '1-URGENT'),
loaded AS (SELECT CAST(max(year(l_shipdate)) AS VARCHAR) AS v FROM lineitem),
reg AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS v, CASE WHEN year(l_shipdate) % 2 = 0 THEN 'archived'
  ELSE 'candidate' END AS stage FROM lineitem)"""


def _rollback_requests(spark, sf_dir):
    apr = approvals_ledger(spark, sf_dir).join(
        read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    loaded = training_frame(spark, sf_dir).agg(F.max(F.year("l_shipdate")).cast("string").alias("loaded_model_version"))
    req = apr.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.lit(None).cast("string").alias("request_id"), "investigation_id", "approval_id",
        F.lit("rollback_production").alias("requested_action"), F.lit("production").alias("target_environment"),
        F.lit(MODEL).alias("model_name"),
        F.when(F.col("status") == "approved", F.year("created_at").cast("string")).alias("model_version"))
    req = attach(req, loaded).withColumn("loaded_model_name", F.lit(MODEL))
    years = training_frame(spark, sf_dir).select(F.year("l_shipdate").alias("y")).distinct()
    registry = years.select(F.lit(MODEL).alias("model_name"), F.col("y").cast("string").alias("model_version"),
                            F.when(F.col("y") % 2 == 0, "archived").otherwise("candidate").alias("model_stage"))
    return req, registry


@query("rollback_decide", sql=f"""WITH {ROLLBACK_SQL}
SELECT 'rollback_' || investigation_id || '_' || approval_id || '_' || coalesce(model_version, 'unknown') ||
  '_production' AS request_id, coalesce(model_version, loaded.v) AS target_model_version, reg.stage AS previous_stage,
  coalesce(model_version, loaded.v) = loaded.v AS rolled_back,
  CASE WHEN coalesce(model_version, loaded.v) = loaded.v THEN 'production' ELSE reg.stage END AS new_stage
FROM req CROSS JOIN loaded LEFT JOIN reg ON reg.v = coalesce(req.model_version, loaded.v)""")
def rollback_decide(spark, sf_dir):
    req, registry = _rollback_requests(spark, sf_dir)
    d = P.rollback_decide(req, registry)
    return d.select("request_id", "target_model_version", "previous_stage", "rolled_back", "new_stage")


# ---- requests against the ledgers and the registry, committed together ---------------------------------------------
_AUC = [("auc", 0.5)]
_STORED = "Stored by an earlier batch."


@query("promotion_commit", sql=f"""WITH {_cand_sql()},
dec AS (SELECT model_version, CAST(model_version AS INTEGER) % 2 = 0 AS stored, coalesce(auc >= 0.5, false)
  AND prediction_mismatches <= 0 AND max_probability_difference <= 1e-12
  AND (model_version >= '2000' OR sev = 'normal') AS passed FROM cand)
SELECT 'promote_' || model_version AS request_id, arrived, stored OR arrived = 2 AS duplicate,
  CASE WHEN stored THEN true ELSE passed END AS promoted,
  CASE WHEN stored THEN '{_STORED}' WHEN passed THEN 'Model ''{MODEL}'' version ''' || model_version ||
    ''' promoted to Production.' ELSE 'Promotion blocked because checklist failed.' END AS message,
  CASE WHEN stored THEN 'candidate' WHEN passed THEN 'production' END AS registry_stage,
  CASE WHEN NOT stored AND passed THEN 0.5::DOUBLE END AS selected_threshold,
  CASE WHEN stored OR passed THEN 1 ELSE 0 END AS registry_rows
FROM dec CROSS JOIN (VALUES (1), (2)) a(arrived)""")
def promotion_commit(spark, sf_dir):
    """Every candidate asks twice, the second time without approval; even years were decided by an earlier batch. One commit
    holds the new decisions and the registry rows of the promoted versions."""
    from vigil.operators import decisions as DE
    from vigil.streaming.runner import scratch_path, written
    c = written(candidates(spark, sf_dir), "candidates").withColumn("loaded_model_version", F.col("model_version"))
    c = c.withColumn("artifacts", F.transform_values("artifacts", lambda k, v: F.lit(True))).withColumn(
        "selected_threshold", F.lit(0.5))
    tables = DE.decision_tables(spark, scratch_path(spark, "decisions"))
    even = c.where(F.col("model_version").cast("int") % 2 == 0)
    _, empty = tables.read()
    stored = even.select("request_id", "model_name", "model_version", F.lit("promote_to_production").alias("requested_action"),
                         F.lit("production").alias("target_environment"), F.lit(True).alias("promoted"),
                         F.lit(_STORED).alias("message"), F.array().cast(P.CHECKS_TYPE).alias("checklist"))
    held = even.select("model_name", "model_version", F.lit("candidate").alias("model_stage"))
    tables.commit(-1, {"promotions": stored}, {"registry": empty["registry"].unionByName(held, allowMissingColumns=True)})
    asked = c.withColumn("arrived", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "human_approved", F.col("arrived") == 1)
    got = DE.request_promotions(tables, asked, ["arrived"], _AUC)
    registry = tables.read()[1]["registry"].groupBy("model_version").agg(
        F.max("model_stage").alias("registry_stage"), F.max("selected_threshold").alias("selected_threshold"),
        F.count("*").cast("int").alias("registry_rows"))
    return got.join(registry, "model_version", "left").select(
        "request_id", "arrived", "duplicate", "promoted", "message", "registry_stage", "selected_threshold",
        F.coalesce("registry_rows", F.lit(0)).alias("registry_rows"))


@query("rollback_commit", sql=f"""WITH {ROLLBACK_SQL},
r AS (SELECT 'rollback_' || investigation_id || '_' || approval_id || '_' || coalesce(model_version, 'unknown') ||
  '_production' AS request_id, coalesce(model_version, loaded.v) AS version, reg.stage,
  CASE WHEN CAST(substr(approval_id, 5) AS BIGINT) % 5 = 0 THEN 'staging' ELSE target_environment END AS env,
  CAST(substr(approval_id, 5) AS BIGINT) % 3 = 0 AS stored, loaded.v AS loaded
  FROM req CROSS JOIN loaded LEFT JOIN reg ON reg.v = coalesce(req.model_version, loaded.v)),
d AS (SELECT *, env = 'production' AND version = loaded AS ok FROM r),
led AS (SELECT version, min(request_id) AS first_id FROM d WHERE ok AND NOT stored GROUP BY ALL),
e AS (SELECT d.*, CASE WHEN NOT stored AND request_id > first_id THEN 'production' ELSE stage END AS previous FROM d
      LEFT JOIN led USING (version))
SELECT request_id, arrived, stored OR arrived = 2 AS duplicate, version AS model_version,
  CASE WHEN stored THEN false ELSE ok END AS rolled_back, CASE WHEN stored THEN NULL ELSE previous END AS previous_stage,
  CASE WHEN stored THEN NULL WHEN ok THEN 'production' ELSE previous END AS new_stage,
  CASE WHEN stored THEN '{_STORED}' WHEN ok THEN 'Rollback completed. Model ''{MODEL}'' version ''' || version ||
    ''' is now marked as Production.' WHEN env <> 'production' THEN
    'Rollback blocked: target_environment must be production.' ELSE 'Rollback blocked: Requested model_version ''' ||
    version || ''' does not match currently loaded model_version ''' || loaded || '''.' END AS message
FROM e CROSS JOIN (VALUES (1), (2)) a(arrived)""")
def rollback_commit(spark, sf_dir):
    """Every rollback request comes twice, a third of them was decided before, a fifth names another environment; decisions
    and registry are one commit."""
    from vigil.operators import decisions as DE
    from vigil.streaming.runner import scratch_path, written
    req, registry = _rollback_requests(spark, sf_dir)
    number = F.substring("approval_id", 5, 20).cast("long")
    req = written(req.withColumn("request_id", P.rollback_request_id(
        F.col("investigation_id"), F.col("approval_id"), F.col("model_version"))).withColumn(
        "target_environment", F.when(number % 5 == 0, "staging").otherwise(F.col("target_environment"))), "requests")
    tables = DE.decision_tables(spark, scratch_path(spark, "decisions"))
    _, empty = tables.read()
    target = F.coalesce("model_version", "loaded_model_version")
    stored = req.where(number % 3 == 0).withColumn("model_version", target).withColumn("rolled_back", F.lit(False)).withColumn(
        "message", F.lit(_STORED)).drop("loaded_model_name", "loaded_model_version")
    tables.commit(-1, {"rollbacks": empty["rollbacks"].unionByName(stored, allowMissingColumns=True)},
                  {"registry": empty["registry"].unionByName(registry, allowMissingColumns=True)})
    asked = req.withColumn("arrived", F.explode(F.array(F.lit(1), F.lit(2))))
    return DE.request_rollbacks(tables, asked, ["arrived"]).select(
        "request_id", "arrived", "duplicate", "model_version", "rolled_back", "previous_stage", "new_stage", "message")
