"""Decision-table queries over the drift events derived from the daily checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import decide as DC
from vigil.operators.events import drift_events
from vigil.plans.drift_q import G, checks
from vigil.plans.registry import query
from vigil.plans.sqlparts import events_cte


def drift_event_table(spark, sf_dir):
    summary, feats = checks(spark, sf_dir)
    return drift_events(summary, feats, G, ["window_start"])


def investigations(spark, sf_dir):
    return DC.investigate(drift_event_table(spark, sf_dir))


def _sql_text(d: dict, key: str) -> str:
    return "'" + d[key].replace("'", "''") + "'"


E, R = DC.EXPLANATIONS, DC.REASONS


@query("triage", sql=f"WITH {events_cte()} SELECT event_id, new_severity AS severity, risk_level, primary_issue, "
       "CASE new_severity WHEN 'insufficient_data' THEN " + _sql_text(E, "insufficient_data")
       + " WHEN 'normal' THEN " + _sql_text(E, "normal") + " WHEN 'warning' THEN " + _sql_text(E, "warning")
       + " ELSE " + _sql_text(E, "critical") + " END AS explanation, replace(drifted, ', ', ',') AS drifted_features, "
       "output_drift_severity FROM tri")
def triage(spark, sf_dir):
    t = DC.triage(drift_event_table(spark, sf_dir))
    return t.select("event_id", "triage.severity", "triage.risk_level", "triage.primary_issue",
                    "triage.explanation", F.array_join("triage.drifted_features", ",").alias("drifted_features"),
                    "triage.output_drift_severity")


@query("action_route", sql=f"WITH {events_cte()} SELECT event_id, recommended_action, production_action_required, "
       "queue_job_required, target_environment, CASE "
       "WHEN new_severity = 'insufficient_data' THEN " + _sql_text(R, "insufficient")
       + " WHEN recommended_action = 'resolve' THEN " + _sql_text(R, "resolve")
       + " WHEN recommended_action = 'monitor' THEN " + _sql_text(R, "monitor")
       + " WHEN recommended_action = 'replay_test' THEN " + _sql_text(R, "replay")
       + " WHEN recommended_action = 'rollback_production' THEN " + _sql_text(R, "rollback")
       + " WHEN recommended_action = 'retrain' THEN " + _sql_text(R, "retrain")
       + " END AS reason FROM act2")
def action_route(spark, sf_dir):
    inv = investigations(spark, sf_dir)
    return inv.select("event_id", "action.recommended_action", "action.production_action_required",
                      "action.queue_job_required", "action.target_environment", "action.reason")


_SUMMARY_SQL = (
    "'Investigation ' || investigation_id || ': drift severity changed from ' || previous_severity || ' to ' || "
    "new_severity || ' for model ' || model_name || ' version unknown. Primary issue: ' || primary_issue || "
    "'. Drifted features: ' || CASE WHEN drifted = '' THEN " + _sql_text({"x": DC.NO_FEATURES_TEXT}, "x")
    + " ELSE drifted END || '. Recommended action: ' || recommended_action || '. Reason: ' || CASE "
    "WHEN new_severity = 'insufficient_data' THEN " + _sql_text(R, "insufficient")
    + " WHEN recommended_action = 'resolve' THEN " + _sql_text(R, "resolve")
    + " WHEN recommended_action = 'monitor' THEN " + _sql_text(R, "monitor")
    + " WHEN recommended_action = 'replay_test' THEN " + _sql_text(R, "replay")
    + " WHEN recommended_action = 'rollback_production' THEN " + _sql_text(R, "rollback")
    + " WHEN recommended_action = 'retrain' THEN " + _sql_text(R, "retrain")
    + " END || ' Next step: ' || CASE WHEN production_action_required THEN 'waiting for human approval in the "
    "dashboard' WHEN queue_job_required THEN 'dispatching a Redis background job' WHEN recommended_action = "
    "'resolve' THEN 'resolving the investigation' ELSE 'continuing to monitor' END || '.'")


@query("investigation_summary_text", sql=f"WITH {events_cte()} SELECT investigation_id, {_SUMMARY_SQL} AS summary "
       "FROM act2")
def investigation_summary_text(spark, sf_dir):
    return investigations(spark, sf_dir).select("investigation_id", "summary")


@query("agent_trace", sql=f"""WITH {events_cte()},
msgs AS (
  SELECT investigation_id, production_action_required AS need, queue_job_required AS job, recommended_action AS ra,
    CASE WHEN production_action_required
      THEN ['supervisor', 'triage', 'supervisor', 'action', 'supervisor', 'approval', 'supervisor', 'comms',
            'supervisor', 'completion', 'supervisor']
      ELSE ['supervisor', 'triage', 'supervisor', 'action', 'supervisor', 'comms', 'supervisor', 'completion',
            'supervisor'] END AS nodes
  FROM act2)
SELECT investigation_id, i - 1 AS seq, 'agent' AS role, nodes[i] AS node_name,
       CASE WHEN need OR job THEN 'running' WHEN ra IN ('monitor', 'resolve') THEN 'resolved' ELSE 'running' END
         AS status, 'agent_decision_completed' AS current_step
FROM msgs, range(1, len(nodes) + 1) t(i)""")
def agent_trace(spark, sf_dir):
    return DC.agent_trace(investigations(spark, sf_dir)).select(
        "investigation_id", "seq", "role", "node_name", "status", "current_step")


@query("apply_decision", sql=f"""WITH {events_cte()}
SELECT investigation_id, event_id,
  CASE WHEN production_action_required THEN 'approval' WHEN queue_job_required THEN 'job'
       WHEN recommended_action IN ('monitor', 'resolve') THEN 'resolved' ELSE 'none' END AS effect,
  CASE WHEN production_action_required THEN 'waiting_for_approval' WHEN queue_job_required THEN 'waiting_for_job'
       WHEN recommended_action IN ('monitor', 'resolve') THEN 'resolved' ELSE 'running' END AS status,
  CASE WHEN production_action_required THEN recommended_action END AS requested_action,
  CASE WHEN production_action_required THEN target_environment END AS target_environment,
  CASE WHEN queue_job_required THEN recommended_action END AS job_type,
  CASE WHEN queue_job_required THEN recommended_action || ':' || investigation_id || ':unknown' END AS idempotency_key
FROM act2""")
def apply_decision(spark, sf_dir):
    return DC.apply_decision(investigations(spark, sf_dir)).select(
        "investigation_id", "event_id", "effect", "status", "requested_action", "target_environment", "job_type",
        "idempotency_key")
