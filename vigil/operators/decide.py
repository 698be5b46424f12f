"""Decision tables over drift events: triage, action routing, the agent's net trace, applying decisions.

Every rule is a column expression (``when`` chains, struct results), so a
stream or a table of millions of events is routed by one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.events import drifted_features, output_severity, primary_issue

# ---- fixed texts the decisions carry (kept equal to the monitored system's wording) -----------------------
EXPLANATIONS = {
    "insufficient_data": ("The platform does not have enough recent predictions to make a reliable "
                          "drift decision yet."),
    "normal": "The latest drift check is normal. No immediate model action is required.",
    "warning": ("Warning-level drift was detected. A replay test should verify whether "
                "the model service still behaves as expected."),
    "critical": ("Critical drift was detected. The model may be unsafe for Production, "
                 "so a stronger action may be required."),
}
REASONS = {
    "insufficient": ("There is not enough drift data yet. Keep collecting predictions "
                     "before dispatching replay, retrain, or rollback tools."),
    "resolve": "Drift severity recovered to normal. Resolve the investigation without touching Production.",
    "monitor": "Drift is normal. Continue monitoring.",
    "replay": ("Warning drift should first dispatch a replay test to confirm that "
               "the serving path, preprocessing, and model artifacts are still stable."),
    "rollback": ("Critical drift after a warning state or critical output drift can "
                 "indicate Production risk. Request human approval before rollback."),
    "retrain": ("Critical feature drift was detected. Retraining can create a new "
                "candidate model and consume training resources, so it requires human "
                "approval before the Redis retrain job is queued."),
    "default": "No matching route was found. Defaulting to monitor.",
}
NO_FEATURES_TEXT = "no individual warning/critical feature listed"
COMPLETION_TEXTS = {
    "approval": ("Agent decision completed. The service layer will create a human approval "
                 "request before the selected action is executed."),
    "job": "Agent decision completed. The service layer will enqueue the selected background job in Redis.",
    "resolved": "Agent decision completed. No approval or queue job is required.",
    "other": "Agent decision completed.",
}
APPROVAL_NOT_REQUIRED_TEXT = "Approval node checked the action. Human approval is not required."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def effective_severity(df_severity, new_severity=None) -> Column:
    """``severity or new_severity or 'normal'``."""
    parts = [_c(df_severity)] + ([_c(new_severity)] if new_severity is not None else [])
    return F.coalesce(*[F.when(p != "", p) for p in parts], F.lit("normal"))


def triage(events: DataFrame, severity_col: str = "new_severity", report_col: str = "drift_report") -> DataFrame:
    """Adds ``triage`` struct: severity, risk_level, primary_issue, explanation, drifted_features,
    output_drift_severity."""
    sev = effective_severity(severity_col)
    rep = F.col(report_col)
    risk = (F.when(sev == "critical", "high").when(sev == "warning", "medium")
            .when(sev == "insufficient_data", "unknown").otherwise("low"))
    expl = (F.when(sev == "insufficient_data", EXPLANATIONS["insufficient_data"])
            .when(sev == "normal", EXPLANATIONS["normal"]).when(sev == "warning", EXPLANATIONS["warning"])
            .otherwise(EXPLANATIONS["critical"]))
    return events.withColumn("triage", F.struct(
        sev.alias("severity"), risk.alias("risk_level"),
        F.coalesce(primary_issue(rep), F.lit("no_strong_drift_signal")).alias("primary_issue"),
        expl.alias("explanation"),
        F.coalesce(drifted_features(rep), F.array().cast("array<string>")).alias("drifted_features"),
        output_severity(rep).alias("output_drift_severity")))


def action_route(df: DataFrame, severity_col: str = "new_severity",
                 previous_col: str = "previous_severity") -> DataFrame:
    """Adds ``action`` struct: recommended_action, production_action_required, queue_job_required,
    target_environment, reason. Needs the ``triage`` column (for output drift severity)."""
    sev = effective_severity(severity_col)
    prev = F.col(previous_col)
    out = F.col("triage.output_drift_severity")

    def route(action, prod, job, env, reason):
        return F.struct(F.lit(action).alias("recommended_action"), F.lit(prod).alias("production_action_required"),
                        F.lit(job).alias("queue_job_required"), F.lit(env).cast("string").alias("target_environment"),
                        F.lit(reason).alias("reason"))

    rule = (F.when(sev == "insufficient_data", route("monitor", False, False, None, REASONS["insufficient"]))
            .when((sev == "normal") & prev.isNotNull() & (prev != "") & (prev != "normal"),
                  route("resolve", False, False, None, REASONS["resolve"]))
            .when(sev == "normal", route("monitor", False, False, None, REASONS["monitor"]))
            .when(sev == "warning", route("replay_test", False, True, None, REASONS["replay"]))
            .when((sev == "critical") & ((F.coalesce(prev, F.lit("")) == "warning")
                                         | (F.coalesce(out, F.lit("")) == "critical")),
                  route("rollback_production", True, False, "production", REASONS["rollback"]))
            .when(sev == "critical", route("retrain", True, False, "candidate", REASONS["retrain"]))
            .otherwise(route("monitor", False, False, None, REASONS["default"])))
    return df.withColumn("action", rule)


def investigation_id(event_id) -> Column:
    """Deterministic short id ``inv_`` + 12 hex of the event id (a retry yields the same id)."""
    return F.concat(F.lit("inv_"), F.substring(F.sha2(_c(event_id).cast("string"), 256), 1, 12))


def summary_text(inv_id, severity, previous, model, version) -> Column:
    """The investigation summary sentence; needs ``triage`` and ``action`` columns."""
    feats = F.col("triage.drifted_features")
    ftext = F.when(F.size(feats) > 0, F.array_join(feats, ", ")).otherwise(F.lit(NO_FEATURES_TEXT))
    ra = F.coalesce(F.col("action.recommended_action"), F.lit("monitor"))
    nxt = (F.when(F.col("action.production_action_required"), "waiting for human approval in the dashboard")
           .when(F.col("action.queue_job_required"), "dispatching a Redis background job")
           .when(ra == "resolve", "resolving the investigation").otherwise("continuing to monitor"))
    return F.concat(
        F.lit("Investigation "), F.coalesce(_c(inv_id), F.lit("unknown")),
        F.lit(": drift severity changed from "), F.coalesce(_c(previous), F.lit("unknown")),
        F.lit(" to "), F.coalesce(_c(severity), F.lit("unknown")), F.lit(" for model "),
        F.coalesce(_c(model), F.lit("unknown")), F.lit(" version "),
        F.coalesce(F.when(_c(version) != "", _c(version)), F.lit("unknown")),
        F.lit(". Primary issue: "), F.coalesce(F.col("triage.primary_issue"), F.lit("unknown")),
        F.lit(". Drifted features: "), ftext, F.lit(". Recommended action: "), ra,
        F.lit(". Reason: "), F.coalesce(F.col("action.reason"), F.lit("No reason provided.")),
        F.lit(" Next step: "), nxt, F.lit("."))


def investigate(events: DataFrame) -> DataFrame:
    """Triage + action + ids + summary for each drift event (one narrow projection)."""
    df = triage(events)
    df = action_route(df)
    df = df.withColumn("investigation_id", investigation_id("event_id"))
    df = df.withColumn("graph_thread_id", F.concat(F.lit("thread_"), F.col("investigation_id")))
    return df.withColumn("summary", summary_text("investigation_id", "triage.severity", "previous_severity",
                                                 "model_name", "model_version"))


def _msg(node: str, content: Column, role: str = "agent") -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(node).alias("node_name"), content.alias("content"))


def _bool_text(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def agent_trace(inv: DataFrame) -> DataFrame:
    """The agent's ordered messages per investigation (9 without approval, 11 with), one row each.

    Output: investigation_id, seq, role, node_name, content, plus final ``status`` / ``current_step``.
    """
    a = F.col("action")
    t = F.col("triage")
    need = a["production_action_required"]
    sup = lambda nxt: _msg("supervisor", F.concat(F.lit("Supervisor routed the investigation to: "),
                                                  F.lit(nxt) if isinstance(nxt, str) else nxt, F.lit(".")))
    triage_txt = F.concat(F.lit("Triage completed. Severity="), t["severity"], F.lit(", risk_level="),
                          t["risk_level"], F.lit(", primary_issue="), t["primary_issue"], F.lit("."))
    action_txt = F.concat(F.lit("Action decision completed. Recommended action="), a["recommended_action"],
                          F.lit(", production_action_required="), _bool_text(need),
                          F.lit(", queue_job_required="), _bool_text(a["queue_job_required"]), F.lit("."))
    approval_txt = F.concat(F.lit("Human approval is required before executing action '"),
                            F.coalesce(a["recommended_action"], F.lit("unknown")),
                            F.lit("' for target environment '"),
                            F.coalesce(a["target_environment"], F.lit("production")), F.lit("'."))
    ra = a["recommended_action"]
    completion_txt = (F.when(need, COMPLETION_TEXTS["approval"]).when(a["queue_job_required"], COMPLETION_TEXTS["job"])
                      .when(ra.isNull() | ra.isin("monitor", "resolve"), COMPLETION_TEXTS["resolved"])
                      .otherwise(COMPLETION_TEXTS["other"]))
    head = [sup("triage"), _msg("triage", triage_txt), sup("action"), _msg("action", action_txt)]
    tail = [_msg("comms", F.col("summary")), sup("completion"), _msg("completion", completion_txt), sup("end")]
    with_approval = F.array(*head, sup("approval"), _msg("approval", approval_txt), sup("comms"), *tail)
    without = F.array(*head, sup("comms"), *tail)
    status = (F.when(need | a["queue_job_required"], "running")
              .when(ra.isNull() | ra.isin("monitor", "resolve"), "resolved").otherwise("running"))
    return (inv.select("investigation_id", F.when(need, with_approval).otherwise(without).alias("_m"),
                       status.alias("status"), F.lit("agent_decision_completed").alias("current_step"))
            .select("investigation_id", "status", "current_step", F.posexplode("_m").alias("seq", "m"))
            .select("investigation_id", "seq", "m.role", "m.node_name", "m.content", "status", "current_step"))


def apply_decision(inv: DataFrame) -> DataFrame:
    """Service-side effect of each decision: approval request, queued job, or resolution.

    Returns one row per investigation with ``effect`` in (approval, job, resolved, none), the
    final ``status``/``current_step``, and the approval / job fields (null when not applicable).
    """
    a = F.col("action")
    ra = a["recommended_action"]
    need = a["production_action_required"]
    job = a["queue_job_required"] & ra.isNotNull()
    resolved = ra.isNull() | ra.isin("monitor", "resolve")
    effect = F.when(need, "approval").when(job, "job").when(resolved, "resolved").otherwise("none")
    version = F.coalesce(F.when(F.col("model_version") != "", F.col("model_version")), F.lit("unknown"))
    return inv.select(
        "investigation_id", "event_id", "model_name", "model_version",
        effect.alias("effect"),
        F.when(need, "waiting_for_approval").when(job, "waiting_for_job").when(resolved, "resolved")
        .otherwise("running").alias("status"),
        F.when(need, "waiting_for_approval").when(job, "waiting_for_job").when(resolved, "completed")
        .otherwise("agent_decision_completed").alias("current_step"),
        F.when(need, F.coalesce(ra, F.lit("unknown"))).alias("requested_action"),
        F.when(need, F.coalesce(a["target_environment"], F.lit("production"))).alias("target_environment"),
        F.when(job, ra).alias("job_type"),
        F.when(job, F.concat_ws(":", ra, F.col("investigation_id"), version)).alias("idempotency_key"),
        F.when(resolved & ~need & ~job, F.col("summary")).alias("resolution_summary"),
    )
