"""State transitions driven by job results and approval decisions, applied to whole batches.

Each batch is joined to the current state it changes (left joins, no fan-out:
the right sides are one row per key), and the transition table is a ``when``
chain. Sequential semantics inside a batch (a later result sees the approval an
earlier one created) come from the first result per key (a map-side ``min_by``), not from a loop. Ledgers grow with
the data and read small from compressed files, so their joins are merge joins by hint: none is broadcast by a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed texts of the transitions.
REPLAY_OK = ("Replay test completed successfully. The current model service matches the saved replay fixture, "
             "so no immediate Production change is required.")
REPLAY_FAIL = ("Replay test completed but failed. The model output does not match the saved replay fixture. "
               "Further investigation or retraining is needed.")
RETRAIN_INVALID = ("Retrain job completed at the queue level, but the retrain result does not say completed=true. "
                   "Review the worker result.")
CANDIDATE_MISSING = ("Retrain job completed, but the worker did not return a candidate model_version, so promotion "
                     "approval cannot be created.")
RETRAIN_NEW = ("Retrain job completed. A new candidate model is available and human approval is required before "
               "Production promotion.")
RETRAIN_EXISTS = "Retrain job completed and a promotion approval already exists for candidate model version "
ROLLBACK_DONE = "Rollback job completed."


def _truthy(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin("true", "1", "yes")


def apply_job_results(results: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """Investigation effect of each job result.

    results: job_id, investigation_id, job_type, status, result map<string,string>, error_message, finished_at.
    approvals (prior state): investigation_id, requested_action, model_version, status.
    Returns per result: new_status, current_step, summary, creates_approval, approval_id (new or existing).
    """
    r = results.withColumn("_version", F.when(F.trim(F.col("result")["model_version"]) != "",
                                               F.col("result")["model_version"]))
    completed_ok = _truthy(F.col("result")["completed"])
    valid_retrain = (F.col("status") == "completed") & (F.col("job_type") == "retrain") & completed_ok & \
        F.col("_version").isNotNull()
    if approvals is not None:
        prior = (approvals.where((F.col("requested_action") == "promote_to_production")
                                 & F.col("status").isin("pending", "approved"))
                 .select("investigation_id", F.col("model_version").alias("_version"),
                         F.lit(True).alias("_prior")).distinct())
        r = r.join(prior.hint("merge"), ["investigation_id", "_version"], "left")
        if "approval_id" in approvals.columns:  # the newest of that action and version, whatever its status, names it
            named = (approvals.where(F.col("requested_action") == "promote_to_production")
                     .groupBy("investigation_id", F.col("model_version").alias("_version"))
                     .agg(F.max_by("approval_id", F.struct("created_at", "approval_id")).alias("_stored_id")))
            r = r.join(named.hint("merge"), ["investigation_id", "_version"], "left")
    else:
        r = r.withColumn("_prior", F.lit(None).cast("boolean"))
    if "_stored_id" not in r.columns:
        r = r.withColumn("_stored_id", F.lit(None).cast("string"))
    # the first valid retrain of a (investigation, version) in the batch creates the approval; later ones see it
    first = (r.where(valid_retrain).groupBy("investigation_id", "_version")
             .agg(F.min_by("job_id", F.struct("finished_at", "job_id")).alias("_first_job")))
    r = r.join(first.hint("merge"), ["investigation_id", "_version"], "left")
    exists = F.coalesce(F.col("_prior"), F.lit(False)) | (F.col("job_id") != F.col("_first_job"))
    st, jt = F.col("status"), F.col("job_type")
    passed = _truthy(F.col("result")["passed"])
    err = F.coalesce(F.col("error_message"), F.lit("Unknown error"))

    def out(status, step, summary):
        return F.struct(F.lit(status).alias("new_status"), F.lit(step).alias("current_step"),
                        (summary if isinstance(summary, Column) else F.lit(summary)).alias("summary"))
    rule = (F.when((st == "completed") & (jt == "replay_test") & passed,
                   out("resolved", "replay_test_completed", REPLAY_OK))
            .when((st == "completed") & (jt == "replay_test"), out("failed", "replay_test_failed", REPLAY_FAIL))
            .when((st == "completed") & (jt == "retrain") & ~completed_ok,
                  out("failed", "retrain_result_invalid", RETRAIN_INVALID))
            .when((st == "completed") & (jt == "retrain") & F.col("_version").isNull(),
                  out("failed", "candidate_model_missing", CANDIDATE_MISSING))
            .when(valid_retrain & exists, out("waiting_for_approval", "promotion_approval_pending", F.concat(
                F.lit(RETRAIN_EXISTS), F.col("_version"), F.lit("."))))
            .when(valid_retrain, out("waiting_for_approval", "promotion_approval_pending", RETRAIN_NEW))
            .when((st == "completed") & (jt == "rollback"), out("resolved", "rollback_completed", ROLLBACK_DONE))
            .when(st == "dlq", out("failed", "job_dlq", F.concat(
                F.lit("Job "), F.col("job_id"), F.lit(" was moved to DLQ after retries. Reason: "), err)))
            .when(st == "failed", out("failed", "job_failed", F.concat(
                F.lit("Job "), F.col("job_id"), F.lit(" failed. Reason: "), err))))
    new_id = F.concat(F.lit("approval_"), F.substring(F.sha2(F.concat_ws("|", "investigation_id", "_version"), 256),
                                                      1, 12))
    return r.select(
        "job_id", "investigation_id", "job_type", "status", F.col("_version").alias("candidate_model_version"),
        rule["new_status"].alias("new_status"), rule["current_step"].alias("current_step"),
        rule["summary"].alias("summary"),
        (valid_retrain & ~exists).alias("creates_approval"),
        F.when(valid_retrain, F.when(F.col("_prior"), F.coalesce("_stored_id", new_id)).otherwise(new_id)).alias("approval_id"))


def record_job_results(results: DataFrame, jobs: DataFrame, investigations: DataFrame, approvals: DataFrame) -> DataFrame:
    """Job results against the job ledger, the investigations and the approvals: one row a result.

    ``outcome``: ``unknown_job`` (an error, nothing else happens), ``investigation_missing`` (the job and its message are
    recorded, no transition), ``existing_approval`` (a pending or approved promotion of that version is there: its id is
    kept) or ``applied``. Besides ``apply_job_results``'s columns: ``error``, the job's new ``job_status`` and the tool
    message (``node_name``, ``content``, ``metadata`` as JSON). Every join is an equi-join on keys that the tables have
    once: jobs (job_id, others ignored), investigations (investigation_id, others ignored); approvals as in
    ``apply_job_results`` with approval_id and created_at. Equal results are applied alike.
    """
    known = jobs.select(F.col("job_id").alias("_job")).distinct().hint("merge")
    there = investigations.select(F.col("investigation_id").alias("_inv")).distinct().hint("merge")
    r = (results.join(known, F.col("job_id") == F.col("_job"), "left")
         .join(there, F.col("investigation_id") == F.col("_inv"), "left"))
    done = F.when(F.col("status") == "completed", F.lit(" completed.")).when(
        F.col("status") == "dlq", F.lit(" moved to DLQ.")).otherwise(F.lit(" failed."))
    meta = F.to_json(F.struct("job_id", "job_type", "status", "result", "error_message"))
    unknown = F.col("_job").isNull()
    base = r.select(
        "*", F.when(unknown, F.concat(F.lit("Unknown job_id: "), F.coalesce("job_id", F.lit("None")))).alias("error"),
        F.when(~unknown, F.when(F.col("status").isin("completed", "dlq"), F.col("status")).otherwise(F.lit("failed")))
        .alias("job_status"),
        F.when(~unknown, F.col("job_type")).alias("node_name"),
        F.when(~unknown, F.concat(F.lit("Job "), F.col("job_id"), done)).alias("content"),
        F.when(~unknown, meta).alias("metadata"))
    moves = apply_job_results(results.join(known, F.col("job_id") == F.col("_job"), "left_semi").join(
        there, F.col("investigation_id") == F.col("_inv"), "left_semi"), approvals)
    moves = moves.select(F.col("job_id").alias("_j"), F.col("investigation_id").alias("_i"), "candidate_model_version",
                         "new_status", "current_step", "summary", "creates_approval", "approval_id").distinct().hint("merge")
    out = base.join(moves, (F.col("job_id") == F.col("_j")) & (F.col("investigation_id") == F.col("_i"))
                    & ~unknown & F.col("_inv").isNotNull(), "left")
    outcome = (F.when(unknown, "unknown_job").when(F.col("_inv").isNull(), "investigation_missing")
               .when(F.col("approval_id").isNotNull() & ~F.col("creates_approval"), "existing_approval").otherwise("applied"))
    return out.select("job_id", "investigation_id", outcome.alias("outcome"), "error", "job_status", "node_name", "content",
                      "metadata", "candidate_model_version", "new_status", "current_step", "summary",
                      F.coalesce("creates_approval", F.lit(False)).alias("creates_approval"), "approval_id")


def existing_promotions(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Candidates (investigation_id, model_version) that a pending or approved promotion approval of theirs exists for."""
    held = approvals.where((F.col("requested_action") == "promote_to_production") & F.col("status").isin("pending", "approved"))
    return candidates.join(held.select("investigation_id", "model_version"), ["investigation_id", "model_version"], "left_semi")


def retrain_jobs(approvals: DataFrame, investigations: DataFrame) -> DataFrame:
    """(idempotency_key, payload): the retrain job of every approval. The model is the approval's; its version comes first,
    then the state's; event, severity and drift report are the state's, then those of the approval's request. An empty
    text counts as none. approvals: approval_id, investigation_id, approved_by, model_name, model_version,
    target_environment, requested_action, request_payload map; investigations: investigation_id, state map."""
    from vigil.functions.text import job_key

    def some(*cols: Column) -> Column:
        return F.coalesce(*[F.when(c != "", c) for c in cols])
    j = approvals.join(investigations.select("investigation_id", "state"), "investigation_id", "left")
    state, asked = F.col("state"), F.col("request_payload")
    version = some(F.col("model_version"), state["model_version"])
    both = [some(state[c], asked[c]).alias(c) for c in ("event_id", "severity", "drift_report")]
    payload = F.struct("investigation_id", "approval_id", "approved_by", "model_name", version.alias("model_version"),
                       "target_environment", *both, F.lit("retrain").alias("recommended_action"), "requested_action")
    return j.select(job_key(F.lit("retrain"), F.col("investigation_id"), version).alias("idempotency_key"), payload.alias("payload"))


def apply_approvals(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approve / reject decisions against current approvals: only pending ones change.

    decisions: approval_id, decision ('approve'|'reject'), actor, reason, decided_at (optional). Of several decisions
    on one approval the first counts (by decided_at, then decision, actor, reason); later ones get the error of an
    approval that is no longer pending. An exactly repeated row is the same decision and has the same effect.
    approvals: approval_id, investigation_id, requested_action, status, model_version.
    Returns the approval's new status, an ``error`` for missing / non-pending ones, the
    investigation effect and the side effect to run (job type or promotion call).
    """
    a = approvals.select("approval_id", "investigation_id", "requested_action", F.col("status").alias("_cur"),
                         "model_version")
    order = F.struct(*[c for c in ("decided_at", "decision", "actor", "reason") if c in decisions.columns])
    first = decisions.groupBy("approval_id").agg(F.min(order).alias("_first"))
    j = decisions.join(first, "approval_id", "left").join(a, "approval_id", "left")
    later = ~order.eqNullSafe(F.col("_first"))
    j = j.withColumn("_cur", F.when((F.col("_cur") == "pending") & later, F.when(
        F.col("_first.decision") == "approve", "approved").otherwise("rejected")).otherwise(F.col("_cur")))
    approve = F.col("decision") == "approve"
    err = (F.when(F.col("_cur").isNull(), F.concat(F.lit("Approval not found: "), F.coalesce("approval_id", F.lit("None"))))
           .when(F.col("_cur") != "pending", F.concat(F.lit("Approval "), F.col("approval_id"),
                                                      F.lit(" is not pending. Current status: "), F.col("_cur"))))
    ok = err.isNull()
    act = F.col("requested_action")
    side = (F.when(ok & approve & (act == "promote_to_production"), F.lit("promotion_request"))
            .when(ok & approve & (act == "rollback_production"), F.lit("rollback_job"))
            .when(ok & approve & (act == "retrain"), F.lit("retrain_job")))
    version = F.coalesce(F.col("model_version"), F.lit("unknown"))
    return j.select(
        "approval_id", "investigation_id", "decision", err.alias("error"),
        F.when(ok, F.when(approve, "approved").otherwise("rejected")).otherwise(F.col("_cur")).alias("new_status"),
        F.when(ok & approve, "running").when(ok, "resolved").alias("investigation_status"),
        F.when(ok & approve, F.concat(act, F.lit("_approved"))).when(ok, F.lit("approval_rejected"))
        .alias("investigation_step"),
        F.when(ok & ~approve, F.concat(F.lit("Action '"), act, F.lit("' was rejected. Reason: "), F.col("reason")))
        .alias("summary"),
        side.alias("side_effect"),
        F.when(side.isin("rollback_job", "retrain_job"), F.concat_ws(
            ":", F.when(side == "retrain_job", F.lit("retrain")).otherwise(F.lit("rollback")),
            F.col("investigation_id"), version)).alias("idempotency_key"))
