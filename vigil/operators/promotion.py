"""Promotion gate and rollback as table operators: checklist rows per candidate, decisions, ledgers.

A candidate row carries what the gate reads: artifact presence, loaded model,
request fields, metrics map, replay summary and the drift severity it is gated
on. The checklist is an ``array<struct<name, passed, message>>`` exploded into
rows, so thousands of candidates are checked in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import promotion_request_id

from vigil.operators.ledger import insert_if_absent_agg, upsert
from vigil.operators.replay import MAX_PROBABILITY_DIFFERENCE, MAX_REPLAY_MISMATCHES

# Fixed values of the gate: required artifacts (in check order), metric minima, allowed drift severities.
ARTIFACTS = ["model_artifact_exists", "schema_artifact_exists", "runtime_config_artifact_exists",
             "reference_stats_artifact_exists", "metrics_artifact_exists", "environment_artifact_exists",
             "replay_fixture_artifact_exists", "model_card_artifact_exists"]
METRIC_MINIMA = [("accuracy", 0.80), ("precision", 0.70), ("recall", 0.75), ("f1", 0.70), ("auc", 0.80)]
METRIC_MINIMA_DEPLOYED = [("accuracy", 0.70), ("precision", 0.20), ("recall", 0.75), ("f1", 0.35), ("auc", 0.80)]
ALLOWED_DRIFT = ["normal"]
PROMOTED_MSG = "Model '{m}' version '{v}' promoted to Production."
BLOCKED_MSG = "Promotion blocked because checklist failed."
CHECKS_TYPE = "array<struct<name:string,passed:boolean,message:string>>"


def _check(name, passed: Column, message: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"),
                    F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"))


def metric_value(metrics, name: str) -> Column:
    """``test_<name>`` if present, else ``<name>``."""
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    return F.coalesce(m[f"test_{name}"], m[name])


def _fmt4(x: Column) -> Column:
    return F.format_string("%.4f", x)


def checklist_array(minima=METRIC_MINIMA, allowed=ALLOWED_DRIFT, with_request: Column | None = None) -> Column:
    """Checklist of one candidate row (20 checks with a request, 17 without; 19/16 if replay failed)."""
    art = F.col("artifacts")
    checks = [_check(a, art[a], F.when(art[a], F.concat(F.lit("Artifact exists: "), F.lit(a)))
                     .otherwise(F.concat(F.lit("Missing artifact: "), F.lit(a)))) for a in ARTIFACTS]
    checks.append(_check("model_loaded", F.col("model_loaded"),
                         F.when(F.col("model_loaded"), "Model is loaded.").otherwise("Model is not loaded.")))
    name_ok = F.col("model_name") == F.col("loaded_model_name")
    ver_ok = F.col("model_version").cast("string") == F.col("loaded_model_version").cast("string")
    request_checks = [
        _check("human_approval_present", F.col("human_approved") == F.lit(True), F.lit("Human approval is present.")),
        _check("requested_model_name_matches_registry", name_ok, F.when(
            name_ok, "Requested model name matches registry.").otherwise(F.concat(
                F.lit("Requested model name '"), F.col("model_name"),
                F.lit("' does not match current registry model name '"), F.col("loaded_model_name"), F.lit("'.")))),
        _check("requested_model_version_matches_loaded_model", ver_ok, F.when(
            ver_ok, "Requested model version matches loaded model.").otherwise(F.concat(
                F.lit("Requested model version '"), F.col("model_version"),
                F.lit("' does not match loaded model version '"), F.col("loaded_model_version"), F.lit("'.")))),
    ]
    for metric, minimum in minima:
        v = metric_value("metrics", metric)
        ok = v >= minimum
        checks_msg = (F.when(v.isNull(), F.lit(f"Missing metric: {metric}"))
                      .when(ok, F.concat(F.lit(f"{metric}="), _fmt4(v), F.lit(f" passes minimum {minimum:.4f}.")))
                      .otherwise(F.concat(F.lit(f"{metric}="), _fmt4(v), F.lit(f" is below minimum {minimum:.4f}."))))
        request_checks.append(_check(f"metric_{metric}", ok, checks_msg))
    mis, diff = F.col("prediction_mismatches"), F.col("max_probability_difference")
    mis_ok, diff_ok = mis <= MAX_REPLAY_MISMATCHES, diff <= MAX_PROBABILITY_DIFFERENCE
    replay_ok = [
        _check("replay_prediction_mismatches", mis_ok, F.concat(
            F.lit("Replay mismatches="), mis.cast("string"),
            F.when(mis_ok, F.lit(" is within allowed limit ")).otherwise(F.lit(" exceeds allowed limit ")),
            F.lit(f"{MAX_REPLAY_MISMATCHES}."))),
        _check("replay_probability_difference", diff_ok, F.concat(
            F.lit("Max probability difference="), diff.cast("string"),
            F.when(diff_ok, F.lit(" is within allowed limit ")).otherwise(F.lit(" exceeds allowed limit ")),
            F.lit(f"{MAX_PROBABILITY_DIFFERENCE}."))),
    ]
    replay_failed = [_check("replay_fixture_compare", F.lit(False), F.concat(
        F.lit("Replay fixture comparison failed: "), F.coalesce("replay_error", F.lit("no replay result."))))]
    sev = F.col("latest_drift_severity")
    dc = F.col("drift_context")
    drift = (F.when(dc.isNotNull(), _check("promotion_has_drift_context", F.lit(True), F.concat(
        F.lit("Promotion request is linked to approved remediation for drift event "), dc["event_id"],
        F.lit(" with severity "), dc["severity"], F.lit("."))))
        .when(sev.isNull(), _check("latest_drift_severity", F.lit(False),
                                   F.lit("No drift check found. Run /drift before Production promotion.")))
        .otherwise(_check("latest_drift_severity", sev.isin(*allowed), F.when(
            sev.isin(*allowed), F.concat(F.lit("Latest drift severity '"), sev, F.lit("' is allowed.")))
            .otherwise(F.concat(F.lit("Latest drift severity '"), sev,
                                F.lit(f"' is not allowed. Allowed severities: {sorted(allowed)}."))))))
    req = F.col("request_id").isNotNull() if with_request is None else with_request
    metric_part = F.array(*request_checks[3:])
    replay_part = F.when(F.col("replay_error").isNotNull() | mis.isNull() | diff.isNull(),
                         F.array(*replay_failed)).otherwise(F.array(*replay_ok))
    return F.concat(F.array(*checks), F.when(req, F.array(*request_checks[:3])).otherwise(F.array().cast(CHECKS_TYPE)),
                    metric_part, replay_part, F.array(drift))


def promotion_checklist(candidates: DataFrame, minima=METRIC_MINIMA, allowed=ALLOWED_DRIFT) -> DataFrame:
    """One row per (candidate, check) with its position ``seq``."""
    keys = [c for c in ("request_id", "model_name", "model_version") if c in candidates.columns]
    arr = checklist_array(minima, allowed)
    return candidates.select(*keys, F.posexplode(arr).alias("seq", "c")).select(*keys, "seq", "c.name", "c.passed",
                                                                                  "c.message")


def promotion_decide(candidates: DataFrame, ledger: DataFrame | None = None, minima=METRIC_MINIMA,
                     allowed=ALLOWED_DRIFT) -> DataFrame:
    """Decision per request: promoted = every check passed. A request id already in ``ledger`` returns the
    stored decision (``duplicate``), blocked ones included."""
    arr = checklist_array(minima, allowed)
    dec = candidates.select(
        "request_id", "model_name", "model_version",
        F.lit("promote_to_production").alias("requested_action"), F.lit("production").alias("target_environment"),
        F.forall(arr, lambda c: c["passed"]).alias("promoted"),
        F.size(F.filter(arr, lambda c: ~c["passed"])).alias("n_failed"), arr.alias("checklist"))
    dec = dec.withColumn("message", F.when(F.col("promoted"), F.format_string(
        "Model '%s' version '%s' promoted to Production.", F.col("model_name"), F.col("model_version")))
        .otherwise(F.lit(BLOCKED_MSG)))
    if ledger is None:
        return dec.withColumn("duplicate", F.lit(False))
    fresh = insert_if_absent_agg(ledger.select("request_id"), dec, ["request_id"], ["model_version"])
    stored = ledger.join(dec.select("request_id"), "request_id", "left_semi").withColumn("duplicate", F.lit(True))
    return fresh.withColumn("duplicate", F.lit(False)).unionByName(stored, allowMissingColumns=True)


def registry_after_promotion(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Promoted requests become ``production`` rows of the registry, one for each version however many requests
    promote it (earlier production rows are not demoted). A null version is a key like any other."""
    prom = decisions.where(F.col("promoted") & ~F.col("duplicate")).select(
        F.col("model_name").alias("_n"), F.col("model_version").alias("_v")).distinct()
    old = registry.drop("model_stage")
    new = {"model_name": F.col("_n"), "model_version": F.col("_v"), "model_stage": F.lit("production")}
    met = prom.join(old, F.col("_n").eqNullSafe(old["model_name"]) & F.col("_v").eqNullSafe(old["model_version"]), "left")
    src = met.select(*[new.get(c, F.col(c)).alias(c) for c in registry.columns])
    return upsert(registry, src, ["model_name", "model_version"])


def rollback_request_id(inv, apr, version) -> Column:
    return F.concat(F.lit("rollback_"), inv, F.lit("_"), apr, F.lit("_"), F.coalesce(version, F.lit("unknown")),
                    F.lit("_production"))


def rollback_decide(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Validate rollback requests against the loaded model and decide; previous stage from the registry.

    Request columns: request_id?, investigation_id, approval_id, requested_action, target_environment,
    model_name, model_version?, loaded_model_name, loaded_model_version.
    """
    rid = F.coalesce(F.col("request_id"), rollback_request_id(F.col("investigation_id"), F.col("approval_id"),
                                                              F.col("model_version")))
    target = F.coalesce(F.col("model_version"), F.col("loaded_model_version"))
    r = requests.withColumn("request_id", rid).withColumn("target_model_version", target)
    reg = registry.select(F.col("model_name").alias("_rn"), F.col("model_version").alias("_rv"),
                          F.col("model_stage").alias("previous_stage"))
    r = r.join(reg, (r.model_name == reg._rn) & r.target_model_version.eqNullSafe(reg._rv), "left").drop("_rn", "_rv")
    err = (F.when(F.col("requested_action") != "rollback_production",
                  F.lit("requested_action must be rollback_production."))
           .when(F.col("target_environment") != "production", F.lit("target_environment must be production."))
           .when(F.col("model_name") != F.col("loaded_model_name"), F.concat(
               F.lit("Requested model_name '"), F.col("model_name"), F.lit("' does not match loaded model_name '"),
               F.col("loaded_model_name"), F.lit("'.")))
           .when(F.col("loaded_model_version").isNotNull() & F.col("target_model_version").isNotNull()
                 & (F.col("target_model_version") != F.col("loaded_model_version")), F.concat(
               F.lit("Requested model_version '"), F.col("target_model_version"),
               F.lit("' does not match currently loaded model_version '"), F.col("loaded_model_version"),
               F.lit("'."))))
    ok = err.isNull()
    return r.select(
        "request_id", "investigation_id", "approval_id", "model_name", "target_model_version", "previous_stage",
        F.when(ok, F.lit("production")).otherwise(F.col("previous_stage")).alias("new_stage"),
        ok.alias("rolled_back"), err.alias("validation_error"),
        F.when(ok, F.concat(F.lit("Rollback completed. Model '"), F.col("model_name"), F.lit("' version '"),
                            F.col("target_model_version"), F.lit("' is now marked as Production.")))
        .otherwise(F.concat(F.lit("Rollback blocked: "), err)).alias("message"))


def promotion_requests(approvals: DataFrame) -> DataFrame:
    """Promotion request payloads for approved approvals (agent side), ids from investigation + version."""
    a = approvals.where(F.col("status") == "approved")
    version = F.date_format("created_at", "yyyy")
    return a.select(
        F.lit("v1").alias("contract_version"), F.lit("promotion.production.requested").alias("request_type"),
        promotion_request_id("investigation_id", version).alias("request_id"),
        F.col("created_at"), F.lit("agent").alias("source_service"), "investigation_id", "approval_id",
        F.lit("promote_to_production").alias("requested_action"), F.lit("production").alias("target_environment"),
        F.lit("model").alias("model_name"), version.alias("model_version"),
        F.struct(F.lit(True).alias("approved"), F.lit("ops").alias("approved_by"),
                 F.col("created_at").alias("approved_at"), F.lit("dashboard").alias("approval_source"))
        .alias("human_approval"),
        F.concat(F.lit("approved "), F.col("requested_action")).alias("reason"),
        F.lit(None).cast("struct<event_id:string,severity:string,previous_model_version:string>")
        .alias("drift_context"))
