from pyspark.sql import functions as F

from vigil.operators import decide as DC
from vigil.operators import validate as V

REPORT = ("struct<sample_size:bigint,min_required_samples:bigint,severity:string,overall_score:double,"
          "features:array<struct<feature:string,kind:string,score:double,severity:string,details:map<string,string>>>,"
          "output_drift:struct<kind:string,score:double,severity:string>>")
SCHEMA = (f"event_id string, model_name string, model_version string, previous_severity string, "
          f"new_severity string, overall_score double, sample_size bigint, min_required_samples bigint, "
          f"contract_version string, event_type string, source_service string, created_at timestamp, "
          f"drift_report {REPORT}")


def _demo(spark):
    import datetime as dt
    now = dt.datetime(2024, 1, 1)

    def ev(eid, prev, new, score, feats, out, n=200):
        rep = (n, 30, new, score, [(f, k, s, sv, {}) for f, k, s, sv in feats], ("output_probability", out[1], out[0]))
        return (eid, "bank", "3", prev, new, score, n, 30, "v1", "drift.severity_changed", "model_service", now, rep)
    rows = [
        ev("critical_retrain", "normal", "critical", 0.88,
           [("campaign", "numeric", 0.88, "critical"), ("month", "categorical", 0.55, "warning")], ("normal", 0.10)),
        ev("warning_replay", "normal", "warning", 0.22, [("euribor3m", "numeric", 0.22, "warning")],
           ("normal", 0.08)),
        ev("critical_rollback", "warning", "critical", 0.91, [("euribor3m", "numeric", 0.72, "critical")],
           ("critical", 0.41)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_demo_payload_routes(spark):
    inv = DC.investigate(_demo(spark))
    got = {r.event_id: r for r in inv.select("event_id", "action.*", "triage.*").collect()}
    assert (got["critical_retrain"].recommended_action, got["critical_retrain"].production_action_required,
            got["critical_retrain"].target_environment) == ("retrain", True, "candidate")
    assert (got["warning_replay"].recommended_action, got["warning_replay"].queue_job_required) == ("replay_test", True)
    assert (got["critical_rollback"].recommended_action, got["critical_rollback"].target_environment) == \
        ("rollback_production", "production")
    assert got["critical_retrain"].drifted_features == ["campaign", "month"]
    assert got["critical_retrain"].primary_issue == "feature_drift"
    assert got["critical_rollback"].primary_issue == "feature_and_output_drift"
    assert got["warning_replay"].risk_level == "medium"


def test_trace_lengths_and_effects(spark):
    inv = DC.investigate(_demo(spark))
    n = {r.investigation_id: r.n for r in DC.agent_trace(inv).groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    ids = {r.event_id: r.investigation_id for r in inv.select("event_id", "investigation_id").collect()}
    assert n[ids["warning_replay"]] == 9 and n[ids["critical_retrain"]] == 11
    eff = {r.event_id: r for r in DC.apply_decision(inv).collect()}
    assert eff["warning_replay"].effect == "job"
    assert eff["warning_replay"].idempotency_key == f"replay_test:{ids['warning_replay']}:3"
    assert eff["critical_rollback"].status == "waiting_for_approval"


def test_summary_sentence(spark):
    inv = DC.investigate(_demo(spark)).where("event_id = 'warning_replay'").first()
    assert inv.summary.startswith(f"Investigation {inv.investigation_id}: drift severity changed from normal to "
                                  "warning for model bank version 3. Primary issue: feature_drift. Drifted features: "
                                  "euribor3m. Recommended action: replay_test.")
    assert inv.summary.endswith("Next step: dispatching a Redis background job.")


def test_demo_payloads_pass_the_contract_and_broken_ones_fail(spark):
    ev = _demo(spark)
    ok = V.event_contract(ev).select("valid").collect()
    assert all(r.valid for r in ok)
    bad = ev.withColumn("model_name", F.lit("")).withColumn("new_severity", F.lit("unknown"))
    v = V.event_contract(bad).first().violations
    assert "model_name: empty" in v and "new_severity: not allowed" in v
