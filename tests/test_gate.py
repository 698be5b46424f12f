import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import promotion as P
from vigil.operators import replay as RP
from vigil.operators import transitions as TR
from vigil.operators import validate as V

CAND = ("request_id string, model_name string, model_version string, artifacts map<string,boolean>, "
        "model_loaded boolean, loaded_model_name string, loaded_model_version string, human_approved boolean, "
        "metrics map<string,double>, prediction_mismatches bigint, max_probability_difference double, "
        "replay_error string, latest_drift_severity string, "
        "drift_context struct<event_id:string,severity:string>")


def _cand(req="r1", version="3", drift=None, replay_error=None, sev="normal", metrics=None):
    arts = {a: True for a in P.ARTIFACTS}
    m = metrics or {"test_accuracy": 0.9, "precision": 0.8, "recall": 0.8, "f1": 0.8, "auc": 0.9}
    return (req, "bank", version, arts, True, "bank", "3", True, m, 0, 0.0, replay_error, sev, drift)


def test_checklist_sizes_and_all_pass(spark):
    df = spark.createDataFrame([_cand(), _cand(req=None, version="4")], CAND)
    n = {r.request_id: r.n for r in P.promotion_checklist(df).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"r1": 20, None: 17}
    d = {r.request_id: r for r in P.promotion_decide(df).collect()}
    assert d["r1"].promoted and d["r1"].message == "Model 'bank' version '3' promoted to Production."


def test_replay_failure_gives_one_check_and_drift_context_passes(spark):
    df = spark.createDataFrame([_cand(replay_error="boom", drift=("e1", "critical"), sev="critical")], CAND)
    rows = P.promotion_checklist(df).collect()
    assert len(rows) == 19
    names = {r.name: r for r in rows}
    assert not names["replay_fixture_compare"].passed
    assert names["promotion_has_drift_context"].passed
    assert names["metric_accuracy"].message == "accuracy=0.9000 passes minimum 0.8000."


def test_no_drift_check_blocks(spark):
    df = spark.createDataFrame([_cand(sev=None)], CAND)
    d = P.promotion_decide(df).first()
    assert not d.promoted and d.message == P.BLOCKED_MSG and d.n_failed == 1


def test_replay_missing_expected_is_not_a_mismatch(spark):
    act = spark.createDataFrame([(0, 0.7, 1), (1, 0.2, 0), (2, 0.6, 1)],
                                "row_index int, actual_probability double, actual_prediction int")
    exp = spark.createDataFrame([(0, 0.7, 1), (1, 0.2, 1)],
                                "row_index int, expected_probability double, expected_prediction int")
    s = RP.replay_summary(RP.replay_compare(act, exp)).first()
    assert (s.total_rows, s.prediction_mismatches, s.max_probability_difference, s.passed) == (3, 1, 0.0, False)


def test_job_result_transitions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j1", "i1", "replay_test", "completed", {"passed": "true"}, None, t),
            ("j2", "i2", "retrain", "completed", {"completed": "false"}, None, t),
            ("j3", "i3", "retrain", "completed", {"completed": "true"}, None, t),
            ("j4", "i4", "retrain", "completed", {"completed": "true", "model_version": "7"}, None, t),
            ("j5", "i4", "retrain", "completed", {"completed": "true", "model_version": "7"}, None,
             t + dt.timedelta(1)),
            ("j6", "i6", "rollback", "dlq", None, "boom", t)]
    df = spark.createDataFrame(rows, "job_id string, investigation_id string, job_type string, status string, "
                                     "result map<string,string>, error_message string, finished_at timestamp")
    out = {r.job_id: r for r in TR.apply_job_results(df).collect()}
    assert out["j1"].current_step == "replay_test_completed"
    assert out["j2"].current_step == "retrain_result_invalid"
    assert out["j3"].current_step == "candidate_model_missing"
    assert out["j4"].creates_approval and not out["j5"].creates_approval
    assert out["j6"].summary == "Job j6 was moved to DLQ after retries. Reason: boom"


def test_approvals_only_pending(spark):
    apr = spark.createDataFrame([("a1", "i1", "retrain", "pending", None), ("a2", "i2", "retrain", "approved", None)],
                                "approval_id string, investigation_id string, requested_action string, "
                                "status string, model_version string")
    dec = spark.createDataFrame([("a1", "approve", "ops", "ok"), ("a2", "reject", "ops", "no"),
                                 ("a3", "approve", "ops", "x")],
                                "approval_id string, decision string, actor string, reason string")
    out = {r.approval_id: r for r in TR.apply_approvals(dec, apr).collect()}
    assert out["a1"].new_status == "approved" and out["a1"].idempotency_key == "retrain:i1:unknown"
    assert out["a2"].error == "Approval a2 is not pending. Current status: approved"
    assert out["a3"].error == "Approval not found: a3"


def test_feature_validation_collects_all_errors(spark):
    df = spark.createDataFrame([({"age": "3.7", "job": "  ", "euribor3m": "nan"},), ({"age": "35", "job": "x",
                                                                                      "euribor3m": "1.1"},)],
                               "features map<string,string>")
    v = V.feature_validate(df, "features", int_cols=["age"], float_cols=["euribor3m", "campaign"],
                           categorical=["job"]).collect()
    assert v[0].errors == ["Feature 'age' must be numeric. Got: 3.7", "Feature 'campaign' cannot be null.",
                           "Feature 'job' cannot be an empty string."]
    assert v[1].errors == ["Feature 'campaign' cannot be null."]


def test_sentinel_serving_truncates_numbers_but_not_strings(spark):
    df = spark.createDataFrame([(999.7, None), (12.0, 1)], "pdays double, pdays_was_999 int")
    r = V.sentinel_flag_serving(df, "pdays", 999, -1, "pdays_was_999").collect()
    assert (r[0].pdays, r[0].pdays_was_999) == (-1, 1) and (r[1].pdays, r[1].pdays_was_999) == (12, 1)
    s = spark.createDataFrame([("3.7",)], "pdays string")
    assert V.sentinel_flag_serving(s, "pdays", 999, -1, "f").first().sentinel_error is not None


def test_scoring_checks_in_order(spark):
    ok = {"age": "35", "pdays": "999", "job": " admin. ", "note": "x", "score": "1.5"}
    cases = [
        (ok | {"duration": "9"}, None), (ok | {"pdays": None, "age": None}, "Feature 'pdays' must be numeric."),
        ({k: v for k, v in ok.items() if k != "pdays"}, "Missing required feature(s): ['pdays', 'pdays_was_999']"),
        (ok | {"more": "1", "job": ""}, "Unexpected extra feature(s): ['more']"),
        (ok | {"job": " ", "age": "x"}, "Feature 'job' cannot be an empty string."),
        (ok | {"age": None}, "Feature 'age' cannot be null."), (ok | {"age": "x"}, "Feature 'age' must be numeric. Got: x"),
        (ok | {"score": "y"}, "could not convert string to float: 'y'"),
        (None, "Missing required feature(s): ['job', 'age', 'pdays', 'pdays_was_999', 'note', 'score']"),
        (ok | {"pdays": "3000000000"}, None)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "id int, raw map<string,string>")
    got = V.validate_features(df, "raw", ["job", "age", "pdays", "pdays_was_999", "note", "score"],
                              int_cols=["age", "pdays", "pdays_was_999"], categorical=["job"],
                              dtypes={"note": "object", "score": "float64"}, dropped=["duration"],
                              sentinel=("pdays", 999, -1, "pdays_was_999")).orderBy("id").collect()
    assert [r.first_error for r in got] == [e for _, e in cases]
    assert tuple(got[0].features) == ("admin.", 35, -1, 1, "x", 1.5)
    assert tuple(got[9].features)[2:4] == (3000000000, 0)


def test_null_labels_are_unexpected(spark):
    df = spark.createDataFrame([("yes",), (None,), (" No ",), ("maybe",)], "label string")
    assert [r.label for r in V.unexpected_labels(df, "label").collect()] == ["maybe", "nan"]
