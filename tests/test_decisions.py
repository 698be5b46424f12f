"""Promotion and rollback in one commit, opaque scoring, contracts over raw JSON, job results against three tables."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import contracts as CT
from vigil.operators import decisions as DE
from vigil.operators import promotion as P
from vigil.operators import queue as Q
from vigil.operators import scoring as SC
from vigil.operators import transitions as TR
from vigil.streaming.runner import scratch_path


def _requests(spark, rows):
    """rows: (request_id, version, approved, arrived)"""
    df = spark.createDataFrame(rows, "request_id string, model_version string, human_approved boolean, arrived int")
    return df.select(
        "request_id", F.lit("m").alias("model_name"), "model_version", "human_approved", "arrived",
        F.create_map(*[x for a in P.ARTIFACTS for x in (F.lit(a), F.lit(True))]).alias("artifacts"),
        F.lit(True).alias("model_loaded"), F.lit("m").alias("loaded_model_name"), F.col("model_version").alias("loaded_model_version"),
        F.create_map(F.lit("auc"), F.lit(0.9)).alias("metrics"), F.lit(0).cast("long").alias("prediction_mismatches"),
        F.lit(0.0).alias("max_probability_difference"), F.lit(None).cast("string").alias("replay_error"),
        F.lit("normal").alias("latest_drift_severity"),
        F.lit(None).cast("struct<event_id:string,severity:string>").alias("drift_context"), F.lit(0.4).alias("selected_threshold"))


def test_promotions_are_decided_once_and_committed_with_the_registry(spark):
    tables = DE.decision_tables(spark, scratch_path(spark, "decisions"))
    ask = lambda *rows: {(r.request_id, r.arrived): (r.promoted, r.duplicate) for r in DE.request_promotions(
        tables, _requests(spark, rows), ["arrived"], [("auc", 0.5)]).collect()}
    assert ask(("a", "1", True, 1), ("a", "1", False, 2), ("b", "2", False, 1), ("c", "1", True, 3)) == {
        ("a", 1): (True, False), ("a", 2): (True, True), ("b", 1): (False, False), ("c", 3): (True, False)}
    # later: the stored decisions come back, also the blocked one
    assert ask(("a", "1", False, 9), ("b", "2", True, 9), ("d", "2", True, 9)) == {
        ("a", 9): (True, True), ("b", 9): (False, True), ("d", 9): (True, False)}
    version, now = tables.read()
    assert version == 1 and now["promotions"].count() == 4
    rows = now["registry"].collect()
    assert sorted((r.model_version, r.model_stage, r.selected_threshold) for r in rows) == [("1", "production", 0.4), ("2", "production", 0.4)]


def test_a_lost_registry_write_leaves_no_decision(spark, monkeypatch):
    tables = DE.decision_tables(spark, scratch_path(spark, "decisions"))

    def broken(done, registry):
        return registry.unionByName(done.select(F.raise_error(F.lit("lost")).cast("string").alias("model_name")), allowMissingColumns=True)
    monkeypatch.setattr(DE, "_production", broken)
    with pytest.raises(Exception, match="lost"):
        DE.request_promotions(tables, _requests(spark, [("a", "1", True, 1)]), ["arrived"], [("auc", 0.5)])
    assert tables.read()[0] == -1
    monkeypatch.undo()
    got = DE.request_promotions(tables, _requests(spark, [("a", "1", True, 1)]), ["arrived"], [("auc", 0.5)]).collect()
    assert [(r.promoted, r.duplicate) for r in got] == [(True, False)] and tables.read()[1]["registry"].count() == 1


def test_models_are_scored_by_the_best_they_offer(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a b"), (F.col("id") % 7).cast("double").alias("y"), F.col("id").alias("n"))
    weights = {"a b": 0.2, "y": -1.0}
    z = np.array([0.2 * i - (i % 7) + 0.5 for i in range(50)])
    for kind, want in ((SC.ProbabilityModel, 1 / (1 + np.exp(-z))), (SC.MarginModel, 1 / (1 + np.exp(-z))), (SC.PlainModel, (z >= 0) * 1.0)):
        rows = SC.score_opaque(df, kind(weights, 0.5), ["a b", "y"]).orderBy("n").collect()
        assert np.allclose([r.probability for r in rows], want)

    class OneColumn:
        def predict_proba(self, rows):
            return np.full(len(rows), 0.25)

    class Far:
        def decision_function(self, rows):
            return [-1e4, 1e4]
    assert SC.positive_probability(OneColumn(), pd.DataFrame({"x": [1, 2]})).tolist() == [0.25, 0.25]
    assert SC.positive_probability(Far(), pd.DataFrame({"x": [1, 2]})).tolist() == [0.0, 1.0]
    assert SC.score_opaque(df.limit(0), SC.PlainModel(weights, 0), ["a b", "y"]).count() == 0


def test_contract_tells_absent_from_null(spark):
    good = {"contract_version": "v1", "event_type": "drift.severity_changed", "event_id": "e", "created_at": "2024-01-01T00:00:00Z",
            "source_service": "model_service", "model_name": "m", "previous_severity": "normal", "new_severity": "warning",
            "overall_score": 0.2, "sample_size": 200, "min_required_samples": 30.0, "model_version": None,
            "drift_report": {"sample_size": 1, "min_required_samples": 0, "severity": "warning", "overall_score": 1, "features": [],
                             "output_drift": None}}
    report = good["drift_report"]
    cases = {
        "": good, "model_name: required": {k: v for k, v in good.items() if k != "model_name"}, "model_name: type": {**good, "model_name": None},
        "sample_size: type": {**good, "sample_size": 2.5}, "drift_report: type": {**good, "drift_report": []},
        "drift_report.features: required": {**good, "drift_report": {k: v for k, v in report.items() if k != "features"}},
        "drift_report.features: type": {**good, "drift_report": {**report, "features": None}},
        "drift_report.features[]: type": {**good, "drift_report": {**report, "features": [1]}},
        "drift_report.output_drift.kind: required;drift_report.output_drift.score: minimum": {
            **good, "drift_report": {**report, "output_drift": {"score": -1, "severity": "normal", "more": 1}}},
        "drift_report.output_drift.expected_distribution[]: minimum": {**good, "drift_report": {**report, "output_drift": {
            "kind": "k", "score": 0, "severity": "normal", "expected_distribution": [1, -1, -2]}}},
        "created_at: format": {**good, "created_at": "2024-01-01"},
    }
    rows = [(want, json.dumps(v)) for want, v in cases.items()] + [("$: json", "{"), ("$: json", None), ("$: type", "[]"), ("$: type", "null")]
    got = CT.check_json(spark.createDataFrame(rows, "want string, text string"), "text", CT.DRIFT_EVENT).collect()
    assert [";".join(r.violations) for r in got] == [r.want for r in got]
    assert [r.valid for r in got] == [r.want == "" for r in got]


def test_job_results_against_their_tables(spark):
    t = dt.datetime(2024, 1, 1)
    kind = ("job_id string, investigation_id string, job_type string, status string, result map<string,string>, "
            "error_message string, finished_at timestamp")
    ok = {"completed": "true", "model_version": "v2", "passed": "true"}
    results = spark.createDataFrame([
        ("j1", "i1", "retrain", "completed", ok, None, t), ("j2", "i2", "retrain", "completed", ok, None, t),
        ("j3", "i1", "replay_test", "failed", {}, "boom", t), ("gone", "i1", "rollback", "completed", {}, None, t),
        ("j4", "nowhere", "retrain", "completed", ok, None, t), (None, "i1", "retrain", "completed", ok, None, t)], kind)
    jobs = spark.createDataFrame([("j1",), ("j2",), ("j3",), ("j4",), ("j1",)], "job_id string")
    investigations = spark.createDataFrame([("i1",), ("i2",), ("i1",)], "investigation_id string")
    approvals = spark.createDataFrame([
        ("old", "i1", "promote_to_production", "v2", "pending", t), ("new", "i1", "promote_to_production", "v2", "rejected", t.replace(year=2025))],
        "approval_id string, investigation_id string, requested_action string, model_version string, status string, created_at timestamp")
    got = {r.job_id: r for r in TR.record_job_results(results, jobs, investigations, approvals).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"j1": "existing_approval", "j2": "applied", "j3": "applied", "gone": "unknown_job",
                                                      "j4": "investigation_missing", None: "unknown_job"}
    assert got["j1"].approval_id == "new" and not got["j1"].creates_approval  # the newest of that version, as it is stored
    assert got["j2"].creates_approval and got["j2"].approval_id.startswith("approval_")
    assert got["gone"].error == "Unknown job_id: gone" and got["gone"].content is None
    assert got["j4"].content == "Job j4 completed." and got["j4"].new_status is None
    assert json.loads(got["j3"].metadata)["error_message"] == "boom" and got["j3"].job_status == "failed"


def test_lock_counts_from_its_holder(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [(1, 1, at(0)), (1, 2, at(20)), (1, 3, at(35)), (1, 4, at(60)), (1, 5, at(66)), (None, 6, at(0)), (None, 7, at(1)), (2, 8, at(0)),
            (2, 9, at(0)), (3, 10, None)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    assert {r.event_id for r in Q.overlapping_attempts(df).collect()} == {2, 4, 7, 9}
