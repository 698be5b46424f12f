"""One effect for each key: approvals decided twice, versions promoted twice, versions in natural order, bad JSON."""

from pyspark.sql import types as T

from vigil.operators import promotion as P
from vigil.operators import transitions as TR
from vigil.sources import files as FS
from vigil.sources import sinks as SK


def test_first_decision_on_an_approval_counts(spark):
    dec = spark.createDataFrame(
        [("a1", "reject", "x", "r", 2), ("a1", "approve", "y", None, 1), ("a2", "reject", "x", "no", 1), (None, "approve", "x", "", 1)],
        "approval_id string, decision string, actor string, reason string, decided_at int")
    apr = spark.createDataFrame([(a, "inv", "retrain", "pending", None) for a in ("a1", "a2")],
                                "approval_id string, investigation_id string, requested_action string, status string, model_version string")
    got = {(r.approval_id, r.decision): r for r in TR.apply_approvals(dec, apr).collect()}
    assert len(got) == 4
    assert got["a1", "approve"].side_effect == "retrain_job" and got["a1", "approve"].error is None
    assert got["a1", "reject"].error == "Approval a1 is not pending. Current status: approved"
    assert got["a1", "reject"].new_status == "approved" and got["a1", "reject"].side_effect is None
    assert got["a2", "reject"].new_status == "rejected"
    assert got[None, "approve"].error == "Approval not found: None"


def test_a_version_promoted_twice_is_one_registry_row(spark):
    reg = spark.createDataFrame([("m", "1", "staging", 0.4), ("m", None, "staging", 0.3)],
                                "model_name string, model_version string, model_stage string, threshold double")
    dec = spark.createDataFrame([("m", "1", True, False)] * 2 + [("m", None, True, False), ("m", "7", True, False)],
                                "model_name string, model_version string, promoted boolean, duplicate boolean")
    got = sorted(map(tuple, P.registry_after_promotion(reg, dec).collect()), key=str)
    assert got == [("m", "1", "production", 0.4), ("m", "7", "production", None), ("m", None, "production", 0.3)]


def test_newest_version_by_number(spark, tmp_path):
    df = spark.createDataFrame([("m", "w9", 1), ("m", "w10", 2), ("n", "20240102T000000Z", 3), ("n", "20231231T235959Z", 4)],
                               "model string, version string, x int")
    SK.write_versioned(df, str(tmp_path / "v"))
    assert {(r.model, r.x) for r in SK.read_newest(spark, str(tmp_path / "v"), ["model"]).collect()} == {("m", 2), ("n", 3)}


def test_wrong_types_are_malformed(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("sample_size", T.IntegerType())])
    df = spark.createDataFrame([('{"id":"a","sample_size":3}',), ('{"id":"b","sample_size":"abc"}',), ("no",), ("{}",),
                                ('{"id":"c"}',)], "value string")
    got = FS.ingest_json_lines(df, schema)
    assert got.schema["parsed"].dataType.names == ["id", "sample_size"]
    assert {r.value: r.malformed for r in got.collect()} == {
        '{"id":"a","sample_size":3}': False, '{"id":"b","sample_size":"abc"}': True, "no": True, "{}": True, '{"id":"c"}': False}
