"""Contracts parse a text once; a split neither sorts nor shuffles the table."""

from pyspark.sql import functions as F

from vigil.operators import contracts as CT
from vigil.operators import ml as M
from vigil.plans import validate_q as VQ


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",), ("no",), (None,)], "t string")
    got = CT.check_json(df, "t", CT.PROMOTION_REQUEST)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    found = {r.t: r.violations for r in got.collect()}
    assert found["no"] == found[None] == ["$: json"]
    assert found["{}"] == [f"{c}: required" for c in CT.PROMOTION_REQUEST["required"]]


def test_broken_rows_come_from_one_pass(spark):
    schema = CT.closed({"id": CT.NAME, "n": CT.COUNT})
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    got = VQ._broken(rows, {"ok": {}, "low": {"n": F.lit(-1)}, "null_n": {"n": F.lit(None).cast("int")}, "more": {"x": F.lit(1)}},
                     schema, "id", {})
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(
        (i, rule, text, text == "") for i in "ab"
        for rule, text in (("ok", ""), ("low", "n: minimum"), ("null_n", "n: type"), ("more", "x: unknown")))


def test_split_ranks_only_the_buckets_it_cuts(spark, monkeypatch):
    monkeypatch.setattr(M, "running_totals", None)
    rows = [(i // 2, i % 3 if i % 3 < 2 else None) for i in range(1001)] + [(7, 1)] * 50 + [(1, 5)]
    got = M.stratified_split(spark.createDataFrame(rows, "id long, y int"), ["id"], "y", seed=3)
    assert got.columns == ["id", "y", "split"] and got.count() == len(rows)
    h = {r.id: r.h for r in got.select("id", M.hash_order("id", seed=3).alias("h")).distinct().collect()}
    want = []
    for y in (0, 1, None, 5):
        mine = sorted((h[i], i) for i, c in rows if c == y)
        train = len(mine) * 6 // 10
        test = (len(mine) - train + 1) // 2
        want += [(i, y, "train" if k < train else "val" if k < len(mine) - test else "test") for k, (_, i) in enumerate(mine)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
