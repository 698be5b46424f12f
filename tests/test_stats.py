import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import ordered as O
from vigil.operators import stats as S


def _np_quantiles(vals, levels):
    return [float(x) for x in np.quantile(np.array(vals, dtype=float), levels)]


@pytest.mark.parametrize("vals", [
    [1.0, 2.0, 3.0, 10.0],
    [5.0] * 7,
    list(np.round(np.random.default_rng(3).normal(size=301), 2)),
    [0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 9.5, 9.5, 9.5, 11.0],
])
def test_quantiles_equal_numpy_bit_for_bit(spark, vals):
    levels = S.PROFILE_LEVELS
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    counts = S.value_counts(df, ["g"], "v")
    for small in (None, 0):  # small path (one window) and the range-partitioned path
        q = O.quantiles_from_counts(counts, ["g"], "v", levels).first().quantiles if small is None else \
            _range_path_quantiles(spark, counts, levels)
        assert q == _np_quantiles(vals, levels)


def _range_path_quantiles(spark, counts, levels):
    old = O.SMALL_INPUT_ROWS
    O.SMALL_INPUT_ROWS = 0
    try:
        return O.quantiles_from_counts(counts, ["g"], "v", levels, ranges=3).first().quantiles
    finally:
        O.SMALL_INPUT_ROWS = old


def test_quantiles_small_path_returns_row(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0)], "g string, v double")
    q = O.quantiles_from_counts(S.value_counts(df, ["g"], "v"), ["g"], "v", [0.5]).first().quantiles
    assert q == [1.5]


def test_running_totals_paths_agree_with_hot_group(spark):
    df = spark.range(0, 20000).select(F.when(F.col("id") < 12000, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
                                      ((F.col("id") * 7919) % 5003).alias("v"))
    c = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    a = sorted(O.running_totals(c, ["g"], "v", ["w"], small_rows=0, ranges=8).collect())
    b = sorted(O.running_totals(c, ["g"], "v", ["w"]).collect())
    assert a == b


def test_learned_edges_fallbacks(spark):
    from vigil.functions.drift import learned_edges
    r = spark.createDataFrame([([2.0, 2.0], 2.0, 2.0), ([1.0, 3.0], 1.0, 3.0), ([1.0, 2.0, 3.0], 1.0, 3.0),
                               (None, None, None)], "q array<double>, mn double, mx double").select(
        learned_edges("q", "mn", "mx").alias("e")).collect()
    assert r[0].e == [1.5, 2.5]
    assert r[1].e == [float(x) for x in np.linspace(1.0, 3.0, 11)]
    assert r[2].e == [1.0, 2.0, 3.0]
    assert r[3].e == [0.0, 1.0]


def test_numeric_profile_all_null_column(spark):
    df = spark.createDataFrame([("m", None), ("m", None)], "model string, x double")
    long_df = S.to_long(df, ["model"], ["x"], [])
    p = S.numeric_profile(long_df, ["model"]).first()
    assert p.bins == [0.0, 1.0] and p.reference_distribution == [1]
    assert p.mean is None and p.missing_count == 2


def test_categorical_profile_missing_and_order(spark):
    df = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", None), ("m", "b"), ("m", "a"), ("m", "c")],
                               "model string, c string")
    p = S.categorical_profile(S.to_long(df, ["model"], [], ["c"]), ["model"]).first()
    assert p.categories == ["a", "b", "__missing__", "c"]
    assert p.reference_distribution == [2, 2, 1, 1]
    assert p.missing_count == 1 and p.n_unique == 4


def test_sketched_profile_keeps_its_bounds_and_shuffles_no_values(spark):
    from pyspark.sql import functions as F

    from vigil.operators import stats as S
    rows = spark.range(0, 60000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.lit("x").alias("feature"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, 5.0).otherwise(
            (F.col("id") * 7919 % 60000).cast("double")).alias("num_value"))
    prof = S.numeric_profile(rows, ["g"], approx=True)
    plan = prof._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(g" in plan and "num_value" not in [
        x for x in plan.split("hashpartitioning(")[1].split(")")[0].replace("#", " ").split()]
    exact = {r["g"]: r for r in S.numeric_profile(rows, ["g"]).collect()}
    assert S.kll_rank_error() < 0.0025
    for r in prof.collect():
        e = exact[r["g"]]
        values = sorted(v["num_value"] for v in rows.where(F.col("g") == r["g"]).collect() if v["num_value"] is not None)
        n = len(values)
        assert (r["n_valid"], r["missing_count"], r["min"], r["max"]) == (e["n_valid"], e["missing_count"], e["min"], e["max"])
        assert abs(r["mean"] - e["mean"]) < 1e-6 and abs(r["std"] - e["std"]) < 1e-6
        for p, q in [(0.5, r["median"]), (0.25, r["q25"]), (0.75, r["q75"])]:
            below, upto = sum(v < q for v in values) / n, sum(v <= q for v in values) / n
            assert below - S.kll_rank_error() <= p <= upto + S.kll_rank_error()
        got, edges = r["reference_distribution"], r["bins"]
        assert len(got) == len(edges) - 1
        for i, c in enumerate(got):
            true = sum(edges[i] <= v < edges[i + 1] or (i == len(got) - 1 and v == edges[-1]) for v in values)
            assert abs(c - true) <= n * (2 * S.kll_rank_error() + 1 / S.KLL_STEPS) + 1


def test_sketched_profile_of_nothing(spark):
    from vigil.operators import stats as S
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", float("nan")), ("c", "x", 2.0)], "g string, feature string, num_value double")
    got = {r["g"]: r for r in S.numeric_profile(rows, ["g"], approx=True).collect()}
    assert got["a"]["n_valid"] == 0 and got["a"]["missing_count"] == 1 and got["a"]["reference_distribution"] == [1]
    assert got["b"]["missing_count"] == 1 and got["c"]["bins"] == [1.5, 2.5] and got["c"]["reference_distribution"] == [1]
