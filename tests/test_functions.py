import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import drift as FD
from vigil.functions.chisq import chi2_sf_value


def _psi_np(e, a):
    def norm(x):
        x = np.array(x, dtype=float)
        return np.ones_like(x) / len(x) if x.sum() <= 0 else x / x.sum()
    e, a = np.clip(norm(e), 1e-6, None), np.clip(norm(a), 1e-6, None)
    return float(np.sum((a - e) * np.log(a / e)))


counts = st.lists(st.integers(min_value=0, max_value=500), min_size=1, max_size=12)


@settings(max_examples=25, deadline=None)
@given(counts, st.data())
def test_psi_matches_numpy_and_is_non_negative(spark, e, data):
    a = data.draw(st.lists(st.integers(min_value=0, max_value=500), min_size=len(e), max_size=len(e)))
    row = spark.createDataFrame([(e, a)], "e array<bigint>, a array<bigint>").select(
        FD.psi("e", "a").alias("p"), FD.psi("e", "e").alias("same")).first()
    assert row.p >= -1e-12
    assert abs(row.same) < 1e-12
    assert math.isclose(row.p, _psi_np(e, a), rel_tol=1e-9, abs_tol=1e-12)


def test_psi_single_bin_is_zero_and_empty_side_uniform(spark):
    r = spark.createDataFrame([([5], [9], [0, 0], [3, 1])], "a array<bigint>, b array<bigint>, z array<bigint>, "
                              "y array<bigint>").select(FD.psi("a", "b").alias("one"),
                                                        FD.psi("y", "z").alias("empty")).first()
    assert r.one == 0.0
    assert math.isclose(r.empty, _psi_np([3, 1], [0, 0]))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False), min_size=1, max_size=40),
       st.lists(st.floats(min_value=-60, max_value=60, allow_nan=False), min_size=0, max_size=40))
def test_bin_index_follows_numpy_histogram(spark, ref_vals, vals):
    edges = np.unique(np.quantile(np.array(ref_vals), np.linspace(0, 1, 11)))
    if len(edges) < 2:
        return
    df = spark.createDataFrame([(float(v),) for v in vals], "v double") if vals else None
    if df is None:
        return
    got = df.select(FD.bin_index("v", F.array(*[F.lit(float(x)) for x in edges])).alias("b")).collect()
    counts = [0] * (len(edges) - 1)
    for r in got:
        if r.b is not None:
            counts[r.b] += 1
    assert counts == np.histogram(np.array(vals), bins=edges)[0].tolist()


def test_probability_edge_point_three_falls_in_bin_two(spark):
    edges = F.array(*[F.lit(x) for x in FD.PROBABILITY_EDGES])
    r = spark.createDataFrame([(0.3,), (1.0,), (0.0,), (1.2,)], "p double").select(FD.bin_index("p", edges).alias("b"))
    assert [x.b for x in r.collect()] == [2, 9, 0, None]


def test_severity_is_inclusive(spark):
    r = spark.createDataFrame([(0.1,), (0.25,), (0.0999,), (0.3,)], "s double").select(
        FD.severity_from_score("s").alias("sev")).collect()
    assert [x.sev for x in r] == ["warning", "critical", "normal", "critical"]


def test_severity_rank_unknown_is_zero(spark):
    r = spark.createDataFrame([("critical",), ("unknown",), (None,)], "s string").select(
        FD.severity_rank("s").alias("r")).collect()
    assert [x.r for x in r] == [3, 0, 0]


def test_chi2_upper_tail_known_values():
    assert math.isclose(chi2_sf_value(3.841458820694124, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(chi2_sf_value(5.991464547107979, 2), 0.05, rel_tol=1e-7)
    assert math.isclose(chi2_sf_value(0.0, 3), 1.0)
    assert chi2_sf_value(1.0, 0) is None
    # df = 10: Q(5, 20) = exp(-20) * sum(20^i / i!, i < 5)
    exact = math.exp(-20) * sum(20 ** i / math.factorial(i) for i in range(5))
    assert math.isclose(chi2_sf_value(40.0, 10), exact, rel_tol=1e-9)


def test_chi2_upper_tail_of_many_categories():
    """Near its mean a chi-square variable with many degrees of freedom is above it half of the time."""
    for dof in (1e5, 9e5, 1.1e6, 4e6, 1e8):
        assert math.isclose(chi2_sf_value(dof, dof), 0.5, abs_tol=1e-3)
        sigma = math.sqrt(2 * dof)
        assert math.isclose(chi2_sf_value(dof + 3 * sigma, dof), 0.00135, abs_tol=2e-4)
        assert math.isclose(chi2_sf_value(dof - 3 * sigma, dof), 0.99865, abs_tol=2e-4)
