import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import ml as M


def _data(seed=1, n=300):
    rng = random.Random(seed)
    return [(i, round(rng.random(), 2), 1 if rng.random() < 0.3 else 0) for i in range(n)]


def _auc_brute(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_count_with_ties(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id long, score double, y int")
    got = M.roc_auc(df).first().auc
    assert abs(got - _auc_brute(rows)) < 1e-12


def _threshold_brute(rows, r):
    scores = np.array([s for _, s, _ in rows])
    y = np.array([t for _, _, t in rows])
    if y.sum() == 0:
        return 0.5
    cands = np.unique(np.concatenate(([0.0, 0.5, 1.0], scores)))
    valid = [c for c in cands if ((scores >= c) & (y == 1)).sum() / y.sum() >= r]
    return float(max(valid)) if valid else float(cands[0])


def test_threshold_matches_brute_force(spark):
    for seed, r in [(1, 0.74), (2, 0.5), (3, 1.0), (4, 0.01), (5, 1.5)]:
        rows = _data(seed, 120)
        df = spark.createDataFrame(rows, "id long, score double, y int")
        assert M.threshold_for_recall(df, min_recall=r).first().threshold == _threshold_brute(rows, r)


def test_threshold_no_positives(spark):
    df = spark.createDataFrame([(1, 0.3, 0), (2, 0.9, 0)], "id long, score double, y int")
    assert M.threshold_for_recall(df).first().threshold == 0.5


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.2, 0)], "id long, score double, y int")
    m = M.binary_metrics(df, threshold=0.5).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (1.0, 0.0, 0.0, 0.0)


def test_stratified_split_sizes_and_determinism(spark):
    rows = _data(7, 503)
    df = spark.createDataFrame(rows, "id long, score double, y int")
    a = M.stratified_split(df, ["id"], "y", seed=42)
    counts = {(r.split, r.y): r.n for r in a.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    for cls in (0, 1):
        n = sum(v for (s, y), v in counts.items() if y == cls)
        train = n * 6 // 10
        test = (n - train + 1) // 2
        assert counts[("train", cls)] == train and counts[("test", cls)] == test
    b = M.stratified_split(df, ["id"], "y", seed=42)
    assert sorted(a.select("id", "split").collect()) == sorted(b.select("id", "split").collect())


def test_replay_sample_class_mix(spark):
    rows = [(i, 0.5, 1 if i < 3 else 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    s = M.replay_sample(df, ["id"], "y", n=20).collect()
    assert len(s) == 20 and sum(r.y for r in s) == 3
    assert sorted(r.sample_order for r in s) == list(range(20))


def test_impute_mode_lowest_on_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", 10.0)], "c string, x double")
    st = {r.feature: r for r in M.impute_stats(df, ["x"], ["c"]).collect()}
    assert st["c"].mode == "a" and st["x"].median == 2.5


def test_logistic_regression_minimises_the_reference_objective(spark):
    """At Spark's solution the gradient of sum_i w_i * logloss_i + ||beta||^2 / 2 (balanced weights) is ~0."""
    from vigil.operators import train as TRN
    rng = np.random.default_rng(0)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    cat = rng.choice(["a", "b", "c"], size=n)
    logit = 0.8 * x1 - 1.2 * x2 + (cat == "b") * 0.7 - 0.9
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), str(c), int(t)) for a, b, c, t in zip(x1, x2, cat, y)],
                               "x1 double, x2 double, c string, y int")
    t = TRN.fit(df, ["x1", "x2"], ["c"], "y", max_iter=500)
    coef = dict(TRN.coefficients(t))
    X = np.column_stack([(x1 - t.means["x1"]) / t.scales["x1"], (x2 - t.means["x2"]) / t.scales["x2"]] +
                        [(cat == v).astype(float) for v in t.model.stages[0].labels])
    beta = np.array([coef["num:x1"], coef["num:x2"]] + [coef[f"cat:c={v}"] for v in t.model.stages[0].labels])
    b0 = coef["intercept"]
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = 1 / (1 + np.exp(-(X @ beta + b0)))
    grad = X.T @ (w * (p - y)) + beta
    grad0 = np.sum(w * (p - y))
    assert np.max(np.abs(grad)) < 1e-3 * n and abs(grad0) < 1e-3 * n
