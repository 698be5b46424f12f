import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import drift as D
from vigil.operators import stats as S


def _log(spark, rows):
    return spark.createDataFrame(rows, "id long, model_name string, created_at timestamp, x double, c string, "
                                       "probability double")


def _ref(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "m", base + dt.timedelta(minutes=i), float(i % 10), "ab"[i % 2], (i % 10) / 10 + 0.05)
            for i in range(100)]
    return S.reference_stats(_log(spark, rows), ["model_name"], ["x"], ["c"], "probability")


def test_insufficient_data(spark):
    base = dt.datetime(2024, 2, 1)
    rec = _log(spark, [(i, "m", base + dt.timedelta(minutes=i), 1.0, "a", 0.5) for i in range(10)])
    s, f = D.drift_analyze(rec, _ref(spark), ["model_name"], ["x"], ["c"])
    row = s.first()
    assert (row.sample_size, row.severity, row.overall_score, row.n_features) == (10, "insufficient_data", 0.0, 0)
    assert f.count() == 0


def test_overall_is_max_and_unknown_categories_counted(spark):
    base = dt.datetime(2024, 2, 1)
    rows = [(i, "m", base + dt.timedelta(minutes=i), 50.0 if i < 20 else float(i % 10), "zz" if i < 5 else "a",
             0.95) for i in range(60)]
    s, f = D.drift_analyze(_log(spark, rows), _ref(spark), ["model_name"], ["x"], ["c"])
    feats = {r.feature: r for r in f.collect()}
    # out-of-range values are dropped from the histogram, not counted
    assert sum(feats["x"].actual_distribution) == 40
    assert feats["c"].unknown_count == 5
    assert s.first().overall_score == max(r.score for r in feats.values())


def test_window_takes_newest_rows_per_group(spark):
    base = dt.datetime(2024, 2, 1)
    rows = [(i, g, base + dt.timedelta(minutes=i), 1.0, "a", 0.5) for i in range(30) for g in ("m", "n")]
    w = D.recent_window(_log(spark, rows), ["model_name"], 5).groupBy("model_name").agg(F.min("id").alias("lo"))
    assert {r.model_name: r.lo for r in w.collect()} == {"m": 25, "n": 25}


def test_missing_bins_give_unknown_severity(spark):
    ref = spark.createDataFrame([("m", "x", "numeric", [], None, [])],
                                "model_name string, feature string, kind string, bins array<double>, "
                                "categories array<string>, reference_distribution array<bigint>")
    base = dt.datetime(2024, 2, 1)
    rec = _log(spark, [(i, "m", base + dt.timedelta(minutes=i), 1.0, "a", 0.5) for i in range(40)])
    _, f = D.drift_analyze(rec, ref, ["model_name"], ["x"], [], None)
    r = f.first()
    assert (r.score, r.severity) == (0.0, "unknown")


def test_severity_changes_first_emits_nothing(spark):
    df = spark.createDataFrame([("m", 1, "insufficient_data"), ("m", 2, "normal"), ("m", 3, "normal"),
                                ("m", 4, "critical")], "model_name string, window_start int, severity string")
    ch = D.severity_changes(df, ["model_name"]).orderBy("window_start").collect()
    assert [(r.previous_severity, r.new_severity) for r in ch] == [("insufficient_data", "normal"),
                                                                   ("normal", "critical")]


def test_empty_reference_distribution_gives_empty_actuals(spark):
    ref = spark.createDataFrame([("m", "x", "numeric", [], None, [])],
                                "model_name string, feature string, kind string, bins array<double>, "
                                "categories array<string>, reference_distribution array<bigint>")
    base = dt.datetime(2024, 2, 1)
    rec = _log(spark, [(i, "m", base + dt.timedelta(minutes=i), 1.0, "a", 0.5) for i in range(40)])
    _, f = D.drift_analyze(rec, ref, ["model_name"], ["x"], [], None)
    assert f.first().actual_distribution == []


def test_every_numeric_feature_is_binned(spark):
    import duckdb

    from tools.check_oracles import rows_of
    from vigil.plans import ORACLES, QUERIES, load_all
    from vigil.sources.standins import LOG_NUMERIC
    from vigil.sources.tables import TABLES
    load_all()
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("bin_assign", "bin_assign_all"):
        df = QUERIES[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        assert rows_of(df.columns, rows) == rows_of(cols, res.fetchall())
    assert {r[1] for r in rows} == set(LOG_NUMERIC)


def test_wide_feature_by_category_rows(spark):
    """A feature with a value per row: PSI and chi-square by rows equal the array form, and no plan gathers categories."""
    from vigil.operators import categories as C
    rng = np.random.default_rng(5)
    old = [("m" if i % 3 else "n", str(int(x)), float(i)) for i, x in enumerate(rng.integers(0, 300, 2000))]
    new = [("m" if i % 4 else "n", None if x > 395 else str(int(x)), float(i)) for i, x in enumerate(rng.integers(100, 400, 900))]
    names = "model_name string, c string, probability double"
    ref_rows, recent = spark.createDataFrame(old, names), spark.createDataFrame(new, names)
    ref = S.reference_stats(ref_rows, ["model_name"], (), ["c"], None)
    arrays = {r["model_name"]: r for r in D.feature_drift(recent, ref, ["model_name"], (), ["c"], None).collect()}
    rows = C.category_drift(recent, C.category_dictionary(ref_rows, ["model_name"], ["c"]), ["model_name"], ["c"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("array_position", "collect_list", "collect_set", "map_from_entries"))
    got = {r["model_name"]: r for r in rows.collect()}
    assert set(got) == set(arrays) == {"m", "n"}
    for m, r in got.items():
        a = arrays[m]
        assert abs(r["score"] - a["score"]) < 1e-9 and r["severity"] == a["severity"]
        assert r["unknown_count"] == a["unknown_count"] > 0 and r["n_categories"] == len(a["categories"])
        assert abs(r["chi_square_stat"] - a["chi_square_stat"]) < 1e-6 * a["chi_square_stat"]
        assert abs(r["chi_square_p_value"] - a["chi_square_p_value"]) < 1e-9


def test_category_rows_odd_inputs(spark):
    """Null groups, features without reference or recent values, empty tables."""
    from vigil.operators import categories as C
    names = "g string, a string, b string"
    ref = spark.createDataFrame([(None, "x", None), (None, "y", None), ("k", "x", "z")], names)
    recent = spark.createDataFrame([(None, "x", "q"), (None, None, "q"), ("k", "w", None)], names)
    d = C.category_dictionary(ref, ["g"], ["a", "b"])
    got = {(r["g"], r["feature"]): r for r in C.category_drift(recent, d, ["g"], ["a", "b"]).collect()}
    assert {k: (r["n_categories"], r["unknown_count"]) for k, r in got.items() if k[0] == "k"} == {
        ("k", "a"): (1, 1), ("k", "b"): (1, 1)}
    assert got["k", "a"]["score"] == 0 and got["k", "a"]["chi_square_stat"] is None
    none = C.category_drift(recent.limit(0), d, ["g"], ["a"])
    assert none.count() == 0
    lost = C.category_drift(recent, d.limit(0), ["g"], ["a"]).collect()
    assert lost and all(r["severity"] == "unknown" and r["score"] == 0 for r in lost)


def test_wide_features_join_the_drift_check(spark):
    from vigil.operators import categories as C
    rows = [("m", i, float(i % 7), str(i % 50), 0.01 * (i % 90)) for i in range(400)]
    names = "model_name string, id long, v double, user string, probability double"
    log = spark.createDataFrame(rows, names).withColumn("created_at", F.timestamp_seconds(F.col("id")))
    recent = log.withColumn("user", F.concat(F.lit("new"), "user"))
    ref = S.reference_stats(log, ["model_name"], ["v"], (), "probability")
    d = C.category_dictionary(log, ["model_name"], ["user"])
    plain, _ = D.drift_analyze(recent, ref, ["model_name"], ["v"], ())
    summary, feats = D.drift_analyze(recent, ref, ["model_name"], ["v"], (), wide=["user"], dictionary=d)
    assert plain.first()["severity"] == "normal"
    row = feats.where("feature = 'user'").first()
    assert row["unknown_count"] == 200 and row["kind"] == "categorical"
    assert summary.first()["n_features"] == plain.first()["n_features"] + 1
