import __spark_entry__ as E


def test_entry_runs_on_smallest_tables(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["model_name", "sample_size", "min_required_samples", "severity", "overall_score",
                          "n_features", "n_drifted"]


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 100
