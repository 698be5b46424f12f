"""A sample of registered queries against their DuckDB oracles on the smallest tables (the driver's gate)."""

import duckdb
import pytest

from tools.check_oracles import rows_of
from vigil.plans import ORACLES, QUERIES, load_all
from vigil.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["drift_analyze", "feature_drift", "quantile_bins", "categorical_profile", "severity_changes", "triage",
          "roc_auc", "threshold_for_recall", "stratified_split", "investigation_state", "job_state",
          "registry_upsert", "replay_summary", "feature_validate", "apply_approvals", "fn_keys"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    load_all()
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())
