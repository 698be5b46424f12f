"""Plan shape of the flagship: filters reach the scan, columns are pruned, the reference side is broadcast."""

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_pushes_filters_and_broadcasts(spark):
    q = E.queries()["drift_analyze"](spark, "/root/testdata/sf0.01")
    plan = _plan(q)
    # the recent-period predicate is evaluated by the parquet reader
    assert "GreaterThanOrEqual(ts,2024-01-21" in plan
    # only the needed columns are read from events
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double," \
           "props:string>" in plan
    # the reference dictionary joins by broadcast (no shuffle of the recent rows for it)
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grouped_recent_window_is_limited_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from vigil.operators.drift import recent_window
    df = spark.range(0, 1000).select((F.col("id") % 5).alias("m"), F.col("id").alias("id"),
                                     F.col("id").cast("timestamp").alias("created_at"))
    plan = _plan(recent_window(df, ["m"], 10))
    assert "WindowGroupLimit" in plan
