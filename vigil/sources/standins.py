"""Monitoring inputs derived from the given tables (see FIXTURES.md §2).

* prediction log  ← ``events``: model = event_type, features value, k (from props),
  user_segment; probability = value / (value + 35); class = p >= 0.5.
* reference period ts < 2024-01-21, recent period the rest.
* training table ← ``lineitem``: y = returnflag 'R'; score = quantity*(1-discount)/50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import read_table

# Fixed values of the stand-in definitions.
REFERENCE_END = "2024-01-21 00:00:00"
PROBABILITY_SHIFT = 35.0
LOG_NUMERIC = ["value", "k"]
LOG_CATEGORICAL = ["user_segment"]
LOG_WIDE = ["user_key"]  # a categorical feature with as many values as there are users


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    p = F.col("value") / (F.col("value") + F.lit(PROBABILITY_SHIFT))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("model_name"),
        (F.col("user_id") % 10).alias("segment"),
        F.col("ts").alias("created_at"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("user_id") % 10).cast("string").alias("user_segment"),
        F.col("user_id").cast("string").alias("user_key"),
        p.alias("probability"),
        (p >= 0.5).cast("int").alias("predicted_class"),
        F.lit(0.5).alias("threshold"),
    )


def reference_end():
    return F.lit(REFERENCE_END).cast("timestamp_ntz")


def reference_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("created_at") < reference_end())


def recent_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("created_at") >= reference_end())


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") * (1 - F.col("l_discount")) / 50).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


# Training-table stand-in over ``lineitem``: numeric and categorical features, target, score, split key.
TRAIN_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TRAIN_CATEGORICAL = ["l_linestatus"]
TRAIN_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SENTINEL_COLUMN, SENTINEL_VALUE, SENTINEL_REPLACEMENT = "l_quantity", 50, -1


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        *TRAIN_KEY, *TRAIN_NUMERIC, *TRAIN_CATEGORICAL, "l_returnflag", "l_shipdate",
        (F.col("l_quantity") * (1 - F.col("l_discount")) / 50).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


# ---- ledgers ------------------------------------------------------------------------------------------------
# Fixed mappings of the ledger stand-ins (orders → investigations / approvals, lineitem → updates).
ORDER_STATUS_TO_INVESTIGATION = {"O": "running", "P": "waiting_for_approval", "F": "resolved"}
ORDER_STATUS_TO_APPROVAL = {"O": "pending", "P": "rejected", "F": "approved"}
PRIORITY_TO_ACTION = {"1-URGENT": "rollback_production", "2-HIGH": "retrain"}
OTHER_ACTION = "promote_to_production"


def _map(col: str, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v)
    return expr.otherwise(F.lit(default))


def investigations_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("inv_"), F.col("o_orderkey").cast("string")).alias("investigation_id"),
        F.concat(F.lit("evt_"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.col("o_orderkey"), F.col("o_custkey"),
        F.col("o_orderpriority").alias("model_name"),
        _map("o_orderstatus", ORDER_STATUS_TO_INVESTIGATION).alias("status"),
        F.col("o_orderdate").alias("opened_at"),
        F.col("o_totalprice"),
    )


def approvals_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("apr_"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.concat(F.lit("inv_"), F.col("o_orderkey").cast("string")).alias("investigation_id"),
        _map("o_orderpriority", PRIORITY_TO_ACTION, OTHER_ACTION).alias("requested_action"),
        _map("o_orderstatus", ORDER_STATUS_TO_APPROVAL).alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey"),
    )


def investigation_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update event per lineitem of the order; null fields leave the stored value."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("inv_"), F.col("l_orderkey").cast("string")).alias("investigation_id"),
        F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("seq"),
        "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
        .when(F.col("l_linestatus") == "F", "resolved").otherwise("running").alias("status"),
        F.when(F.col("l_returnflag") == "R", "waiting_for_job").when(F.col("l_returnflag") == "A", "completed")
        .alias("current_step"),
        F.when(F.col("l_discount") >= 0.05, "retrain").alias("recommended_action"),
        F.when(F.col("l_tax") == 0, F.concat(F.lit("tax-free line "), F.col("l_linenumber").cast("string")))
        .alias("summary"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "resolve").otherwise("update")
        .alias("op"),
    )


def job_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: a job is (user, day); each of the user's events that day is one attempt, ``error`` fails."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"))
        .alias("job_id"),
        F.col("user_id"), F.col("event_id"), F.col("ts"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("job_type"),
        F.col("value"),
    )


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final job results of the attempt log (completed or dead-lettered), with a result map.

    job type by user: 0 → replay_test, 1 → retrain, 2 → rollback (user_id mod 3); replay passes when the
    terminal value exceeds 10; retrain completes when it exceeds 5 and names version ``v<value // 100>``
    when it exceeds 20.
    """
    from vigil.operators.queue import route_attempts
    r = route_attempts(job_attempts(spark, sf_dir))
    term = r.where(F.col("outcome").isin("completed", "dlq"))
    jt = F.when(F.col("user_id") % 3 == 0, "replay_test").when(F.col("user_id") % 3 == 1, "retrain").otherwise(
        "rollback")
    v = F.col("value")
    res = F.create_map(F.lit("passed"), (v > 10).cast("string"), F.lit("completed"), (v > 5).cast("string"),
                       F.lit("model_version"), F.when(v > 20, F.concat(F.lit("v"), F.floor(v / 100).cast("string"))))
    return term.select(
        "job_id", F.concat(F.lit("inv_"), F.col("user_id").cast("string")).alias("investigation_id"),
        jt.alias("job_type"), F.col("outcome").alias("status"), res.alias("result"),
        F.when(F.col("outcome") == "dlq", F.lit("max attempts reached")).alias("error_message"),
        F.col("attempt").alias("attempts"), F.col("ts").alias("finished_at"))
