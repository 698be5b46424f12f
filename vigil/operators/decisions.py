"""Promotion and rollback requests against their ledgers and the registry, a batch in one commit.

A batch of requests is decided against the newest version of the tables; the decisions and the registry rows they lead
to are committed together (``sources.manifest``), so neither is seen without the other, and a batch that lost against
another writer is decided anew. A request id is decided once: whatever repeats it, in the batch or later, gets the
stored decision back, marked ``duplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.ledger import upsert
from vigil.operators.promotion import (
    ALLOWED_DRIFT, CHECKS_TYPE, METRIC_MINIMA, promotion_decide, rollback_decide)
from vigil.sources.manifest import TableSet
from vigil.streaming.runner import written

SCHEMAS = {
    "promotions": "request_id string, model_name string, model_version string, requested_action string, "
                  f"target_environment string, promoted boolean, message string, checklist {CHECKS_TYPE}",
    "rollbacks": "request_id string, investigation_id string, approval_id string, model_name string, model_version string, "
                 "requested_action string, target_environment string, previous_stage string, new_stage string, "
                 "rolled_back boolean, message string, validation_error string",
    "registry": "model_name string, model_version string, model_stage string, artifact_uri string, "
                "selected_threshold double, metrics map<string,double>",
}
KEYS = ["model_name", "model_version"]


def decision_tables(spark: SparkSession, base: str) -> TableSet:
    """The promotion and rollback ledgers and the registry under ``base``, read and committed as one version."""
    return TableSet(spark, base, SCHEMAS)


def _order(cols) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _firsts(requests: DataFrame, stored: DataFrame, order_cols) -> DataFrame:
    """The first request of each id that is not stored; a map-side ``min_by``, so a repeated id is no hot key."""
    rest = [c for c in requests.columns if c != "request_id"]
    first = requests.groupBy("request_id").agg(F.min_by(F.struct(*rest), _order(order_cols)).alias("_r")).select("request_id", "_r.*")
    s = stored.select(F.col("request_id").alias("_id"))
    return first.join(s, F.col("request_id").eqNullSafe(F.col("_id")), "left_anti")


def _responses(requests: DataFrame, before: DataFrame, after: DataFrame, order_cols) -> DataFrame:
    """Every request with its id's stored decision; all but the one that led to it are duplicates. Requests of one id that
    are equal in ``order_cols``, too, count as one."""
    first = requests.groupBy("request_id").agg(F.min(_order(order_cols)).alias("_first"))
    first = first.join(before.select(F.col("request_id").alias("_old")), F.col("request_id").eqNullSafe(F.col("_old")), "left")
    known = first.select(F.col("request_id").alias("_id"), "_first", F.col("_old").isNotNull().alias("_known"))
    r = requests.select("request_id", *order_cols).join(known, F.col("request_id").eqNullSafe(F.col("_id"))).select(
        "request_id", *order_cols, (F.col("_known") | (_order(order_cols) != F.col("_first"))).alias("duplicate"))
    a = after.withColumnRenamed("request_id", "_id")
    return r.join(a, F.col("request_id").eqNullSafe(F.col("_id"))).drop("_id")


def _production(done: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with the versions of ``done`` as production, one row each; a version keeps what is not given."""
    rest = [c for c in registry.columns if c not in (*KEYS, "model_stage")]
    given = [F.col(c) if c in done.columns else F.lit(None).cast(registry.schema[c].dataType).alias(c) for c in rest]
    new = done.select(*KEYS, "request_id", *given).groupBy(*KEYS).agg(
        F.min_by(F.struct(*rest), "request_id").alias("_new"))
    old = registry.select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.struct(*rest).alias("_old"))
    same = F.col("model_name").eqNullSafe(F.col("_model_name")) & F.col("model_version").eqNullSafe(F.col("_model_version"))
    src = new.join(old, same, "left").select(*KEYS, F.lit("production").alias("model_stage"), *[
        F.coalesce(F.col("_new")[c], F.col("_old")[c]).alias(c) for c in rest])
    return upsert(registry, src, KEYS)


def request_promotions(tables: TableSet, requests: DataFrame, order_cols=("created_at",), minima=METRIC_MINIMA,
                       allowed=ALLOWED_DRIFT) -> DataFrame:
    """Decide and commit a batch of promotion requests (``promotion.promotion_decide``'s candidate columns, the columns
    ``order_cols`` that order the requests of an id, and optionally artifact_uri and selected_threshold for the registry).
    Returns a row a request: request_id, order columns, duplicate and the stored decision."""
    seen = {}

    def decide(now: dict[str, DataFrame]) -> tuple[dict, dict]:
        seen["before"] = now["promotions"]
        first = _firsts(requests, now["promotions"], order_cols)
        more = [c for c in ("artifact_uri", "selected_threshold", "metrics") if c in first.columns]
        made = written(promotion_decide(first, None, minima, allowed).join(
            first.select(F.col("request_id").alias("_id"), *more), F.col("request_id").eqNullSafe(F.col("_id"))), "promotions")
        return ({"promotions": made.select(*now["promotions"].columns)},
                {"registry": _production(made.where("promoted"), now["registry"])})
    version = tables.change(decide)
    return _responses(requests, seen["before"], tables.read(version)[1]["promotions"], order_cols)


def request_rollbacks(tables: TableSet, requests: DataFrame, order_cols=("created_at",)) -> DataFrame:
    """Decide and commit a batch of rollback requests (``promotion.rollback_decide``'s columns with ``request_id`` given,
    and ``order_cols``). Requests take effect in the order of (order columns, request id): after the first that rolls a
    version back, later ones find it in production. Returns a row a request with the stored decision."""
    seen = {}
    order = [*order_cols, "request_id"]

    def decide(now: dict[str, DataFrame]) -> tuple[dict, dict]:
        seen["before"] = now["rollbacks"]
        first = _firsts(requests, now["rollbacks"], order_cols)
        made = rollback_decide(first, now["registry"]).withColumnRenamed("target_model_version", "model_version")
        made = made.join(first.select(F.col("request_id").alias("_id"), "requested_action", "target_environment", *order_cols),
                         F.col("request_id").eqNullSafe(F.col("_id")))
        lead = made.where("rolled_back").groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.min(_order(order)).alias("_lead"))
        made = made.join(lead, F.col("model_name").eqNullSafe(F.col("_model_name"))
                         & F.col("model_version").eqNullSafe(F.col("_model_version")), "left")
        late = F.coalesce(_order(order) > F.col("_lead"), F.lit(False))
        stage = F.when(late, F.lit("production")).otherwise(F.col("previous_stage"))
        made = written(made.withColumn("previous_stage", stage).withColumn(
            "new_stage", F.when(F.col("rolled_back"), F.lit("production")).otherwise(F.col("previous_stage"))), "rollbacks")
        return ({"rollbacks": made.select(*now["rollbacks"].columns)},
                {"registry": _production(made.where("rolled_back"), now["registry"])})
    version = tables.change(decide)
    return _responses(requests, seen["before"], tables.read(version)[1]["rollbacks"], order_cols)
