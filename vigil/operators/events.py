"""Drift events: severity-change events with their nested payload, report flattening, drifted features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.drift import severity_rank
from vigil.operators.drift import drift_report

CONTRACT_VERSION = "v1"
EVENT_TYPE = "drift.severity_changed"
SOURCE_SERVICE = "model_service"


def drift_events(summary: DataFrame, features: DataFrame, group_cols, order_cols=("window_start",),
                 check_id_col: str = "check_id", model_version: Column | None = None,
                 environment: str = "local") -> DataFrame:
    """One drift event per severity change of consecutive checks of a group.

    event_id = ``drift_check_<check id>_severity_changed``; ``metadata`` holds the
    check ids. ``payload`` is the event as JSON (``to_json`` of the struct).
    """
    g = list(group_cols)
    keys = [*g, *order_cols, check_id_col]
    rep = drift_report(summary, features, keys)
    w = Window.partitionBy(*g).orderBy(*order_cols)
    rows = (rep.select(*keys, "drift_report")
            .withColumn("previous_severity", F.lag("drift_report.severity").over(w))
            .withColumn("previous_check_id", F.lag(check_id_col).over(w))
            .where(F.col("previous_severity").isNotNull()
                   & (F.col("previous_severity") != F.col("drift_report.severity"))))
    model = F.col(g[0]) if g else F.lit("model")
    ev = rows.select(
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.concat(F.lit("drift_check_"), F.col(check_id_col), F.lit("_severity_changed")).alias("event_id"),
        F.col(order_cols[0]).alias("created_at") if order_cols else F.current_timestamp().alias("created_at"),
        F.lit(SOURCE_SERVICE).alias("source_service"),
        model.cast("string").alias("model_name"),
        (model_version if model_version is not None else F.lit(None).cast("string")).alias("model_version"),
        "previous_severity",
        F.col("drift_report.severity").alias("new_severity"),
        F.col("drift_report.overall_score").alias("overall_score"),
        F.col("drift_report.sample_size").alias("sample_size"),
        F.col("drift_report.min_required_samples").alias("min_required_samples"),
        "drift_report",
        F.create_map(F.lit("triggered_by"), F.lit("/drift"),
                     F.lit("drift_check_id"), F.col(check_id_col),
                     F.lit("previous_drift_check_id"), F.col("previous_check_id"),
                     F.lit("environment"), F.lit(environment)).alias("metadata"),
    )
    return ev.withColumn("payload", F.to_json(F.struct(*[c for c in ev.columns])))


def report_rows(reports: DataFrame, key_cols, report_col: str = "drift_report", details=()) -> DataFrame:
    """Explode a report into one row per feature (reports without features keep one null row). ``details``: names of
    further details to show, as the strings they are kept as."""
    k = list(key_cols)
    return (reports.select(*k, F.explode_outer(F.col(f"{report_col}.features")).alias("f"))
            .select(*k, "f.feature", "f.kind", "f.score", "f.severity",
                    F.coalesce(F.col("f.details")["reason"], F.lit("")).alias("reason"),
                    *[F.col("f.details")[d].alias(d) for d in details]))


def drifted_features(report: Column, min_severity: str = "warning") -> Column:
    """Names of features at or above ``min_severity`` (unranked severities rank 0)."""
    rank = {"insufficient_data": 0, "normal": 1, "warning": 2, "critical": 3}.get(min_severity, 2)
    return F.transform(F.filter(report["features"], lambda f: severity_rank(f["severity"]) >= rank),
                       lambda f: f["feature"])


def output_severity(report: Column) -> Column:
    return report["output_drift"]["severity"]


def primary_issue(report: Column) -> Column:
    n = F.size(drifted_features(report))
    out = F.coalesce(output_severity(report), F.lit(""))
    strong_out = out.isin("warning", "critical")
    return (F.when((n > 0) & strong_out, "feature_and_output_drift").when(n > 0, "feature_drift")
            .when(strong_out, "output_drift").otherwise("no_strong_drift_signal"))
