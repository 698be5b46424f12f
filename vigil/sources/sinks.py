"""Sinks: partitioned appends, versioned snapshots, JSON artifacts.

Every write goes to a new folder or a new partition; nothing is rewritten in
place, so a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_partitioned(df: DataFrame, path: str, partition_cols=("dt",), fmt: str = "parquet") -> None:
    """Append rows (predictions, drift checks) partitioned by day, so recent windows prune partitions."""
    df.write.mode("append").partitionBy(*partition_cols).format(fmt).save(path)


def write_epoch(df: DataFrame, path: str, epoch: int, partition_cols=("dt",)) -> None:
    """A micro-batch's rows in a folder of its epoch, by day within it: a replayed epoch overwrites itself."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(f"{path}/epoch={epoch}")


def predictions_with_day(df: DataFrame, ts_col: str = "created_at") -> DataFrame:
    return df.withColumn("dt", F.to_date(ts_col))


def drift_checks(summary: DataFrame, features: DataFrame, group_cols, checked_at: DataFrame, warning: float,
                 critical: float) -> DataFrame:
    """Rows of the drift-check table: a group's check with its thresholds, the whole report (features with details, output
    drift) as JSON, when it was made (``checked_at``: a time a group) and the day, to partition by."""
    from vigil.operators.drift import drift_report
    g = list(group_cols)
    report = drift_report(summary, features, g).withColumn("report", F.to_json("drift_report")).drop("drift_report")
    return (summary.drop("n_features").join(report, g).join(checked_at, g)
            .withColumn("warning_threshold", F.lit(warning)).withColumn("critical_threshold", F.lit(critical))
            .withColumn("dt", F.to_date("checked_at")))


def append_drift_checks(checks: DataFrame, path: str) -> None:
    """Append checks to their table, a folder a day."""
    append_partitioned(checks, path)


def write_versioned(df: DataFrame, path: str, version_col: str = "version") -> None:
    """Snapshot(s) under ``version=<v>`` partitions (dynamic overwrite touches only the versions written)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version_col).parquet(path)


def natural_order(version) -> Column:
    """A string that sorts versions by their numbers: every run of digits widened to 20 places (``w9`` < ``w10``)."""
    widened = F.regexp_replace(F.col(version).cast("string"), r"(\d+)", "0" * 19 + "$1")
    return F.regexp_replace(widened, r"\d*(\d{20})", "$1")


def read_newest(spark: SparkSession, path: str, key_cols, version_col: str = "version") -> DataFrame:
    """Rows of the newest version per key (by natural order, then a semi join)."""
    df = spark.read.parquet(path)
    newest = df.groupBy(*key_cols).agg(
        F.max_by(version_col, F.struct(natural_order(version_col), F.col(version_col))).alias(version_col))
    return df.join(newest, [*key_cols, version_col], "left_semi")


def write_json_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
