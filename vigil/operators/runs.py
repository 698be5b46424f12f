"""Training-run delivery checks: required vs produced artifacts, staleness, acceptance (first failure wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Staleness tolerance and the ordered acceptance failures.
STALE_TOLERANCE_SECONDS = 2
#: The files that a training run must leave, in the order they are checked.
REQUIRED_ARTIFACTS = ["model_pipeline.joblib", "schema.json", "runtime_config.json", "reference_stats.json",
                      "replay_fixture.json", "metrics.json", "environment.json", "model_card.md", "training_summary.json"]
ACCEPTANCE_ORDER = ["exit_code", "summary_missing", "summary_invalid", "artifacts_missing", "artifacts_stale",
                    "not_completed"]


def delivery_check(required: DataFrame, produced: DataFrame, run_key: str = "run_id") -> DataFrame:
    """required (run, artifact, started_at) ⟕ produced (run, artifact, produced_at): missing when absent,
    stale when produced more than 2 s before the run started."""
    j = required.join(produced, [run_key, "artifact"], "left")
    limit = F.col("started_at") - F.make_dt_interval(secs=F.lit(STALE_TOLERANCE_SECONDS))
    return j.withColumn("missing", F.col("produced_at").isNull()).withColumn(
        "stale", F.col("produced_at").isNotNull() & (F.col("produced_at") < limit))


def run_acceptance(runs: DataFrame, checked: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Accept a run only if exit code 0, a (valid) summary, nothing missing or stale, and completed = true.

    runs: run_id, exit_code, summary_present, summary_valid, completed. The first failing rule names the reason.
    """
    per = checked.groupBy(run_key).agg(F.count_if("missing").alias("n_missing"), F.count_if("stale").alias("n_stale"))
    j = runs.join(per, run_key, "left")
    reason = (F.when(F.col("exit_code") != 0, "exit_code")
              .when(~F.col("summary_present"), "summary_missing")
              .when(~F.col("summary_valid"), "summary_invalid")
              .when(F.coalesce(F.col("n_missing"), F.lit(0)) > 0, "artifacts_missing")
              .when(F.coalesce(F.col("n_stale"), F.lit(0)) > 0, "artifacts_stale")
              .when(~F.coalesce(F.col("completed"), F.lit(False)), "not_completed"))
    return j.withColumn("failure", reason).withColumn("accepted", F.col("failure").isNull())
