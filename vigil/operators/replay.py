"""Replay comparison: expected outputs saved with a model against outputs scored now, joined by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the promotion gate.
MAX_REPLAY_MISMATCHES = 0
MAX_PROBABILITY_DIFFERENCE = 1e-12


def fixture_rows(fixture: DataFrame) -> DataFrame:
    """Parallel arrays of a fixture document (bare or under ``fixture``) → one row per ``row_index``.

    Expected arrays shorter than ``rows`` give nulls (``arrays_zip`` pads).
    """
    def pick(name):
        if "fixture" in fixture.columns:
            return F.coalesce(F.col(f"fixture.{name}"), F.col(name)) if name in fixture.columns else F.col(
                f"fixture.{name}")
        return F.col(name)
    zipped = F.arrays_zip(pick("rows").alias("row"), pick("expected_probabilities").alias("expected_probability"),
                          pick("expected_predictions").alias("expected_prediction"),
                          pick("actual_classes").alias("actual_class"))
    return fixture.select(F.posexplode(zipped).alias("row_index", "z")).select("row_index", "z.*")


def replay_compare(actual: DataFrame, expected: DataFrame, key: str = "row_index", group_cols=()) -> DataFrame:
    """actual ⟕ expected on position: probability difference and prediction match (null when expected is missing).

    ``actual`` has actual_probability, actual_prediction; ``expected`` has expected_probability,
    expected_prediction.
    """
    g = list(group_cols)
    j = actual.join(expected, [*g, key], "left")
    return j.withColumn("probability_difference",
                        F.abs(F.col("actual_probability") - F.col("expected_probability"))).withColumn(
        "prediction_matches", F.col("actual_prediction") == F.col("expected_prediction"))


def replay_summary(compared: DataFrame, group_cols=()) -> DataFrame:
    """total rows, max probability difference (0.0 when none), mismatches; ``passed`` = no mismatch (job rule),
    ``gate_passed`` also needs the difference within 1e-12 (promotion rule)."""
    g = list(group_cols)
    agg = (compared.groupBy(*g) if g else compared.groupBy()).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.max("probability_difference"), F.lit(0.0)).alias("max_probability_difference"),
        F.count_if(~F.col("prediction_matches")).alias("prediction_mismatches"))
    return agg.withColumn("passed", F.col("prediction_mismatches") == 0).withColumn(
        "gate_passed", (F.col("prediction_mismatches") <= MAX_REPLAY_MISMATCHES)
        & (F.col("max_probability_difference") <= MAX_PROBABILITY_DIFFERENCE))
