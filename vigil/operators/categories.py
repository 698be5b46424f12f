"""Category dictionaries as rows: reference counts, recent counts, PSI and chi-square of features with any number of
categories.

A dictionary has one row for each (group, feature, category). Recent rows are counted map-side to the same keys, meet the
dictionary in a full outer equi-join, and two aggregates give the result: totals of a feature, then the sum of its
categories' terms. No array of categories exists anywhere, so a feature as wide as a user id costs what its distinct
values cost in a shuffle, spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.chisq import chi2_sf
from vigil.functions.drift import (
    CRITICAL_THRESHOLD, EPSILON, WARNING_THRESHOLD, clip, severity_from_score)
from vigil.operators.joins import join_small
from vigil.operators.stats import MISSING, to_long


def category_dictionary(df: DataFrame, group_cols, features) -> DataFrame:
    """(group..., feature, category, reference_count): nulls count as the category ``__missing__``."""
    keys = [*group_cols, "feature"]
    return (to_long(df, group_cols, categorical=features)
            .groupBy(*keys, F.coalesce("str_value", F.lit(MISSING)).alias("category"))
            .agg(F.count(F.lit(1)).alias("reference_count")))


def recent_category_counts(recent: DataFrame, group_cols, features) -> DataFrame:
    """(group..., feature, category, recent_count): a null value has the category null."""
    return (to_long(recent, group_cols, categorical=features)
            .groupBy(*group_cols, "feature", F.col("str_value").alias("category"))
            .agg(F.count(F.lit(1)).alias("recent_count")))


def compare_categories(counts: DataFrame, dictionary: DataFrame, groups: DataFrame, group_cols,
                       ref_group_cols=None) -> DataFrame:
    """(group..., feature, category, reference_count, recent_count, known) for the dictionary's categories, zero-filled,
    in every one of ``groups``, and for recent categories that it lacks (``known`` false).

    A null value is unknown even where the reference has missing values (these are the category ``__missing__``).
    ``ref_group_cols``: the group columns the dictionary has (default: all).
    """
    g = list(group_cols)
    rg = g if ref_group_cols is None else list(ref_group_cols)
    wanted = join_small(dictionary, groups.select(*g).distinct(), rg) if rg else dictionary.join(F.broadcast(groups))
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in (*g, "feature", "category")], "reference_count")
    counts = counts.join(groups.select(*g).distinct(), g, "left_semi") if g else counts
    cond: Column = F.col("category") == F.col("_category")
    for c in (*g, "feature"):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = counts.join(wanted, cond, "full_outer")
    here = F.col("feature").isNotNull()
    return both.select(
        *[F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in (*g, "feature", "category")],
        F.coalesce("reference_count", F.lit(0)).cast("long").alias("reference_count"),
        F.coalesce("recent_count", F.lit(0)).cast("long").alias("recent_count"),
        F.col("reference_count").isNotNull().alias("known"))


def categorical_drift(compared: DataFrame, group_cols, warning: float = WARNING_THRESHOLD,
                      critical: float = CRITICAL_THRESHOLD) -> DataFrame:
    """One row per (group, feature) of ``compare_categories``: n_categories, score (PSI over the known categories),
    severity, unknown_count, chi_square_stat (null without known recent values), dof, chi_square_p_value.

    Features without a reference category have score 0 and severity ``unknown``.
    """
    keys = [*group_cols, "feature"]
    known = F.col("known")
    totals = compared.groupBy(*keys).agg(
        F.count_if(known).alias("n_categories"), F.sum("reference_count").alias("_e"),
        F.sum(F.when(known, F.col("recent_count")).otherwise(0)).alias("_a"),
        F.sum(F.when(~known, F.col("recent_count")).otherwise(0)).cast("long").alias("unknown_count"))
    rows = join_small(compared.where(known).select(*[F.col(c).alias(f"_k_{c}") for c in keys], "reference_count",
                                                   "recent_count"),
                      totals.select(*[F.col(c).alias(f"_t_{c}") for c in keys], "n_categories", "_e", "_a"),
                      _same(keys), bounded_by=totals)
    uniform = F.lit(1.0) / F.col("n_categories")
    e = F.when(F.col("_e") <= 0, uniform).otherwise(F.col("reference_count") / F.col("_e"))
    a = F.when(F.col("_a") <= 0, uniform).otherwise(F.col("recent_count") / F.col("_a"))
    expected = e * F.greatest(F.col("_a"), F.lit(1)).cast("double") + EPSILON
    terms = rows.groupBy(*[f"_k_{c}" for c in keys]).agg(
        F.sum((clip(a) - clip(e)) * F.log(clip(a) / clip(e))).alias("_psi"),
        F.sum(F.pow(F.col("recent_count") + EPSILON - expected, 2) / expected).alias("_chi"))
    out = totals.join(terms, _same(keys, "", "_k_"), "left")
    score = F.coalesce("_psi", F.lit(0.0))
    out = out.select(
        *keys, F.col("n_categories").cast("long").alias("n_categories"), score.alias("score"),
        F.when(F.col("n_categories") == 0, F.lit("unknown")).otherwise(severity_from_score(score, warning, critical))
        .alias("severity"),
        "unknown_count", F.when(F.col("_a") > 0, F.col("_chi")).alias("chi_square_stat"),
        F.when(F.col("n_categories") > 0, F.col("n_categories") - 1).cast("int").alias("dof"))
    return out.withColumn("chi_square_p_value", F.when(F.col("chi_square_stat").isNotNull(),
                                                       chi2_sf(F.col("chi_square_stat"), F.col("dof"))))


def _same(keys, left: str = "_k_", right: str = "_t_") -> Column:
    cond = None
    for c in keys:
        e = F.col(left + c).eqNullSafe(F.col(right + c))
        cond = e if cond is None else cond & e
    return cond


def category_drift(recent: DataFrame, dictionary: DataFrame, group_cols, features, groups: DataFrame | None = None,
                   ref_group_cols=None, warning: float = WARNING_THRESHOLD, critical: float = CRITICAL_THRESHOLD
                   ) -> DataFrame:
    """``categorical_drift`` of recent rows against a dictionary (its features limited to ``features``)."""
    g = list(group_cols)
    groups = recent.select(*g).distinct() if groups is None else groups
    known = dictionary.where(F.col("feature").isin(list(features)))
    return categorical_drift(compare_categories(recent_category_counts(recent, g, features), known, groups, g,
                                                ref_group_cols), g, warning, critical)
