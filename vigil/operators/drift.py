"""Drift of recent predictions against reference statistics, for many groups at once.

Plan shape: recent rows (grouped top-N, partial limit before the shuffle) →
long form → broadcast join with the reference dictionary (checked size) → bin
or category slot as an expression → one partial/final hash aggregate on
(group, feature, slot) → small per-feature arrays → PSI / chi-square /
severity as array expressions → max per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.chisq import chi2_sf
from vigil.functions.drift import (
    CRITICAL_THRESHOLD, MIN_SAMPLES, RECENT_WINDOW_SIZE, WARNING_THRESHOLD, bin_index, chi_square_defined,
    chi_square_stat, psi, severity_from_score, severity_rank)
from vigil.operators.joins import attach, join_small, materialize_small
from vigil.operators.stats import to_long


# Why a feature has no score.
NO_BINS = "Missing reference bins or distribution."
NO_CATEGORIES = "Missing reference categories or distribution."


def recent_window(log: DataFrame, group_cols, n: int | None = RECENT_WINDOW_SIZE, ts_col: str = "created_at",
                  id_col: str = "id") -> DataFrame:
    """Newest ``n`` rows per group (ties on time broken by id, newest first); ``n=None`` keeps all.

    ``row_number() <= n`` becomes a WindowGroupLimit, applied before and after
    the shuffle, so only n rows per group per partition travel.
    """
    if n is None:
        return log
    g = list(group_cols)
    if not g:
        return log.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)
    w = Window.partitionBy(*g).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def slot_rows(recent: DataFrame, reference: DataFrame, group_cols, numeric=(), categorical=(),
              prob_col: str | None = "probability", ref_group_cols=None, keep=(), how: str = "inner") -> DataFrame:
    """Long form of the recent rows with each value's slot: its bin (numeric / output) or category index
    (categorical, -1 = unknown or null). Narrow: a broadcast join with the reference dictionary (``how='left'``
    keeps rows of features the reference lacks, with a null slot)."""
    g = list(group_cols)
    rg = g if ref_group_cols is None else list(ref_group_cols)
    rkeys = [*rg, "feature"]
    cols = [*g, *keep, *numeric, *categorical] + ([prob_col] if prob_col else [])
    long_df = to_long(recent.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)]), g, numeric, categorical,
                      keep=list(keep))
    if prob_col:
        out = recent.select(*g, *keep, F.lit("__output__").alias("feature"), F.lit("output_probability").alias("kind"),
                            F.col(prob_col).cast("double").alias("num_value"),
                            F.lit(None).cast("string").alias("str_value"))
        long_df = long_df.unionByName(out)
    ref_slots = reference.select(*rkeys, F.col("kind").alias("ref_kind"), "bins", "categories")
    tagged = join_small(long_df, ref_slots, rkeys, how)
    numeric_like = F.col("ref_kind").isin("numeric", "output_probability")
    slot = (F.when(F.col("ref_kind").isNull(), F.lit(None).cast("int"))
            .when(numeric_like, bin_index("num_value", "bins")).when(F.col("str_value").isNull(), F.lit(-1))
            .otherwise(F.array_position("categories", F.col("str_value")).cast("int") - 1))
    return tagged.select(*g, *keep, "feature", slot.alias("_slot"))


def drift_from_counts(per_slot: DataFrame, reference: DataFrame, groups: DataFrame, group_cols,
                      warning: float = WARNING_THRESHOLD, critical: float = CRITICAL_THRESHOLD,
                      ref_group_cols=None) -> DataFrame:
    """Feature drift rows from slot counts ``(group..., feature, _slot, _n)``; ``groups`` lists the groups to
    report (every reference feature that the log has gets a row, its missing slots zero-filled)."""
    g = list(group_cols)
    rg = g if ref_group_cols is None else list(ref_group_cols)
    keys = [*g, "feature"]
    rkeys = [*rg, "feature"]
    ref = reference.select(*rkeys, F.col("kind").alias("ref_kind"), "bins", "categories",
                           F.col("reference_distribution").alias("expected_distribution"))
    dense = per_slot.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_slot") >= 0, F.struct("_slot", "_n")))).alias("_m"),
        F.sum(F.when(F.col("_slot") == -1, F.col("_n")).otherwise(0)).alias("unknown_count"))
    # a reference feature that the log lacks has no slots and is skipped; null values have slots of their own
    res = (ref.join(groups, rg).join(dense, keys)
           .withColumn("actual_distribution", F.when(
               F.coalesce(F.size("expected_distribution"), F.lit(0)) > 0, F.transform(
                   F.sequence(F.lit(0), F.size("expected_distribution") - 1),
                   lambda i: F.coalesce(F.col("_m")[i], F.lit(0)).cast("long"))).otherwise(
               F.array().cast("array<bigint>")))
           .withColumn("_empty", (F.coalesce(F.when(F.col("bins").isNotNull(), F.size("bins"))
                                             .otherwise(F.size("categories")), F.lit(0)) <= 0)
                       | (F.coalesce(F.size("expected_distribution"), F.lit(0)) <= 0)))
    is_cat = F.col("ref_kind") == "categorical"
    exp_, act_ = F.col("expected_distribution"), F.col("actual_distribution")
    res = res.select(
        *keys,
        F.when(F.col("ref_kind").isin("numeric", "output_probability"), F.col("ref_kind"))
        .otherwise(F.lit("categorical")).alias("kind"),
        F.when(F.col("_empty"), F.lit(0.0)).otherwise(psi(exp_, act_)).alias("score"),
        "_empty", "bins", "categories", "expected_distribution", "actual_distribution",
        F.when(is_cat, F.coalesce("unknown_count", F.lit(0))).alias("unknown_count"),
        F.when(is_cat & ~F.col("_empty") & chi_square_defined(exp_, act_), chi_square_stat(exp_, act_))
        .alias("chi_square_stat"),
        (F.size("expected_distribution") - 1).alias("_dof"),
        F.when(F.col("_empty") & (F.col("ref_kind") == "numeric"), F.lit(NO_BINS))
        .when(F.col("_empty") & is_cat, F.lit(NO_CATEGORIES)).alias("reason"),
    )
    res = res.withColumn("severity", F.when(F.col("_empty"), F.lit("unknown")).otherwise(
        severity_from_score("score", warning, critical)))
    # the p-value needs an incomplete gamma function: Arrow-batched UDF on aggregated rows only
    res = res.withColumn("chi_square_p_value", F.when(F.col("chi_square_stat").isNotNull(),
                                                      chi2_sf(F.col("chi_square_stat"), F.col("_dof"))))
    return res.select(*keys, "kind", "score", "severity", "bins", "categories", "expected_distribution",
                      "actual_distribution", "unknown_count", "chi_square_stat", "chi_square_p_value", "reason")


def feature_drift(recent: DataFrame, reference: DataFrame, group_cols, numeric=(), categorical=(),
                  prob_col: str | None = "probability", warning: float = WARNING_THRESHOLD,
                  critical: float = CRITICAL_THRESHOLD, groups: DataFrame | None = None,
                  ref_group_cols=None) -> DataFrame:
    """One row per (group, feature) present in both the reference and the recent rows.

    Columns: kind, score, severity, expected/actual distributions, unknown_count,
    chi_square_stat, chi_square_p_value. The output probability is feature
    ``__output__`` with kind ``output_probability``.
    """
    g = list(group_cols)
    rg = g if ref_group_cols is None else list(ref_group_cols)
    ref = materialize_small(reference.select(*rg, "feature", "kind", "bins", "categories", "reference_distribution"))
    rows = slot_rows(recent, ref, g, numeric, categorical, prob_col, ref_group_cols=rg)
    per_slot = rows.groupBy(*g, "feature", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    groups = recent.select(*g).distinct() if groups is None else groups
    return drift_from_counts(per_slot, ref, groups, g, warning, critical, ref_group_cols=rg)


def drift_analyze(log: DataFrame, reference: DataFrame, group_cols, numeric=(), categorical=(),
                  prob_col: str | None = "probability", window: int | None = RECENT_WINDOW_SIZE,
                  min_samples: int = MIN_SAMPLES, ts_col: str = "created_at", id_col: str = "id",
                  warning: float = WARNING_THRESHOLD, critical: float = CRITICAL_THRESHOLD,
                  ref_group_cols=None, wide=(), dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Grouped drift check. Returns ``(summary, features)``.

    summary: one row per group with sample_size, min_required_samples, severity
    (``insufficient_data`` below the minimum), overall_score = max of feature and
    output scores (0.0 start). features: ``feature_drift`` rows of the groups with
    enough samples. Features in ``wide`` are compared by the category rows of ``dictionary``
    (``categories.category_dictionary``): they may have any number of categories and have no arrays in the result.
    """
    g = list(group_cols)
    if not g:  # one implicit group
        log, reference = log.withColumn("_all", F.lit(1)), reference.withColumn("_all", F.lit(1))
        dictionary = None if dictionary is None else dictionary.withColumn("_all", F.lit(1))
        summary, feats = drift_analyze(log, reference, ["_all"], numeric, categorical, prob_col, window,
                                       min_samples, ts_col, id_col, warning, critical, ["_all"], wide, dictionary)
        return summary.drop("_all"), feats.drop("_all")
    rg = g if ref_group_cols is None else list(ref_group_cols)
    recent = recent_window(log, g, window, ts_col, id_col)
    ref = materialize_small(reference.select(*rg, "feature", "kind", "bins", "categories", "reference_distribution"))
    # one pass over the recent rows: every row gives exactly one long row per feature, so the slot counts of
    # any one feature also give the group's sample size (no second scan of the log)
    rows = slot_rows(recent, ref, g, numeric, categorical, prob_col, ref_group_cols=rg, how="left")
    per_slot = materialize_small(rows.groupBy(*g, "feature", "_slot").agg(F.count(F.lit(1)).alias("_n")))
    probe = (list(numeric) + list(categorical) + (["__output__"] if prob_col else []))[0]
    sizes = (per_slot.where(F.col("feature") == probe).groupBy(*g)
             .agg(F.sum("_n").cast("long").alias("sample_size")))
    enough = sizes.where(F.col("sample_size") >= min_samples).select(*g)
    feats = drift_from_counts(per_slot, ref, enough, g, warning, critical, ref_group_cols=rg)
    if wide:
        from vigil.operators.categories import category_drift
        more = category_drift(recent, dictionary, g, wide, enough, rg, warning, critical)
        feats = feats.unionByName(more.withColumn("kind", F.lit("categorical")).withColumn("reason", F.when(
            F.col("n_categories") == 0, F.lit(NO_CATEGORIES))).drop("n_categories", "dof"), allowMissingColumns=True)
    # small (groups x features) and read by the summary and by every caller that also wants the rows
    feats = materialize_small(feats)
    best = feats.groupBy(*g).agg(
        F.max("score").alias("_max"),
        F.count_if(F.col("feature") != "__output__").alias("n_features"),
        F.count_if((F.col("feature") != "__output__") & (severity_rank("severity") >= 2)).alias("n_drifted"))
    summary = sizes.join(best, g, "left")
    enough_rows = F.col("sample_size") >= min_samples
    overall = F.when(enough_rows, F.greatest(F.coalesce("_max", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    summary = summary.select(
        *g, "sample_size", F.lit(min_samples).cast("long").alias("min_required_samples"),
        F.when(enough_rows, severity_from_score(overall, warning, critical)).otherwise(F.lit("insufficient_data"))
        .alias("severity"),
        overall.alias("overall_score"),
        F.when(enough_rows, F.coalesce("n_features", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_features"),
        F.when(enough_rows, F.coalesce("n_drifted", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_drifted"),
    )
    return summary, feats


def drift_report(summary: DataFrame, features: DataFrame, group_cols) -> DataFrame:
    """Nested report per group, shaped like the drift event's ``drift_report`` struct."""
    g = list(group_cols)
    feat_struct = F.struct(
        "feature", "kind", "score", "severity",
        F.create_map(*[x for name, value in (
            *[(c, F.col(c).cast("string")) for c in ("unknown_count", "chi_square_stat", "chi_square_p_value", "reason")],
            *[(c, F.to_json(c)) for c in ("bins", "categories", "expected_distribution", "actual_distribution")])
            for x in (F.lit(name), value)]).alias("details"))
    per = features.groupBy(*g).agg(
        F.array_sort(F.collect_list(F.when(F.col("feature") != "__output__",
                                           F.struct(F.col("feature").alias("_k"), feat_struct.alias("f")))),
                     lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0))
        .alias("_fs"),
        F.max(F.when(F.col("feature") == "__output__", F.struct(
            F.col("kind"), F.col("score"), F.col("severity"), F.col("bins").alias("probability_bins"),
            F.col("actual_distribution"), F.col("expected_distribution")))).alias("output_drift"))
    joined = summary.join(per, g, "left") if g else attach(summary, per)
    return joined.select(*g, F.struct(
        "sample_size", "min_required_samples", "severity", "overall_score",
        F.coalesce(F.transform("_fs", lambda x: x["f"]), F.array().cast(
            "array<struct<feature:string,kind:string,score:double,severity:string,details:map<string,string>>>"))
        .alias("features"),
        "output_drift").alias("drift_report"))


def windowed_drift(log: DataFrame, reference: DataFrame, group_cols, numeric=(), categorical=(),
                   prob_col: str | None = "probability", duration: str = "1 day", slide: str | None = None,
                   ts_col: str = "created_at", min_samples: int = MIN_SAMPLES, warning: float = WARNING_THRESHOLD,
                   critical: float = CRITICAL_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Drift per event-time window (tumbling, or sliding with ``slide``) against a per-group reference.

    Adds ``window_start`` to the group; every row of a window is used (no row cap).
    """
    g = list(group_cols)
    w = F.window(ts_col, duration, slide) if slide else F.window(ts_col, duration)
    windowed = log.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).drop("_w")
    return drift_analyze(windowed, reference, [*g, "window_start"], numeric, categorical, prob_col, window=None,
                         min_samples=min_samples, ts_col=ts_col, warning=warning, critical=critical,
                         ref_group_cols=g)


def severity_changes(checks: DataFrame, group_cols, order_cols=("window_start",), severity_col: str = "severity"
                     ) -> DataFrame:
    """Checks whose severity differs from the previous check of the same group (the first emits nothing).

    ``insufficient_data`` → ``normal`` is a change like any other.
    """
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(*order_cols) if g else Window.orderBy(*order_cols)
    return (checks.withColumn("previous_severity", F.lag(severity_col).over(w))
            .where(F.col("previous_severity").isNotNull() & (F.col("previous_severity") != F.col(severity_col)))
            .withColumnRenamed(severity_col, "new_severity"))


def latest_per_group(df: DataFrame, group_cols, order_cols) -> DataFrame:
    """Newest row per group by ``order_cols`` (all descending), as ``max_by`` over a struct."""
    g = list(group_cols)
    key = F.struct(*[F.col(c) for c in order_cols])
    rest = [c for c in df.columns if c not in g]
    agg = (df.groupBy(*g) if g else df.groupBy()).agg(F.max_by(F.struct(*rest), key).alias("_r"))
    return agg.select(*g, "_r.*")
