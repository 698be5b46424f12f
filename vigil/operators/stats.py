"""Reference statistics: profiles, learned bins, histograms, PSI inputs.

Tables are long: one row per (group..., feature). Wide feature tables are
turned long once with ``to_long`` so every feature is profiled by the same
grouped aggregate instead of one pass per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.drift import DECILE_LEVELS, PROBABILITY_EDGES, bin_index, learned_edges
from vigil.operators.joins import cut_lineage, join_small, materialize_small, persist_shared
from vigil.operators.ordered import DEFAULT_RANGES, running_totals

MISSING = "__missing__"
PROFILE_LEVELS = DECILE_LEVELS + [0.5, 0.25, 0.75]


def _q(name: str) -> str:
    return f"`{name}`"


def to_long(df: DataFrame, group_cols, numeric=(), categorical=(), keep=()) -> DataFrame:
    """Wide feature columns → rows ``(group..., keep..., feature, kind, num_value, str_value)``."""
    items = [F.struct(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"),
                      F.col(_q(c)).cast("double").alias("num_value"), F.lit(None).cast("string").alias("str_value"))
             for c in numeric]
    items += [F.struct(F.lit(c).alias("feature"), F.lit("categorical").alias("kind"),
                       F.lit(None).cast("double").alias("num_value"), F.col(_q(c)).cast("string").alias("str_value"))
              for c in categorical]
    return df.select(*[F.col(_q(c)) for c in [*group_cols, *keep]], F.inline(F.array(*items)))


def value_counts(df: DataFrame, group_cols, value_col: str, count_col: str = "cnt") -> DataFrame:
    """Distinct non-null, non-NaN values with their multiplicity (map-side combined)."""
    v = F.col(value_col)
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group_cols, value_col)
            .agg(F.count(F.lit(1)).alias(count_col)))


def numeric_profile(long_df: DataFrame, group_cols, ranges: int = DEFAULT_RANGES, approx: bool = False) -> DataFrame:
    """Per (group, feature): mean, std (population), min, max, median, q25, q75, missing, edges, counts.

    ``long_df`` has ``feature`` and ``num_value``. Edges are the unique deciles
    (fallbacks as in ``learned_edges``); counts are the reference histogram on them. ``approx``: quantiles from
    sketches (``approx_numeric_profile``), for tables whose distinct values are too many to shuffle.
    """
    if approx:
        return approx_numeric_profile(long_df, group_cols)
    keys = [*group_cols, "feature"]
    counts = long_df.groupBy(*keys, "num_value").agg(F.count(F.lit(1)).alias("cnt"))
    return _numeric_from_counts(persist_shared(counts), keys, ranges)


#: Size of a quantile sketch. Its quantiles have a rank error of 2.296 / KLL_K ** 0.9723 (99 % of the time): 0.23 %.
KLL_K = 1200
KLL_STEPS = 400


def kll_rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a sketch of that size, at 99 % confidence (the sketch's own published bound)."""
    return 2.296 / k ** 0.9723


def approx_numeric_profile(long_df: DataFrame, group_cols, k: int = KLL_K) -> DataFrame:
    """``numeric_profile`` with sketched quantiles: one aggregate, combined map-side, whose shuffle carries a sketch for
    each (group, feature) and task, however many distinct values there are.

    mean, std, min, max and the counts are exact; quantiles and the edges learned from them have a rank error of at
    most ``kll_rank_error(k)``; the histogram on these edges is the sketch's, read at ``KLL_STEPS`` places: a bin's share
    is off by twice that error and one step at most.
    """
    keys = [*group_cols, "feature"]
    v = F.col("num_value")
    x = F.when(v.isNotNull() & ~F.isnan(v), v)
    agg = long_df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count_if(x.isNull()).alias("missing_count"), F.count(x).alias("n_valid"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("_s"))
    some = F.col("n_valid") > 0
    levels = F.array(*[F.lit(float(p)) for p in PROFILE_LEVELS])
    prof = agg.withColumn("_q", F.when(some, F.kll_sketch_get_quantile_double("_s", levels)))
    prof = prof.withColumn("bins", learned_edges(F.slice("_q", 1, 11), "min", "max"))
    # the share of rows below an edge: of the sketch's quantiles at even steps, those below it
    steps = F.array(*[F.lit((i + 0.5) / KLL_STEPS) for i in range(KLL_STEPS)])
    prof = prof.withColumn("_g", F.when(some, F.kll_sketch_get_quantile_double("_s", steps)))
    inner = F.transform(F.slice("bins", 2, F.size("bins") - 2), lambda e: F.size(F.filter("_g", lambda q: q < e)) / F.lit(float(KLL_STEPS)))
    ranks = F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))
    prof = prof.withColumn("_r", F.when(some, ranks))
    hist = F.transform(F.sequence(F.lit(1), F.size("_r") - 1), lambda i: F.round(
        (F.element_at("_r", i + 1) - F.element_at("_r", i)) * F.col("n_valid")).cast("long"))
    return prof.select(*keys, "mean", "std", "min", "max", "missing_count", "n_valid",
                       *[F.element_at("_q", i).alias(n) for i, n in ((12, "median"), (13, "q25"), (14, "q75"))], "bins",
                       F.when(some, hist).otherwise(F.array(F.lit(1).cast("long"))).alias("reference_distribution"))


def categorical_profile(long_df: DataFrame, group_cols) -> DataFrame:
    """Per (group, feature): categories by frequency (desc count, then category), counts, missing, n_unique.

    Nulls count as the category ``__missing__``.
    """
    keys = [*group_cols, "feature"]
    cat = F.coalesce(F.col("str_value"), F.lit(MISSING))
    counts = long_df.groupBy(*keys, cat.alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("str_value").isNull()).alias("nulls"))
    ordered = counts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "category", "n"))).alias("_s"),
        F.sum("nulls").alias("missing_count"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    return ordered.select(
        *keys,
        F.transform("_s", lambda s: s["category"]).alias("categories"),
        F.transform("_s", lambda s: s["n"]).alias("reference_distribution"),
        "missing_count", "n_unique",
    )


def probability_histogram(df: DataFrame, group_cols, prob_col: str = "probability",
                          out_col: str = "reference_distribution") -> DataFrame:
    """Counts of probabilities on ten equal bins of [0, 1] (edges built like a linear space), one aggregate."""
    edges = F.array(*[F.lit(e) for e in PROBABILITY_EDGES])
    g = list(group_cols)
    hist = _histogram(df, g, bin_index(F.col(prob_col).cast("double"), edges), F.lit(1),
                      F.lit(len(PROBABILITY_EDGES) - 1), out_col)
    return hist.withColumn("probability_bins", edges)


def profile_counts(df: DataFrame, group_cols, numeric=(), categorical=(), prob_col: str | None = None) -> DataFrame:
    """The one pass over the reference rows: ``(group..., feature, kind, num_value, str_value) → cnt``.

    Every profile (scalars, quantiles, histograms, category frequencies, the output
    histogram) is derived from this pre-aggregated table, so the raw rows are scanned
    and shuffled once, combined map-side.
    """
    g = list(group_cols)
    long_df = to_long(df, g, numeric, categorical)
    if prob_col:
        long_df = long_df.unionByName(df.select(
            *[F.col(f"`{c}`") for c in g], F.lit("__output__").alias("feature"),
            F.lit("output_probability").alias("kind"), F.col(prob_col).cast("double").alias("num_value"),
            F.lit(None).cast("string").alias("str_value")))
    return long_df.groupBy(*g, "feature", "kind", "num_value", "str_value").agg(F.count(F.lit(1)).alias("cnt"))


MAX_NUMERIC_BINS = 10  # learned edges: at most 11 deciles or 11 equal steps; output: 10 equal bins


def _histogram(rows: DataFrame, keys, bin_expr: Column, weight: Column, n_bins: Column,
               out_col: str = "reference_distribution") -> DataFrame:
    """Counts per bin in ONE aggregate: a conditional sum per possible bin (at most 10), sliced to the
    feature's own number of bins. Out-of-range rows (bin null) are not counted."""
    b = rows.select(*keys, bin_expr.alias("_bin"), weight.alias("_w"), n_bins.alias("_k"))
    agg = b.groupBy(*keys).agg(F.first("_k").alias("_k"), *[
        F.sum(F.when(F.col("_bin") == i, F.col("_w")).otherwise(0)).alias(f"_h{i}")
        for i in range(MAX_NUMERIC_BINS)])
    return agg.select(*keys, F.slice(F.array(*[F.col(f"_h{i}").cast("long") for i in range(MAX_NUMERIC_BINS)]),
                                     1, F.col("_k")).alias(out_col))


def _numeric_from_counts(counts: DataFrame, keys, ranges: int) -> DataFrame:
    """Profile of numeric features from (keys, num_value, cnt): one ordered pass gives running and total
    counts and value sums per group, one aggregate over it gives min, max, mean, population std (two-pass
    form, the mean coming from the group total) and the quantile picks; one more aggregate the histogram."""
    from vigil.operators.ordered import quantile_hits, quantile_lerp
    v, c = F.col("num_value"), F.col("cnt")
    ok = v.isNotNull() & ~F.isnan(v)
    missing = counts.groupBy(*keys).agg(F.sum(F.when(~ok, c).otherwise(0)).alias("missing_count"))
    valid = counts.where(ok).select(*keys, "num_value", "cnt", (v * c).alias("vc"))
    ranked = running_totals(valid, keys, "num_value", ["cnt", "vc"], ranges=ranges)
    n = F.col("cnt_total")
    mean = F.col("vc_total") / n
    hits = quantile_hits(PROFILE_LEVELS, n, F.col("cnt_cum") - c, F.col("cnt_cum") - 1)
    agg = ranked.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.first(n).alias("n_valid"), F.first(mean).alias("mean"),
        F.sum(c * F.pow(v - mean, 2)).alias("_ss"),
        F.map_from_entries(F.flatten(F.collect_list(F.when(F.size(hits) > 0, F.transform(
            hits, lambda h: F.struct(h["j"], v)))))).alias("_m"))
    q = quantile_lerp(PROFILE_LEVELS, F.col("n_valid"), F.col("_m"))
    prof = agg.select(*keys, "mean", F.sqrt(F.col("_ss") / F.col("n_valid")).alias("std"), "min", "max",
                      "n_valid", q.alias("quantiles"))
    prof = missing.join(prof, keys, "left").select(
        *keys, "mean", "std", "min", "max", "missing_count", F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        F.element_at("quantiles", 12).alias("median"), F.element_at("quantiles", 13).alias("q25"),
        F.element_at("quantiles", 14).alias("q75"),
        learned_edges(F.slice("quantiles", 1, 11), "min", "max").alias("bins"))
    prof = materialize_small(prof)
    edges = prof.select(*keys, "bins")
    binned = join_small(valid, edges, keys, bounded_by=missing)
    hist = _histogram(binned, keys, bin_index("num_value", "bins"), c, F.size("bins") - 1)
    return prof.join(hist, keys, "left").select(
        *prof.columns,
        F.when(F.col("n_valid") == 0, F.array(F.lit(1).cast("long"))).otherwise(F.col("reference_distribution"))
        .alias("reference_distribution"))


def _categorical_from_counts(counts: DataFrame, keys) -> DataFrame:
    cat = F.coalesce(F.col("str_value"), F.lit(MISSING))
    per = counts.groupBy(*keys, cat.alias("category")).agg(
        F.sum("cnt").alias("n"), F.sum(F.when(F.col("str_value").isNull(), F.col("cnt")).otherwise(0)).alias("nulls"))
    ordered = per.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "category", "n"))).alias("_s"),
        F.sum("nulls").alias("missing_count"), F.count(F.lit(1)).alias("n_unique"))
    return ordered.select(*keys, F.transform("_s", lambda s: s["category"]).alias("categories"),
                          F.transform("_s", lambda s: s["n"]).alias("reference_distribution"),
                          "missing_count", "n_unique")


def _output_from_counts(counts: DataFrame, keys) -> DataFrame:
    edges = F.array(*[F.lit(e) for e in PROBABILITY_EDGES])
    hist = _histogram(counts, keys, bin_index("num_value", edges), F.col("cnt"), F.lit(len(PROBABILITY_EDGES) - 1))
    return hist.withColumn("bins", edges)


def reference_stats(df: DataFrame, group_cols, numeric=(), categorical=(), prob_col: str | None = "probability",
                    ranges: int = DEFAULT_RANGES) -> DataFrame:
    """Long reference table: one row per (group..., feature) with ``kind``, ``bins``, ``categories``,
    ``reference_distribution`` and the profile scalars; the model output is feature ``__output__``.

    One scan of ``df``: everything is derived from ``profile_counts``.
    """
    g = list(group_cols)
    keys = [*g, "feature"]
    # distinct (group, feature, value) counts: read by the numeric, categorical and output branches
    counts = persist_shared(profile_counts(df, g, numeric, categorical, prob_col))
    none_d = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max", "median", "q25", "q75")]
    parts = []
    if numeric:
        num = _numeric_from_counts(counts.where(F.col("kind") == "numeric"), keys, ranges)
        parts.append(num.select(*keys, F.lit("numeric").alias("kind"), "bins",
                                F.lit(None).cast("array<string>").alias("categories"), "reference_distribution",
                                "mean", "std", "min", "max", "median", "q25", "q75", "missing_count",
                                F.lit(None).cast("long").alias("n_unique")))
    if categorical:
        cat = _categorical_from_counts(counts.where(F.col("kind") == "categorical"), keys)
        parts.append(cat.select(*keys, F.lit("categorical").alias("kind"),
                                F.lit(None).cast("array<double>").alias("bins"), "categories",
                                "reference_distribution", *none_d, "missing_count", "n_unique"))
    if prob_col:
        out = _output_from_counts(counts.where(F.col("feature") == "__output__"), keys)
        parts.append(out.select(*keys, F.lit("output_probability").alias("kind"), "bins",
                                F.lit(None).cast("array<string>").alias("categories"), "reference_distribution",
                                *none_d, F.lit(None).cast("long").alias("missing_count"),
                                F.lit(None).cast("long").alias("n_unique")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # the reference table is small (groups x features) and read by every drift plan: write it once
    out = cut_lineage(out)
    counts.unpersist()
    return out


def reference_document(ref: DataFrame, rows: DataFrame, group_cols) -> DataFrame:
    """Whole reference document per group: row count and the features (sorted by name) as a nested list."""
    g = list(group_cols)
    n = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"))
    item = F.struct("feature", "kind", "bins", "categories", "reference_distribution", "mean", "std", "min", "max",
                    "median", "q25", "q75", "missing_count", "n_unique")
    doc = ref.groupBy(*g).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(
        a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)).alias("features"))
    return doc.join(n, g)


def class_distribution(df: DataFrame, group_cols, pred_col: str = "predicted_class") -> DataFrame:
    """Predicted-class counts per group."""
    return df.groupBy(*group_cols, F.col(pred_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def target_distribution(df: DataFrame, group_cols, target_col: str = "y") -> DataFrame:
    """Relative frequency of each target value per group."""
    counts = df.groupBy(*group_cols, F.col(target_col).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return counts.select(*group_cols, "target", (F.col("n") / F.sum("n").over(w)).alias("share"))
