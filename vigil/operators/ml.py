"""Classifier evaluation and training-side statistics as grouped DataFrame operators.

Confusion counts are one partial/final aggregate; AUC and the recall
threshold need scores in order and use ``running_totals`` (exact, range
split for large inputs) over (group, distinct score) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.joins import attach, join_small
from vigil.operators.ordered import running_totals

# Fixed values of the training setup.
MIN_RECALL = 0.74
SPLIT_FRACTIONS = (6, 2, 2)  # train / validation / test in tenths; test takes the odd row of the remainder
SPLIT_BITS = 16  # leading bits of the hash that the split counts rows by
REPLAY_SAMPLE_SIZE = 20
DEFAULT_THRESHOLD = 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _gb(df: DataFrame, g):
    return df.groupBy(*g) if g else df.groupBy()


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0.0 when b is 0 (zero-division rule of the metrics)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, group_cols, label_col: str = "y", score_col: str = "score",
              threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """tp, fp, tn, fn per group; prediction = score >= threshold (threshold may be a column)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = _c(score_col) >= t
    y = _c(label_col) == 1
    return _gb(df, group_cols).agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))


def binary_metrics(df: DataFrame, group_cols=(), label_col: str = "y", score_col: str = "score",
                   threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """accuracy, precision, recall, f1 at a threshold; zero division gives 0."""
    g = list(group_cols)
    c = confusion(df, g, label_col, score_col, threshold)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*g, _div0(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                    _div0(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "tn", "fn")


def score_counts(df: DataFrame, group_cols, label_col: str = "y", score_col: str = "score") -> DataFrame:
    """(group, score) → positives, negatives; the shuffle carries distinct scores only."""
    y = _c(label_col) == 1
    return _gb(df, [*group_cols, _c(score_col).alias("score")]).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def roc_auc(df: DataFrame, group_cols=(), label_col: str = "y", score_col: str = "score") -> DataFrame:
    """Exact ROC AUC per group with tied scores counted half (trapezoid rule); null with one class."""
    g = list(group_cols)
    sc = score_counts(df, g, label_col, score_col)
    rt = running_totals(sc, g, "score", ["pos", "neg"], descending=True)
    # negatives at score s are beaten by positives above s and tie with positives at s
    part = F.col("neg") * (F.col("pos_cum") - F.col("pos") + F.col("pos") * 0.5)
    agg = _gb(rt, g).agg(F.sum(part).alias("_num"), F.first("pos_total").alias("P"), F.first("neg_total").alias("N"))
    return agg.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                 F.col("_num") / (F.col("P") * F.col("N"))).alias("auc"))


def threshold_for_recall(df: DataFrame, group_cols=(), label_col: str = "y", score_col: str = "score",
                         min_recall: float = MIN_RECALL) -> DataFrame:
    """Highest threshold in {0, 0.5, 1} ∪ scores whose recall >= min_recall; 0.5 with no positives.

    Recall falls as the threshold rises, so the answer is the k-th largest positive
    score (k minimal with k/P >= r) or a fixed candidate above it. With no valid
    candidate (only if r > 1) the smallest candidate is returned.
    """
    g = list(group_cols)
    y = _c(label_col) == 1
    s = _c(score_col)
    pos = df.where(y).groupBy(*g, s.alias("score")).agg(F.count(F.lit(1)).alias("pos"))
    rt = running_totals(pos, g, "score", ["pos"], descending=True)
    r = F.lit(float(min_recall))
    best_score = _gb(rt, g).agg(
        F.max(F.when(F.col("pos_cum") / F.col("pos_total") >= r, F.col("score"))).alias("_s"))
    fixed = _gb(df, g).agg(
        F.count_if(y).alias("_P"),
        *[F.count_if(y & (s >= c)).alias(f"_p{i}") for i, c in enumerate((0.0, 0.5, 1.0))],
        F.min(s).alias("_min"))
    cands = [F.when(F.col(f"_p{i}") / F.col("_P") >= r, F.lit(c)) for i, c in enumerate((0.0, 0.5, 1.0))]
    joined = fixed.join(best_score, g, "left") if g else attach(fixed, best_score)
    best = F.greatest(F.col("_s"), *cands)
    return joined.select(*g, F.when(F.col("_P") == 0, F.lit(DEFAULT_THRESHOLD))
                         .when(best.isNotNull(), best)
                         .otherwise(F.least(F.lit(0.0), F.col("_min"))).alias("threshold"))


def evaluate(df: DataFrame, group_cols=(), label_col: str = "y", score_col: str = "score",
             threshold=DEFAULT_THRESHOLD) -> DataFrame:
    g = list(group_cols)
    m = binary_metrics(df, g, label_col, score_col, threshold).drop("tp", "fp", "tn", "fn")
    a = roc_auc(df, g, label_col, score_col)
    return m.join(a, g, "left") if g else attach(m, a)


def metrics_by_split(df: DataFrame, split_col: str = "split", label_col: str = "y", score_col: str = "score",
                     threshold=DEFAULT_THRESHOLD, splits=("train", "val", "test")) -> DataFrame:
    """One row: ``<split>_<metric>`` for every split, plus the test metrics unprefixed."""
    ev = evaluate(df, [split_col], label_col, score_col, threshold)
    metrics = ["accuracy", "auc", "f1", "precision", "recall"]
    wide = ev.groupBy().pivot(split_col, list(splits)).agg(*[F.first(m).alias(m) for m in metrics])
    return wide.select(*[F.col(f"{s}_{m}") for s in splits for m in metrics],
                       *[F.col(f"test_{m}").alias(m) for m in metrics])


def hash_order(*cols, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: first 60 bits of md5(key ':' seed) as a long."""
    key = F.concat_ws(":", *[_c(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, id_cols, label_col: str = "y", seed: int = 42,
                     fractions=SPLIT_FRACTIONS) -> DataFrame:
    """60/20/20 split that keeps each class's share; rank within class by a seeded hash.

    Per class of n rows: train = floor(6n/10), test = ceil(rest/2), validation = the
    remainder. Counts by the hash's first bits say in which two buckets a class is cut;
    only their rows are ranked, the others have their split by their bucket alone, so
    the table itself is neither sorted nor shuffled.
    """
    tr, va, te = fractions
    ids = list(id_cols)
    h = df.withColumn("_h", hash_order(*ids, seed=seed)).withColumn("_b", F.shiftright("_h", 60 - SPLIT_BITS))
    counts = h.groupBy(F.col(label_col).alias("_class"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy("_class")
    upto = over.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_n")
    n_train = F.floor((n * tr) / (tr + va + te))
    n_test = F.floor((n - n_train + 1) / 2)
    counts = (counts.select("_class", "_b", "_c", F.sum("_c").over(upto).alias("_cum"), F.sum("_c").over(over).alias("_n"))
              .withColumns({"_to_train": n_train, "_to_val": n - n_test}))
    # for each cut the first bucket that goes beyond it, and the rows before that bucket; none: past the last bucket
    cuts = [F.min(F.when(F.col("_cum") > F.col(to), x)).alias(f"{to}_{what}") for to in ("_to_train", "_to_val")
            for x, what in ((F.col("_b"), "at"), (F.col("_cum") - F.col("_c"), "before"))]
    last = F.lit(1 << SPLIT_BITS)
    classes = counts.groupBy("_class").agg(F.first("_to_train").alias("_to_train"), F.first("_to_val").alias("_to_val"), *cuts)
    classes = classes.withColumns({c: F.coalesce(c, last) for c in ("_to_train_at", "_to_val_at")})
    rows = join_small(h, classes, F.col(label_col).eqNullSafe(F.col("_class")))
    cut = F.col("_b").isin(F.col("_to_train_at"), F.col("_to_val_at"))
    sure = rows.where(~cut).withColumn("split", F.when(F.col("_b") < F.col("_to_train_at"), "train")
                                       .when(F.col("_b") < F.col("_to_val_at"), "val").otherwise("test"))
    before = F.when(F.col("_b") == F.col("_to_train_at"), F.col("_to_train_before")).otherwise(F.col("_to_val_before"))
    r = before + F.row_number().over(Window.partitionBy("_class", "_b").orderBy("_h", *ids))
    ranked = rows.where(cut).withColumn("_r", r)
    ranked = ranked.withColumn("split", F.when(F.col("_r") <= F.col("_to_train"), "train")
                               .when(F.col("_r") <= F.col("_to_val"), "val").otherwise("test"))
    names = [*[F.col(f"`{c}`") for c in df.columns], "split"]
    return sure.select(*names).unionByName(ranked.select(*names))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "y") -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label_col, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


def replay_sample(df: DataFrame, id_cols, label_col: str = "y", n: int = REPLAY_SAMPLE_SIZE,
                  seed: int = 42) -> DataFrame:
    """Class-balanced sample of ``n`` rows: half positives (at least one), the rest negatives, topped up
    from the other class when one runs short; ordered by a seeded hash (``sample_order``)."""
    ids = list(id_cols)
    y = F.col(label_col) == 1
    h = df.withColumn("_h", hash_order(*ids, seed=seed))
    # per-class top-n by hash: WindowGroupLimit keeps n rows per partition before the shuffle
    w = Window.partitionBy(y.alias("_cls")).orderBy("_h", *ids)
    top = h.withColumn("_cls", y).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    counts = df.agg(F.count_if(y).alias("_P"), F.count_if(~y).alias("_N"))
    qp = F.least(F.col("_P"), F.lit(max(1, n // 2)))
    qn = F.least(F.col("_N"), F.lit(n) - qp)
    take_pos = F.least(F.col("_P"), F.lit(n) - qn)
    picked = attach(top, counts).where(
        F.when(F.col("_cls"), F.col("_rk") <= take_pos).otherwise(F.col("_rk") <= qn))
    ow = Window.orderBy(hash_order(*ids, seed=seed + 1), *ids)
    return picked.withColumn("sample_order", F.row_number().over(ow) - 1).drop("_h", "_cls", "_rk", "_P", "_N")


def impute_stats(df: DataFrame, numeric=(), categorical=()) -> DataFrame:
    """Median of each numeric column and most frequent value (lowest on ties) of each categorical column.

    Rows: feature, kind, value (as string for categorical, double for numeric).
    """
    from vigil.operators.ordered import quantiles_from_counts
    from vigil.operators.stats import to_long, value_counts
    parts = []
    if numeric:
        long_df = to_long(df, [], numeric, [])
        counts = value_counts(long_df, ["feature"], "num_value")
        q = quantiles_from_counts(counts, ["feature"], "num_value", [0.5])
        parts.append(q.select("feature", F.lit("numeric").alias("kind"), F.col("quantiles")[0].alias("median"),
                              F.lit(None).cast("string").alias("mode")))
    if categorical:
        long_df = to_long(df, [], [], categorical).where(F.col("str_value").isNotNull())
        counts = long_df.groupBy("feature", "str_value").agg(F.count(F.lit(1)).alias("n"))
        mode = counts.groupBy("feature").agg(
            F.min_by("str_value", F.struct((-F.col("n")).alias("a"), F.col("str_value").alias("b"))).alias("mode"))
        parts.append(mode.select("feature", F.lit("categorical").alias("kind"),
                                 F.lit(None).cast("double").alias("median"), "mode"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scaler_stats(df: DataFrame, numeric) -> DataFrame:
    """Mean and population std per numeric column (zero std → scale 1)."""
    from vigil.operators.stats import to_long
    long_df = to_long(df, [], numeric, [])
    v = F.col("num_value")
    return long_df.groupBy("feature").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).withColumn(
        "scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))
