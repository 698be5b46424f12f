"""Training-side queries over the lineitem stand-in: metrics, AUC, threshold, split, weights, stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import ml as M
from vigil.operators import stats as S
from vigil.operators.joins import attach
from vigil.plans.registry import query, r6
from vigil.sources.standins import TRAIN_CATEGORICAL, TRAIN_KEY, TRAIN_NUMERIC, training_frame

T_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
  l_returnflag, l_shipdate, l_quantity * (1 - l_discount) / 50 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""

SPLIT_SQL = T_SQL + """,
h AS (SELECT *, ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' ||
                 CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':42'), 1, 15))::BIGINT AS h FROM t),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r,
              count(*) OVER (PARTITION BY y) AS n FROM h),
sp AS (SELECT *, CASE WHEN r <= floor(n * 6 / 10) THEN 'train'
                      WHEN r <= n - floor((n - floor(n * 6 / 10) + 1) / 2) THEN 'val' ELSE 'test' END AS split FROM rk)"""


def _sql_threshold(src: str, g: str | None, r: float = 0.74) -> str:
    """Threshold-for-recall in SQL over ``src`` grouped by ``g`` (None = one group)."""
    gsel = f"{g}, " if g else ""
    part = f"PARTITION BY {g}" if g else ""
    gby = "GROUP BY ALL" if g else ""
    using = f"USING ({g})" if g else "ON TRUE"
    return f"""(SELECT {gsel} CASE WHEN f.P = 0 THEN 0.5
      WHEN greatest(b.s, CASE WHEN f.p0 / f.P >= {r} THEN 0.0 END, CASE WHEN f.p1 / f.P >= {r} THEN 0.5 END,
                    CASE WHEN f.p2 / f.P >= {r} THEN 1.0 END) IS NOT NULL
        THEN greatest(b.s, CASE WHEN f.p0 / f.P >= {r} THEN 0.0 END, CASE WHEN f.p1 / f.P >= {r} THEN 0.5 END,
                      CASE WHEN f.p2 / f.P >= {r} THEN 1.0 END)
      ELSE least(0.0, f.mn) END AS threshold
  FROM (SELECT {gsel} count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 1 AND score >= 0.0) AS p0,
               count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS p1, count(*) FILTER (WHERE y = 1 AND score >= 1.0) AS p2,
               min(score) AS mn FROM {src} {gby}) f
  LEFT JOIN (SELECT {gsel} max(score) FILTER (WHERE cum / P >= {r}) AS s FROM (
      SELECT *, sum(n) OVER ({part} ORDER BY score DESC) AS cum, sum(n) OVER ({part}) AS P FROM (
        SELECT {gsel} score, count(*) AS n FROM {src} WHERE y = 1 GROUP BY ALL)) {gby}) b {using})"""


def _sql_auc(src: str, g: str) -> str:
    return f"""(SELECT {g}, sum(neg * (pos_cum - pos + pos * 0.5)) / (any_value(P) * any_value(N)) AS auc FROM (
  SELECT *, sum(pos) OVER (PARTITION BY {g} ORDER BY score DESC) AS pos_cum, sum(pos) OVER (PARTITION BY {g}) AS P,
         sum(neg) OVER (PARTITION BY {g}) AS N FROM (
    SELECT {g}, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
    FROM {src} GROUP BY ALL)) GROUP BY ALL)"""


def _sql_metrics(src: str, g: str, thr: str) -> str:
    return f"""(SELECT {g}, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, tp, fp, tn, fn FROM (
  SELECT {g}, count(*) FILTER (WHERE score >= {thr} AND y = 1) AS tp, count(*) FILTER (WHERE score >= {thr} AND y = 0) AS fp,
         count(*) FILTER (WHERE score < {thr} AND y = 0) AS tn, count(*) FILTER (WHERE score < {thr} AND y = 1) AS fn
  FROM {src} GROUP BY ALL))"""


@query("binary_metrics", sql=f"WITH {T_SQL} SELECT l_linestatus, round(accuracy, 6) AS accuracy, "
       "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tp, fp, tn, fn FROM "
       + _sql_metrics("t", "l_linestatus", "0.5"))
def binary_metrics(spark, sf_dir):
    m = M.binary_metrics(training_frame(spark, sf_dir), ["l_linestatus"], threshold=0.5)
    return m.select("l_linestatus", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    "tp", "fp", "tn", "fn")


@query("roc_auc", sql=f"WITH {T_SQL}, s AS (SELECT *, l_linenumber <= 3 AS early_line FROM t) "
       f"SELECT early_line, round(auc, 6) AS auc FROM {_sql_auc('s', 'early_line')}")
def roc_auc(spark, sf_dir):
    """Exact AUC (ties count half) per line-number band."""
    t = training_frame(spark, sf_dir).withColumn("early_line", F.col("l_linenumber") <= 3)
    return M.roc_auc(t, ["early_line"]).select("early_line", r6("auc").alias("auc"))


@query("threshold_for_recall", sql=f"WITH {T_SQL}, s AS (SELECT *, l_linenumber <= 3 AS early_line FROM t) "
       f"SELECT early_line, threshold FROM {_sql_threshold('s', 'early_line')}")
def threshold_for_recall(spark, sf_dir):
    t = training_frame(spark, sf_dir).withColumn("early_line", F.col("l_linenumber") <= 3)
    return M.threshold_for_recall(t, ["early_line"], min_recall=0.74)


@query("stratified_split", sql=f"WITH {SPLIT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, split "
       "FROM sp")
def stratified_split(spark, sf_dir):
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    return t.select(*TRAIN_KEY, "y", "split")


@query("split_counts", sql=f"WITH {SPLIT_SQL} SELECT split, y, count(*) AS n FROM sp GROUP BY ALL")
def split_counts(spark, sf_dir):
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    return t.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


_MET = ["accuracy", "auc", "f1", "precision", "recall"]


@query("metrics_by_split", sql=f"""WITH {SPLIT_SQL},
thr AS {_sql_threshold("(SELECT * FROM sp WHERE split = 'val')", None)},
spt AS (SELECT sp.*, thr.threshold FROM sp, thr),
m AS (SELECT * FROM {_sql_metrics('spt', 'split', 'threshold')} JOIN {_sql_auc('spt', 'split')} USING (split))
SELECT """ + ", ".join(f"round((SELECT {m} FROM m WHERE split = '{s}'), 6) AS {s}_{m}"
                       for s in ("train", "val", "test") for m in _MET)
       + ", " + ", ".join(f"round((SELECT {m} FROM m WHERE split = 'test'), 6) AS {m}" for m in _MET)
       + ", (SELECT threshold FROM thr) AS selected_threshold")
def metrics_by_split(spark, sf_dir):
    """Threshold chosen for recall 0.74 on the validation split; metrics per split, test unprefixed."""
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42).persist()  # read three times
    thr = M.threshold_for_recall(t.where(F.col("split") == "val"), [], min_recall=0.74)
    scored = attach(t, thr)
    wide = M.metrics_by_split(scored, "split", threshold=F.col("threshold"))
    return attach(wide.select(*[r6(c).alias(c) for c in wide.columns]),
                  thr.select(F.col("threshold").alias("selected_threshold")))


@query("class_weights", sql=f"WITH {T_SQL} SELECT y, count(*) AS n_c, round(sum(count(*)) OVER () / "
       "(count(*) OVER () * count(*)), 6) AS weight FROM t GROUP BY y")
def class_weights(spark, sf_dir):
    w = M.class_weights(training_frame(spark, sf_dir), "y")
    return w.select("y", "n_c", r6("weight").alias("weight"))


@query("impute_stats", sql=f"""WITH {T_SQL}
SELECT 'l_quantity' AS feature, 'numeric' AS kind, round(quantile_cont(l_quantity, 0.5), 6) AS median,
       NULL::VARCHAR AS mode FROM t
UNION ALL SELECT 'l_extendedprice', 'numeric', round(quantile_cont(l_extendedprice, 0.5), 6), NULL FROM t
UNION ALL SELECT 'l_discount', 'numeric', round(quantile_cont(l_discount, 0.5), 6), NULL FROM t
UNION ALL SELECT 'l_tax', 'numeric', round(quantile_cont(l_tax, 0.5), 6), NULL FROM t
UNION ALL SELECT 'l_linestatus', 'categorical', NULL,
  (SELECT l_linestatus FROM t WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def impute_stats(spark, sf_dir):
    s = M.impute_stats(training_frame(spark, sf_dir), TRAIN_NUMERIC, TRAIN_CATEGORICAL)
    return s.select("feature", "kind", r6("median").alias("median"), "mode")


@query("scaler_stats", sql=f"""WITH {T_SQL},
l AS (SELECT 'l_quantity' AS feature, l_quantity AS v FROM t UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM t
      UNION ALL SELECT 'l_discount', l_discount FROM t UNION ALL SELECT 'l_tax', l_tax FROM t)
SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM l GROUP BY ALL""")
def scaler_stats(spark, sf_dir):
    s = M.scaler_stats(training_frame(spark, sf_dir), TRAIN_NUMERIC)
    return s.select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


@query("target_distribution", sql=f"WITH {SPLIT_SQL} SELECT y AS target, round(count(*) / sum(count(*)) OVER (), 6) "
       "AS share FROM sp WHERE split = 'train' GROUP BY y")
def target_distribution(spark, sf_dir):
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    d = S.target_distribution(t.where(F.col("split") == "train"), [], "y")
    return d.select("target", r6("share").alias("share"))


@query("replay_sample", sql=f"""WITH {SPLIT_SQL},
te AS (SELECT * FROM sp WHERE split = 'test'),
c AS (SELECT count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM te),
q AS (SELECT least(P, greatest(1, 10)) AS qp, least(N, 20 - least(P, greatest(1, 10))) AS qn, P FROM c),
r AS (SELECT te.*, row_number() OVER (PARTITION BY y = 1 ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey)
      AS rk FROM te)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y FROM r, q
WHERE (y = 1 AND rk <= least(q.P, 20 - q.qn)) OR (y <> 1 AND rk <= q.qn)""")
def replay_sample(spark, sf_dir):
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    s = M.replay_sample(t.where(F.col("split") == "test"), TRAIN_KEY, "y", n=20, seed=42)
    return s.select(*TRAIN_KEY, "y")


# ---- training and scoring (Spark ML; rows-only checks) -------------------------------------------------------
def _trained(spark, sf_dir):
    from vigil.operators import train as TRN
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    t = t.select(*TRAIN_KEY, *TRAIN_NUMERIC, *TRAIN_CATEGORICAL, "y", "split").persist()  # read many times
    model = TRN.fit(t.where(F.col("split") == "train"), TRAIN_NUMERIC, TRAIN_CATEGORICAL, "y")
    return t, model


@query("train_lr")
def train_lr(spark, sf_dir):
    """Coefficients of the class-weighted logistic regression fitted on the training split."""
    from vigil.operators import train as TRN
    _, model = _trained(spark, sf_dir)
    return spark.createDataFrame(TRN.coefficients(model), "term string, coefficient double")


@query("score")
def score(spark, sf_dir):
    """Positive-class probability of every lineitem row from the fitted model."""
    from vigil.operators import train as TRN
    t, model = _trained(spark, sf_dir)
    return TRN.score(t, model).select(*TRAIN_KEY, "split", "y", "probability")


@query("predict_batch")
def predict_batch(spark, sf_dir):
    """Every training-table row as a raw request, validated and scored into prediction-log rows at the selected
    threshold."""
    from vigil.operators import train as TRN
    t, model = _trained(spark, sf_dir)
    val = TRN.score(t.where(F.col("split") == "val"), model)
    thr = M.threshold_for_recall(val, [], score_col="probability", min_recall=0.74).first()["threshold"]
    raw = [x for c in (*TRAIN_NUMERIC, *TRAIN_CATEGORICAL) for x in (F.lit(c), F.col(c).cast("string"))]
    req = t.select(F.concat_ws("-", *TRAIN_KEY).alias("request_id"), F.create_map(*raw).alias("raw"))
    return TRN.predict_batch(req, model, thr, "v1", "request_id")


@query("train_summary")
def train_summary(spark, sf_dir):
    """End-to-end training run: split → fit → threshold on validation → metrics per split (one row)."""
    from vigil.operators import train as TRN
    t, model = _trained(spark, sf_dir)
    scored = TRN.score(t, model)
    thr = M.threshold_for_recall(scored.where(F.col("split") == "val"), [], score_col="probability",
                                 min_recall=0.74)
    wide = M.metrics_by_split(attach(scored, thr), "split", score_col="probability",
                              threshold=F.col("threshold"))
    counts = t.groupBy().pivot("split", ["train", "val", "test"]).count()
    return attach(attach(wide, thr.select(F.col("threshold").alias("selected_threshold"))),
                  counts.select(*[F.col(s).alias(f"{s}_rows") for s in ("train", "val", "test")]))


@query("score_opaque", sql="""WITH z AS (SELECT l_orderkey, l_linenumber, 0.08 * l_quantity - 12.0 * l_discount - 1.5 AS z
  FROM lineitem) SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-z)), 6) AS by_probability,
  round(1 / (1 + exp(-z)), 6) AS by_margin, CAST(z >= 0 AS INTEGER)::DOUBLE AS by_prediction FROM z""")
def score_opaque(spark, sf_dir):
    """Three models of one linear score, as a probability, a decision score and a plain prediction, shipped and applied to
    Arrow batches."""
    from vigil.operators import scoring as SC
    from vigil.sources.tables import read_table
    weights, names = {"l_quantity": 0.08, "l_discount": -12.0}, ["l_quantity", "l_discount"]
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names)
    for kind, out in ((SC.ProbabilityModel, "by_probability"), (SC.MarginModel, "by_margin"), (SC.PlainModel, "by_prediction")):
        rows = SC.score_opaque(rows, kind(weights, -1.5), names, out)
    return rows.select("l_orderkey", "l_linenumber", r6("by_probability").alias("by_probability"),
                       r6("by_margin").alias("by_margin"), "by_prediction")
