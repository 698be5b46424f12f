"""Baseline classifier: impute, scale, one-hot, class-weighted logistic regression; scoring and prediction.

Statistics are computed with the project's own aggregates (median, population
std) because Spark ML's ``Imputer`` and ``StandardScaler`` use other rules; the
model is Spark ML ``LogisticRegression`` with balanced weights and
``regParam = 1/n`` (the same objective as an L2 penalty with C = 1 on summed loss).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ml import class_weights, impute_stats, scaler_stats
from vigil.operators.validate import validate_features

MAX_ITER = 100


@dataclass
class Trained:
    model: PipelineModel
    numeric: list
    categorical: list
    medians: dict
    modes: dict
    means: dict
    scales: dict


def _prepare(df: DataFrame, t: "Trained | dict") -> DataFrame:
    """Imputation and scaling as one projection (fitted constants are scalars per column)."""
    cols = {}
    for c in t.numeric:
        v = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(t.medians[c]))
        cols[f"_n_{c}"] = (v - F.lit(t.means[c])) / F.lit(t.scales[c])
    for c in t.categorical:
        cols[f"_c_{c}"] = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(t.modes[c]))
    return df.withColumns(cols)


def fit(train: DataFrame, numeric, categorical, label: str = "y", max_iter: int = MAX_ITER) -> Trained:
    """Fit the preprocessing constants and the weighted logistic regression on the training split."""
    stats = impute_stats(train, numeric, categorical).collect()   # one row per feature
    medians = {r.feature: r.median for r in stats if r.kind == "numeric"}
    modes = {r.feature: r.mode for r in stats if r.kind == "categorical"}
    sc = {r.feature: r for r in scaler_stats(train, numeric).collect()}
    t = Trained(None, list(numeric), list(categorical), medians, modes,
                {c: sc[c].mean for c in numeric}, {c: sc[c].scale for c in numeric})
    n = train.count()
    weights = class_weights(train, label).select(F.col(label).alias("_y"), F.col("weight").alias("_w"))
    data = _prepare(train, t).join(F.broadcast(weights), F.col(label) == F.col("_y")).drop("_y")
    stages = []
    for c in t.categorical:
        stages += [StringIndexer(inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", dropLast=True, handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[f"_n_{c}" for c in t.numeric] + [f"_o_{c}" for c in t.categorical],
                                  outputCol="_features"))
    stages.append(LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w", regParam=1.0 / n,
                                     elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                                     probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"))
    t.model = Pipeline(stages=stages).fit(data.withColumn(label, F.col(label).cast("double")))
    return t


def score(df: DataFrame, t: Trained, out: str = "probability") -> DataFrame:
    """Positive-class probability for every row (narrow: no shuffle)."""
    scored = t.model.transform(_prepare(df, t))
    keep = [c for c in df.columns]
    return scored.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("_prob")[1].alias(out))


def coefficients(t: Trained) -> list[tuple[str, float]]:
    lr = t.model.stages[-1]
    names = [f"num:{c}" for c in t.numeric]
    for i, c in enumerate(t.categorical):
        labels = t.model.stages[2 * i].labels
        names += [f"cat:{c}={v}" for v in labels]
    coefs = lr.coefficients.toArray().tolist()
    return [("intercept", float(lr.intercept))] + list(zip(names, coefs))


def predict_batch(df: DataFrame, t: Trained, threshold: float, model_version: str, id_col: str, map_col: str = "raw",
                  **checks) -> DataFrame:
    """Prediction rows of raw requests (``map_col``: map<string,string>), all of them: request_id, features (JSON),
    probability, predicted_class, threshold, model_version, error.

    Requests pass ``validate_features`` (``checks`` go to it) before they are scored. One that fails has its first
    error and neither features nor a probability: callers route it to quarantine on ``error IS NOT NULL``.
    """
    checked = validate_features(df.select(F.col(id_col).alias("request_id"), F.col(map_col).alias("_raw")), "_raw",
                                [*t.numeric, *t.categorical], float_cols=t.numeric, categorical=t.categorical, **checks)
    rows = checked.select("request_id", "features.*", F.when(F.col("valid"), F.to_json("features")).alias("_json"),
                          F.col("first_error").alias("error"))
    s = score(rows, t).withColumn("probability", F.when(F.col("error").isNull(), F.col("probability")))
    return s.select("request_id", F.col("_json").alias("features"), "probability",
                    (F.col("probability") >= threshold).cast("int").alias("predicted_class"),
                    F.lit(float(threshold)).alias("threshold"), F.lit(model_version).alias("model_version"), "error")
