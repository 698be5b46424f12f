"""Scoring with opaque models: any object that predicts, shipped once and applied to Arrow batches.

A model is pickled, broadcast, and unpickled once in a worker. What it offers decides how a row is scored: class
probabilities (the second column, or the only one), else a decision score through the sigmoid, else its plain prediction.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MODELS: dict[str, object] = {}


def positive_probability(model, rows: pd.DataFrame) -> np.ndarray:
    """The positive class's probability of every row, by the best that the model offers."""
    if hasattr(model, "predict_proba"):
        p = np.asarray(model.predict_proba(rows), dtype=float)
        return p[:, 1] if p.ndim == 2 and p.shape[1] > 1 else p.reshape(len(rows), -1)[:, 0]
    if hasattr(model, "decision_function"):
        z = np.asarray(model.decision_function(rows), dtype=float).reshape(len(rows))
        e = np.exp(-np.abs(z))  # neither side overflows
        return np.where(z >= 0, 1 / (1 + e), e / (1 + e))
    return np.asarray(model.predict(rows), dtype=float).reshape(len(rows))


def score_opaque(df: DataFrame, model, features, out: str = "probability") -> DataFrame:
    """Every row of ``df`` with ``out``. ``model`` (an object, or its pickled bytes) gets a frame of the ``features``
    columns, in their order, for each batch; rows are independent, nothing is shuffled, and other columns pass through."""
    artifact = model if isinstance(model, bytes) else pickle.dumps(model)
    key, shared, names = hashlib.sha256(artifact).hexdigest(), df.sparkSession.sparkContext.broadcast(artifact), list(features)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(shared.value)
        for rows in batches:
            rows.columns = names
            yield pd.Series(positive_probability(_MODELS[key], rows))

    return df.withColumn(out, score(F.struct(*[F.col(f"`{c}`") for c in names])))


class Linear:
    """A linear score over named columns; models below offer it as a probability, a decision score or a prediction."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def _score(self, rows: pd.DataFrame) -> np.ndarray:
        return sum((rows[c].to_numpy(dtype=float) * w for c, w in self.weights.items()), np.full(len(rows), self.intercept))


class ProbabilityModel(Linear):
    def predict_proba(self, rows):
        p = 1 / (1 + np.exp(-self._score(rows)))
        return np.column_stack([1 - p, p])


class MarginModel(Linear):
    def decision_function(self, rows):
        return self._score(rows)


class PlainModel(Linear):
    def predict(self, rows):
        return (self._score(rows) >= 0).astype(int)
