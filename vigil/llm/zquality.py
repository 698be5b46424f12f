"""Quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed in blocks with either: the
dictionary that knows its kind saves more. The difference of the two compressed sizes over the text's size, and what
is left of the text at all (junk repeats itself), go through a logistic calibration fitted on labelled rows that the
dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import arrow_map

#: Labelled rows for the fit, of each label: the bound of what passes through the driver (half build the dictionaries,
#: half the calibration), and blocks of a text that go into a dictionary's samples.
SAMPLE_ROWS, SAMPLE_BLOCKS = 4000, 16
BLOCK, DICTIONARY, LEVEL = 2048, 1 << 16, 3
GOOD_FROM = 0.7
#: Bytes of a frame that say nothing about the text.
FRAME = 8


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8")
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary from texts; too few of them serve as raw content."""
    samples = []
    for t in texts:
        b = blocks(t)
        samples += [b[i] for i in sorted({i * len(b) // SAMPLE_BLOCKS for i in range(SAMPLE_BLOCKS)})] if b else []
    try:
        return zstandard.train_dictionary(DICTIONARY, [s for s in samples if len(s) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


@lru_cache(maxsize=4)
def _compressor(content: bytes):
    """A compressor with a dictionary, once in a worker; an empty one has none."""
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(**plain)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, **plain)


def features(text: str | None, good: bytes, bad: bytes) -> list[float]:
    """Of a whole text: size difference and good size over its bytes, its length, and the size by the length."""
    parts = blocks(text)
    n = sum(map(len, parts))
    sizes = [max(1, sum(len(c.compress(p)) - FRAME for p in parts)) for c in (_compressor(good), _compressor(bad))]
    left, log_n = sizes[0] / max(1, n), np.log(n + 8) / 8
    return [(sizes[1] - sizes[0]) / max(1, n), left, log_n, left * log_n]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features and, last, of 1

    def score(self, text: str | None) -> float:
        x = np.append(features(text, self.good, self.bad), 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30))))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps on standardised features; weights for the features as they are, then of 1."""
    if not len(y):
        return (0.0,) * (x.shape[1] + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale), float(w[-1] - (w[:-1] * mean / scale).sum()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows: ``labels`` (doc_id, label 1 or 0). Of each label the ``sample_rows`` ids with the
    least hash are used, so reruns agree; rows with a null id or label, or with both labels, are not. Without rows of
    a label its dictionary is empty and scores say nothing."""
    clean = (labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other"))
    chosen = None
    for v in (0, 1):
        part = clean.filter(F.col("label") == v).select("doc_id", "label").orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 x sample_rows ids
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    seen = rows.filter(half).orderBy("doc_id").collect()
    good, bad = (dictionary([r["text"] for r in seen if r["label"] == v]) for v in (1, 0))
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast((good, bad))

    def run(b):
        return {"x": [features(t, *given.value) for t in b.column("text").to_pylist()]}

    rest = arrow_map(rows.filter(~half), run, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["doc_id", "label"])
    rest = rest.orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rest], dtype=float).reshape(-1, 4)
    return Model(good, bad, calibrate(x, np.array([r["label"] for r in rest], dtype=float)))


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: good likelier) of every whole text; null counts as empty, which scores like any
    text without bytes. Rows are independent; a column named ``out`` is replaced."""
    given = df.sparkSession.sparkContext.broadcast(model)

    def run(b):
        return {out: [given.value.score(t) for t in b.column(text_col).to_pylist()]}

    return arrow_map(df, run, [T.StructField(out, T.DoubleType(), False)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    got = score(docs.select("doc_id", "text"), fit(docs, known))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
