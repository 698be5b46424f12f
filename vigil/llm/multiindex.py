"""Hard negatives from an inverted multi-index.

Vectors of whole numbers are cut into two halves, and each half has a codebook of ``k`` centres; a row belongs to the
cell of its two nearest centres. For a query, a centre's bound is its inner product with the query's half plus the half's
length times the largest distance of a row from that centre; no row of a cell scores above the sum of its two bounds. A
heap over both centre lists, each in the order of its bounds (multi-sequence), yields the cells in the order of their
sums, so what a query has not met yet cannot score above the next cell's bound. A search stops where that certifies
all its windows: each is full, with the least score in it above the bound, or lies above the bound as a whole.

Rounds of growing budgets are Spark jobs: every open query takes its next cells, the cells' blocks are scored against the
queries that visit them, and the best rows of each window go on. Results are exact. The codebooks are fitted on a
sample of ``SAMPLE`` rows, every row is indexed; what the driver and the tasks share is the table of cells, at most
``MOST`` squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import written

#: Rows the codebooks are fitted on, about; most centres of a half; rows a cell has on average; steps of the fitting.
SAMPLE, MOST, CELL_ROWS, STEPS = 1 << 14, 256, 64, 8
#: Rows of a cell's block, queries that it is scored against at once.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
#: Rows that a query's first cells have together, and the growth from round to round.
FIRST_ROWS, GROWTH = 4096, 8
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a null vector or one with a null or non-finite component."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def _matrix(packed, width: int) -> np.ndarray:
    """Packed vectors, shorter ones filled with zeros."""
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        out[i, :len(p) // 4] = np.frombuffer(p, dtype="<i4")
    return out


class Codebooks:
    """Centres of both halves, and the cells' facts: rows, and the largest distance of a row from its centre by half."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.centres = [self._fit(x, k) for x in (sample[:, :self.half], sample[:, self.half:])]
        self.k = [len(c) for c in self.centres]

    @staticmethod
    def _fit(x: np.ndarray, k: int) -> np.ndarray:
        rng = np.random.default_rng(11)
        x = x[np.lexsort(x.T)] if x.shape[1] else x
        centres = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
        for _ in range(STEPS):
            near = Codebooks._nearest(x, centres)[0]
            n = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        return centres

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (centres ** 2).sum(axis=1)
        near = np.concatenate([np.argmin(square - 2 * x[s:s + 4096] @ centres.T, axis=1)
                               for s in range(0, len(x), 4096)]) if len(x) else np.empty(0, dtype=np.int64)
        return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance in the first half, in the second) of every row."""
        (a, da), (b, db) = (self._nearest(h, c) for h, c in zip((x[:, :self.half], x[:, self.half:]), self.centres))
        return a * self.k[1] + b, da, db

    def hold(self, cells: np.ndarray, rows: np.ndarray, far_a: np.ndarray, far_b: np.ndarray) -> None:
        n = self.k[0] * self.k[1]
        self.rows, self.far = np.zeros(n, dtype=np.int64), np.zeros((2, n))
        self.rows[cells], self.far[0][cells], self.far[1][cells] = rows, far_a, far_b
        grid = self.far.reshape(2, *self.k)
        self.radius = [grid[0].max(axis=1), grid[1].max(axis=0)]

    def visits(self, x: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(bound, own, cell) in the order of falling bounds, cells without rows left out. ``bound`` holds for this and
        all later cells, ``own`` (by the cell's own radii) for its rows."""
        halves = (x[:self.half], x[self.half:])
        length = [float(np.sqrt((h ** 2).sum())) for h in halves]
        inner = [c @ h for c, h in zip(self.centres, halves)]
        upper = [i + n * r for i, n, r in zip(inner, length, self.radius)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        (first, second), (ua, ub) = (o.tolist() for o in order), (u[o].tolist() for u, o in zip(upper, order))
        heap = [(-(ua[0] + ub[0]), 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            cell = first[i] * self.k[1] + second[j]
            if self.rows[cell]:
                yield -bound, float(inner[0][first[i]] + inner[1][second[j]] + length[0] * self.far[0][cell]
                                    + length[1] * self.far[1][cell]), cell
            if i + 1 < len(ua):
                heappush(heap, (-(ua[i + 1] + ub[j]), i + 1, j))
            if i == 0 and j + 1 < len(ub):  # the first row leads to every column, so each pair comes once
                heappush(heap, (-(ua[0] + ub[j + 1]), 0, j + 1))


class Index:
    """An inverted multi-index over (id bigint, label string, v array<bigint>): cells in blocks, in a written table."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE):
        self.spark = rows.sparkSession
        packed = rows.select("id", "label", "v").mapInArrow(_packed, "id long, label string, vec binary")
        rows = written(packed.distinct(), "index-rows")
        facts = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("w")).first()
        self.n, self.width = facts["n"], max(1, (facts["w"] or 0) // 4)
        steps = 1 << 20
        part = max(1, min(steps, ceil(steps * sample / max(1, self.n))))
        got = rows.filter(F.pmod(F.xxhash64("vec", "id"), F.lit(steps)) < part).select("vec").limit(4 * sample).toArrow()
        fitted = _matrix(got.column("vec").to_pylist(), self.width) if got.num_rows else np.zeros((1, self.width))
        books = Codebooks(fitted, max(1, min(MOST, isqrt(max(1, self.n // CELL_ROWS)))))
        width = self.width

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, da, db = books.place(_matrix(b.column("vec").to_pylist(), width))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(da), pa.array(db)],
                                                     names=["id", "label", "vec", "cell", "da", "db"])

        self.rows = written(rows.mapInArrow(cells, "id long, label string, vec binary, cell long, da double, db double"),
                            "index-cells")
        per = self.rows.groupBy("cell").agg(F.count("*"), F.max("da"), F.max("db")).toArrow()
        books.hold(*(np.asarray(per.column(i)) for i in range(4)))
        self.shared = self.spark.sparkContext.broadcast(books)
        self.blocks = self.spark.createDataFrame(
            pd.DataFrame({"cell": np.flatnonzero(books.rows), "n_blocks": -(-books.rows[books.rows > 0] // BLOCK_ROWS)}),
            "cell long, n_blocks int")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(query, window, score, id): of every window the ``k`` rows with the highest scores, of equal ones with the
        least ids. Queries: query bigint, id, label, vec, windows array<struct<window, lo, hi>>: a window takes rows of
        the query's label (``same``) or of others, not of its id, with lo <= score <= hi."""
        shared = self.shared

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            for b in batches:
                for s in range(0, b.num_rows, 64):  # the lists of cells may be long
                    part = b.slice(s, 64)
                    cells, upto, after = [], [], []
                    for vec, least, short, done, budget in zip(*(part.column(c).to_pylist() for c in
                                                                 ("vec", "least", "short", "done", "budget"))):
                        x = _matrix([vec], books.centres[0].shape[1] + books.centres[1].shape[1])[0]
                        slack = 0.5 + 1e-9 * abs(float(x @ x))
                        mine, rows, at, bound = [], 0, 0, None
                        for bound, own, cell in books.visits(x):
                            if at >= done:
                                if bound + slack < least or short and rows >= budget:
                                    break
                                if own + slack >= least:
                                    mine.append(cell)
                                    rows += int(books.rows[cell])
                            at += 1
                        else:
                            bound = None
                        cells.append(mine)
                        upto.append(at)
                        after.append(None if bound is None else bound + slack)
                    keep = [part.column(c) for c in ("query", "id", "label", "vec", "windows")]
                    yield pa.RecordBatch.from_arrays(
                        [*keep, pa.array(cells, type=pa.list_(pa.int64())), pa.array(upto, type=pa.int64()),
                         pa.array(after, type=pa.float64())], names=[f.name for f in planned.fields])

        queries = queries.select("query", "id", "label", "vec", "windows")
        planned = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.LongType())),
                                T.StructField("done", T.LongType()), T.StructField("after", T.DoubleType())])
        lowest = F.array_min("windows.lo").cast("double")
        pending = queries.withColumns({"least": lowest, "short": F.lit(True), "done": F.lit(0).cast("long")})
        found, budget = None, FIRST_ROWS
        while True:
            step = pending.withColumn("budget", F.lit(budget).cast("long"))
            step = written(step.mapInArrow(plan, planned), "index-plan")
            new = self._scored(step, same, k)
            best = new if found is None else found.join(step.select("query"), "query", "left_semi").union(new)
            best = _first(best, k, ["query", "window"])
            if found is not None:
                best = found.join(step.select("query"), "query", "left_anti").union(best)
            found = written(best, "index-found")
            # what each window still has to see: scores from its k-th on, or from its lower end if it is not full
            full = found.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            wants = (step.select("query", F.explode("windows").alias("w")).select("query", "w.*")
                     .join(full, ["query", "window"], "left")
                     .groupBy("query").agg(F.min(F.coalesce("kth", "lo")).cast("double").alias("least"),
                                           F.max(F.col("n").isNull()).alias("short"),
                                           # nothing below a full window's least score can enter it any more
                                           F.collect_list(F.struct("window", F.coalesce("kth", "lo").alias("lo"), "hi")).alias("open")))
            pending = (step.join(wants.withColumn("open", F.col("open").cast(step.schema["windows"].dataType)), "query")
                       .drop("windows").withColumnRenamed("open", "windows").filter(F.col("after").isNotNull() & (F.col("after") >= F.col("least")))
                       .select("query", "id", "label", "vec", "windows", "least", "short", "done"))
            pending = written(pending, "index-pending")
            if pending.isEmpty():
                return found
            budget *= GROWTH

    def _scored(self, step: DataFrame, same: bool, k: int) -> DataFrame:
        """The best rows of every window in the cells that the queries visit, block by block."""
        width = self.width

        def score(group: pd.DataFrame) -> pd.DataFrame:
            isq = group["windows"].notna().to_numpy()
            q, x = group[isq], group[~isq].sort_values("id", kind="stable")
            out = []
            if len(q) and len(x):
                a, m = _matrix(q["vec"].tolist(), width), _matrix(x["vec"].tolist(), width)
                if width * np.abs(a).max() * np.abs(m).max() >= EXACT:
                    a, m = a.astype(np.int64), m.astype(np.int64)
                scores = (a @ m.T).astype(np.int64)
                labels = pd.factorize(pd.concat([q["label"], x["label"]]))[0]
                ids = x["id"].to_numpy()
                fits = (labels[:len(q), None] == labels[None, len(q):]) == same
                fits &= q["id"].to_numpy()[:, None] != ids[None, :]
                for i, (query, windows) in enumerate(zip(q["query"], q["windows"])):
                    at = np.flatnonzero(fits[i])
                    at = at[np.argsort(-scores[i, at], kind="stable")]  # equal scores stay in the order of ids
                    s = scores[i, at]
                    for w in windows:
                        lo = int(np.searchsorted(-s, -w["hi"], side="left"))
                        hi = int(np.searchsorted(-s, -w["lo"], side="right"))
                        for j in range(lo, min(hi, lo + k)):
                            out.append((query, w["window"], int(s[j]), int(ids[at[j]])))
            return pd.DataFrame(out, columns=["query", "window", "score", "id"], dtype="int64")

        visits = step.select("query", "id", "label", "vec", "windows", F.explode("cells").alias("cell"))
        parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).cast("int").alias("n_parts"))
        facts = written(self.blocks.join(parts, "cell"), "index-visits")  # a row a cell, MOST squared at most
        visits = (visits.join(F.broadcast(facts), "cell")
                  .withColumn("part", F.pmod(F.xxhash64("query"), "n_parts").cast("int"))
                  .select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "query",
                          "id", "label", "vec", "windows"))
        rows = (self.rows.join(F.broadcast(facts), "cell")
                .withColumn("block", F.pmod(F.xxhash64("id", "vec"), "n_blocks").cast("int"))
                .select("cell", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "block",
                        F.lit(None).cast("long").alias("query"), "id", "label", "vec",
                        F.lit(None).cast(visits.schema["windows"].dataType).alias("windows")))
        return visits.union(rows).groupBy("cell", "part", "block").applyInPandas(
            score, "query long, window long, score long, id long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of whole numbers as packed 32-bit integers."""
    for b in batches:
        out = []
        for v in b.column("v").to_pylist():
            x = np.array(v, dtype=np.int64)
            if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * len(x) ** 0.5 >= 1 << 31:
                raise ValueError("a vector's components are too large for exact 64-bit scores")
            out.append(x.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, type=pa.binary())],
                                         names=["id", "label", "vec"])


def _first(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return df.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: id, label, v (array of whole numbers, as ``whole`` makes them). An anchor's positives are the first
    ``positives`` other rows of its label by (inner product, falling; id); the negatives of each are the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive. Rows with a null id,
    label or vector take no part; equal rows count once, and rows of the anchor's own id are no others; a short vector
    counts as filled with zeros; components whose scores might leave 64 bits are an error. Anchors without a positive
    or a negative have no rows. Without rows the result is empty.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v").filter(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    index = Index(rows)
    window = "array<struct<window:bigint,lo:bigint,hi:bigint>>"
    all_scores = F.array(F.struct(F.lit(0).alias("window"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi")))
    anchors = written(index.rows.filter(is_anchor).select("id", "label", "vec").withColumn(
        "query", F.monotonically_increasing_id()).withColumn("windows", all_scores.cast(window)), "index-anchors")
    found = index.search(anchors, True, positives).select("query", F.col("score").alias("positive_score"),
                                                          F.col("id").alias("positive_id"))
    found = written(found, "index-positives")
    # a window for each score of a positive: ceil(low * s / 100) to floor(high * s / 100), in whole numbers
    s = F.col("positive_score")
    lo, hi = (F.expr(f"({p} * positive_score - pmod({p} * positive_score, 100)) div 100") for p in (-low, high))
    lo = -lo
    windows = (found.select("query", s.alias("window"), lo.alias("lo"), hi.alias("hi")).distinct().filter("lo <= hi")
               .groupBy("query").agg(F.collect_list(F.struct("window", "lo", "hi")).cast(window).alias("windows")))
    got = index.search(anchors.drop("windows").join(windows, "query"), False, negatives)
    pairs = got.select("query", F.col("window").alias("positive_score"), F.col("score").alias("negative_score"),
                       F.col("id").alias("negative_id")).join(found, ["query", "positive_score"])
    rank = F.row_number().over(Window.partitionBy("query", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return pairs.join(anchors.select("query", F.col("id").alias("anchor_id")), "query").select(
        "anchor_id", "positive_id", rank.alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_negatives(vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), whole(F.col("embedding"), 256).alias("v"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 10
"""
