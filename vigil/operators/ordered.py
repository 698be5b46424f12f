"""Order statistics without sending a whole group to one task.

``running_totals`` gives inclusive running sums of weights over the sorted
values of each group. Large inputs are range-partitioned on (group, value)
(sampled bounds, binary search per row), the totals of the groups that ranges cut
are tiny and give the offsets, and the final running sum is a window over (group,
range): a group that holds a third of all rows is spread over many tasks. The result is
exact: the sampling only decides where the cuts go.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.joins import ESTIMATE_SMALL_BYTES, size_estimate

DEFAULT_RANGES = 64
# Below this many (group, value) rows in total a single sort per group is bounded by the check itself.
SMALL_INPUT_ROWS = 1_000_000
# Larger inputs get more value ranges (each range is sorted by one task).
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000


def running_totals(
    df: DataFrame,
    group_cols,
    value_col: str,
    weight_cols,
    ranges: int = DEFAULT_RANGES,
    descending: bool = False,
    small_rows: int | None = None,
    tiebreak_cols=(),
) -> DataFrame:
    """Inclusive running sums ``<w>_cum`` and group totals ``<w>_total`` per weight column.

    ``df`` must hold one row per (group, value) — pre-aggregate first so the
    shuffle carries distinct values, not raw rows. Inputs up to ``small_rows``
    rows use one window per group; larger ones are cut into value ranges.
    """
    small_rows = SMALL_INPUT_ROWS if small_rows is None else small_rows
    g = list(group_cols)
    w = list(weight_cols)
    tb = list(tiebreak_cols)
    key = F.col(value_col) if not descending else -F.col(value_col)
    if size_estimate(df) <= ESTIMATE_SMALL_BYTES and small_rows > 0:
        n_rows = 0  # bounded by the plan estimate: no count needed
    else:
        n_rows = df.count()
    df = df.withColumn("_ord", key)
    if n_rows <= small_rows:
        over_g = Window.partitionBy(*g) if g else Window.partitionBy()
        upto = over_g.orderBy("_ord", *tb).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[c for c in df.columns if c != "_ord"],
                         *[F.sum(c).over(upto).alias(f"{c}_cum") for c in w],
                         *[F.sum(c).over(over_g).alias(f"{c}_total") for c in w])
    # Large input: range-partition on (group, value). The partitioner finds each row's range by binary
    # search on sampled bounds, so a hot group is spread over many ranges; the assignment is persisted once
    # so every branch below sees the same ranges.
    parts = min(MAX_RANGES, max(ranges, -(-n_rows // ROWS_PER_RANGE)))
    ranged = (df.repartitionByRange(parts, *[F.col(c) for c in g], F.col("_ord"))
              .withColumn("_rng", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK))
    # Ranges are stretches of the (group, value) order, so a group that lies in several of them is the least or the
    # greatest of each: only these groups (two a range at most) need offsets, the others are whole in their range.
    edge = ranged
    if g:
        key = F.struct(*[F.col(c).alias(f"_t_{c}") for c in g])
        ends = ranged.groupBy("_rng").agg(F.min(key).alias("a"), F.max(key).alias("b"))
        ends = ends.select(F.explode(F.array("a", "b")).alias("k")).select("k.*").distinct()
        edge = ranged.join(F.broadcast(ends), _same_group(g), "left_semi")
    totals = edge.groupBy(*g, "_rng").agg(*[F.sum(c).alias(f"_{c}_r") for c in w])
    over_g = Window.partitionBy(*g) if g else Window.partitionBy()
    before = over_g.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"_t_{c}") for c in g], F.col("_rng").alias("_t_rng"),
        *[F.coalesce(F.sum(f"_{c}_r").over(before), F.lit(0)).alias(f"_{c}_off") for c in w],
        *[F.sum(f"_{c}_r").over(over_g).alias(f"_{c}_all") for c in w],
    )
    # a row's range and group meet their totals null-safely: a null group is a group in this form too
    out = ranged.join(F.broadcast(totals), (F.col("_rng") == F.col("_t_rng")) & _same_group(g), "left")
    local = Window.partitionBy(*g, "_rng")
    upto = local.orderBy("_ord", *tb).rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        *[c for c in df.columns if c != "_ord"],
        *[(F.coalesce(f"_{c}_off", F.lit(0)) + F.sum(c).over(upto)).alias(f"{c}_cum") for c in w],
        *[F.coalesce(f"_{c}_all", F.sum(c).over(local)).alias(f"{c}_total") for c in w],
    )


def _same_group(group_cols) -> Column:
    """A row's group is that of the ``_t_`` columns."""
    same = F.lit(True)
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return same


def quantiles_from_counts(counts: DataFrame, group_cols, value_col: str, levels, count_col: str = "cnt",
                          ranges: int = DEFAULT_RANGES, out_col: str = "quantiles") -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's rule) from a (group, value, count) table; one row per group.

    Each distinct value knows the rank span it covers; only values covering one of
    the 2·k target ranks (floor and next of (n-1)·p) survive, so the final per-group
    aggregate sees at most 2·k rows. Expressions are array-shaped, independent of k.
    """
    g = list(group_cols)
    k = len(levels)
    lv = F.array(*[F.lit(float(p)) for p in levels])
    ranked = running_totals(counts, g, value_col, [count_col], ranges=ranges)
    n = F.col(f"{count_col}_total")
    first = F.col(f"{count_col}_cum") - F.col(count_col)
    last = F.col(f"{count_col}_cum") - 1
    # target rank j: floor((n-1)p_j) for j < k, min(that + 1, n-1) for j >= k
    def rank_of(j):
        lo = F.floor((n - 1).cast("double") * F.element_at(lv, (j % k) + 1))
        return F.when(j < k, lo).otherwise(F.least(lo + 1, n - 1))
    hits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2 * k - 1)), lambda j: F.struct(j.alias("j"),
                                                                                          rank_of(j).alias("r"))),
                    lambda x: (x["r"] >= first) & (x["r"] <= last))
    picked = ranked.select(*g, F.col(value_col).alias("_v"), n.alias("_n"), F.explode(hits).alias("_h"))
    agg = (picked.groupBy(*g) if g else picked.groupBy()).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_h.j"), F.col("_v")))).alias("_m"),
        F.first("_n").alias("_n"))

    def lerp(i):
        pos = (F.col("_n") - 1).cast("double") * F.element_at(lv, i + 1)
        t = pos - F.floor(pos)
        a, b = F.col("_m")[i], F.col("_m")[i + k]
        d = b - a
        # written the way numpy's quantile interpolates, so edges agree bit for bit
        return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)
    return agg.select(*g, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lerp).alias(out_col))



def quantile_hits(levels, n: Column, first: Column, last: Column) -> Column:
    """Target ranks (0-based) a value covering ranks [first, last] provides: ``array<struct<j, r>>`` with
    j < k for floor((n-1)p_j) and j >= k for the next rank (numpy's linear rule)."""
    k = len(levels)
    lv = F.array(*[F.lit(float(p)) for p in levels])

    def rank_of(j):
        lo = F.floor((n - 1).cast("double") * F.element_at(lv, (j % k) + 1))
        return F.when(j < k, lo).otherwise(F.least(lo + 1, n - 1))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(2 * k - 1)),
                                lambda j: F.struct(j.alias("j"), rank_of(j).alias("r"))),
                    lambda x: (x["r"] >= first) & (x["r"] <= last))


def quantile_lerp(levels, n: Column, picks: Column) -> Column:
    """Quantiles from the picked values (``map<j, value>``), interpolated the way numpy does it."""
    k = len(levels)
    lv = F.array(*[F.lit(float(p)) for p in levels])

    def lerp(i):
        pos = (n - 1).cast("double") * F.element_at(lv, i + 1)
        t = pos - F.floor(pos)
        a, b = picks[i], picks[i + k]
        d = b - a
        return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lerp)
