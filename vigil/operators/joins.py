"""Joins against small derived tables, with the size of the small side checked.

The check is two-tier. Catalyst's size estimate of the optimized plan comes
first (no job). Scans and aggregates are estimated at most at their input size,
so a side estimated under ``ESTIMATE_SMALL_BYTES`` is small. Only when the
estimate is large (the normal case at scale) is the side counted exactly.
Within the row bound it is broadcast, so a hot key on the big side never meets a
shuffle; beyond it the plain join is left to AQE, whose skew-join split handles
hot keys.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a derived side may have and still be broadcast (per-model / per-feature / per-bin tables): the driver builds the
# hash table, some 300 bytes a row with text keys, so 60 MB at most.
BROADCAST_MAX_ROWS = 200_000
# A plan whose optimizer estimate is below this many bytes is treated as small without counting.
ESTIMATE_SMALL_BYTES = 64 * 1024 * 1024


def size_estimate(df: DataFrame) -> int:
    """Optimizer's size estimate of ``df`` in bytes (no job runs)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - statistics unavailable: treat as large and count
        return 1 << 62


def is_small(df: DataFrame, max_rows: int, persist: bool = True, bounded_by: DataFrame | None = None
             ) -> tuple[DataFrame, bool]:
    """(df, small?) — estimate first, exact count only when the estimate is large.

    ``bounded_by``: a join-free plan with at least as many rows as ``df`` by construction (e.g. the
    aggregate whose keys ``df`` has one row per); its estimate stands in for ``df``'s, since Spark estimates
    any join as the product of its sides.
    """
    if size_estimate(df if bounded_by is None else bounded_by) <= ESTIMATE_SMALL_BYTES:
        return df, True
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count() <= max_rows


def materialize_small(df: DataFrame) -> DataFrame:
    """Persist a small derived table that several branches read, so its plan runs once (filled lazily by the
    first action that reads it)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def persist_shared(df: DataFrame) -> DataFrame:
    """Persist a table several branches of one plan read (memory, spilling to disk); not assumed small."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_MAX_ROWS,
               bounded_by: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to a side that is expected to be small: broadcast within the checked bound, else a plain
    (AQE, skew-split) join."""
    small, ok = is_small(small, max_rows, bounded_by=bounded_by)
    if ok:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small derived table to the shared checkpoint folder (``spark.checkpoint.dir``) and continue from
    it: later plans start from a short scan instead of re-planning the whole history after every stage, and a
    lost executor recomputes nothing upstream."""
    from vigil.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global aggregate: a threshold, a latest check, a total) to every
    row of ``df``: a broadcast equi-join on a constant key, linear in ``df``."""
    k = "_attach_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k)
