"""Helpers the operators share: Arrow row functions, written tables, bounded caches, id ranges."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigil.session import ensure_checkpoint_dir

#: A place where the vocabularies' patterns always cut: before a space that something other than white space follows.
#: (A run of white space leaves its last space to what follows; within a run there is no such place.)
CUT = re.compile(r" (?=\S)")
#: A word: a run of characters other than space and the control characters tab to carriage return (Java and RE2).
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later plans start from a pruned scan, and a
    lost executor recomputes nothing above it."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``, so that no column of theirs clashes with one of a join."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[T.StructField],
              keep: list[str] | None = None, when: str | None = None) -> DataFrame:
    """Run ``fn`` on each Arrow batch and add what it returns (name -> list or array) as columns ``fields``.

    ``keep``: the input columns that go on (default: all). A new column replaces an input column of its name.
    ``when``: name of a boolean entry of ``fn``'s result; rows where it is false are dropped.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in new]
    schema = T.StructType(kept + fields)
    names, types = [f.name for f in kept], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b)
            cols = [b.column(n) for n in names]
            for f, t in zip(fields, types):
                v = got[f.name]
                cols.append(v if isinstance(v, pa.Array) else pa.array(v, type=t))
            out = pa.RecordBatch.from_arrays(cols, names=names + [f.name for f in fields])
            if when is not None:
                out = out.filter(pa.array(got[when], type=pa.bool_()))
            yield out

    return df.mapInArrow(run, schema)


def _size(x) -> int:
    """Bytes of a key or value of a table, those of a tuple's entries included."""
    return getsizeof(x) + (sum(map(getsizeof, x)) if type(x) is tuple else 0)


class Cache2(dict):
    """A bounded lookup table for ``map``: ``make`` computes what is missing. When half of ``limit`` bytes (keys, values
    and the table's own) are in use the table becomes the old generation; entries still in use come back from it, the
    others go."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.used = make, limit // 2, {}, 0

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        self.used += 100 + _size(key) + _size(v)
        if self.used >= self.limit:
            self.old, self.used = dict(self), 0
            self.clear()
        self[key] = v
        return v


_HELD: dict = {}


def held(key, make: Callable):
    """What a worker keeps across tasks for the operator that it runs: ``make()`` under ``key``. A worker serves one
    operator after another, so the big tables of the one before go first and their memory goes back to the system."""
    v = _HELD.get(key)
    if v is None:
        if _HELD:
            _HELD.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
        v = _HELD[key] = make()
    return v


def range_bounds(df: DataFrame, col: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending split points of an integer column, from one aggregate over that column."""
    at = [i / ranges for i in range(1, ranges)]
    if not at:
        return []
    got = df.agg(F.percentile_approx(F.col(col), at, 100 * ranges).alias("b")).first()["b"]
    return sorted(set(got or []))


def range_of(bounds: list[int], values: pa.Array) -> np.ndarray:
    """Index of the range of each value: 0 for null, else 1 + the number of bounds below or at it."""
    ok = ~np.asarray(values.is_null())
    v = np.asarray(values.fill_null(0), dtype=np.int64)
    return np.where(ok, 1 + np.searchsorted(np.asarray(bounds, dtype=np.int64), v, side="right"), 0)


def range_column(bounds: list[int], col: str) -> Column:
    """``range_of`` as a column (one Arrow call on the id column alone)."""
    @F.pandas_udf(T.IntegerType())
    def place(v):
        return range_of_pandas(bounds, v)
    return place(F.col(col).cast("long"))


def range_of_pandas(bounds, v):
    import pandas as pd
    return pd.Series(range_of(bounds, pa.array(v, from_pandas=True, type=pa.int64())).astype("int32"))


def ranges_for(spark: SparkSession) -> int:
    """Number of id ranges to deal rows into: four for each shuffle partition."""
    return 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
