"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written


def _print(edges: DataFrame) -> tuple:
    """Count and content of an edge table, to see when it stops changing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected(edges: DataFrame, a: str, b: str, what: str = "components") -> DataFrame:
    """(node, component): for every node of ``edges`` (two bigint columns) the least node it is connected to.

    Large star: a node hands its larger neighbours to the least of its neighbourhood; small star: a node hands its
    smaller neighbours to the least of them. Both only move edges, and after a number of rounds that grows with the
    logarithm of the longest path every node hangs on its least one. Each round is written to the shared folder. No
    node's neighbours are ever collected; minima combine before the shuffle and AQE splits the joins' hot keys.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    e = written(e, what)
    now = _print(e)
    while now[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(least, "hi")
        small = met.select("hi", F.col("m").alias("lo")).union(met.filter("lo > m").select("lo", "m")).distinct()
        e = written(small, what)
        before, now = now, _print(e)
        if before == now:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select("lo", "lo").distinct())
