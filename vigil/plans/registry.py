"""Query registry used by ``__spark_entry__``, the bench and the oracle check."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ["drift_q", "ml_q", "decide_q", "ledger_q", "validate_q", "replay_q", "stream_q", "misc_q", "source_q"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle SQL.

    Times are UTC throughout (as in the monitored system), so the session zone is pinned before planning.
    """
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from vigil.session import ship_package
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)  # executors' Python workers import the package (UDFs, stream state functions)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"vigil.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"vigil.plans.{m}":
                raise


def r6(c) -> Column:
    """Round a double for comparison with the oracle (summation order differs by ulps)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
