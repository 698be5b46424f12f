"""Registered queries: each reads the given tables and returns a DataFrame, with a DuckDB oracle where one exists."""

from vigil.plans.registry import ORACLES, QUERIES, load_all  # noqa: F401
