"""Named queries over the supplied tables, each with its DuckDB counterpart.

A module of this package has ``QUERIES`` (name to a function of session and
table directory) and ``SQL`` (name to the statement DuckDB answers).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("transcripts", "reconcile", "history", "relinking", "presentation", "functions_", "exchange", "files")


def _loaded():
    return [import_module(f"sessionlake.catalog.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _loaded() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _loaded() for name, sql in module.SQL.items()}
