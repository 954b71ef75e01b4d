"""All queries of the core and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _name in ("store", "parse", "search", "graph", "assemble", "evaluate"):
    _module = import_module(f"scriptorium.plans.queries_{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
