"""All queries of the engine's own operators, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("tpch", "functions", "relational", "storage", "surfaces")


def _all() -> list:
    return [import_module(f"graniteql.plans.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for m in _all() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _all() for k, s in m.ORACLE.items()}
