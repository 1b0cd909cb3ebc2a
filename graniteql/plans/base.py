"""Queries given as dialect text, run by the engine over the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def engine_for(spark: SparkSession, sf_dir: str, text: str, store: str | None = None) -> Engine:
    """An engine that knows the tables the text names."""
    engine = Engine(spark, store)
    words = set(re.findall(r"[a-z_]+", text.lower()))
    for name in TABLES:
        if name in words:
            engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


class Suite:
    """Collects queries and what DuckDB should say to the same tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """oracle: its text where it isn't the same."""
        self.queries[name] = lambda spark, sf_dir: engine_for(spark, sf_dir, text).execute(text).df
        self.oracle[name] = oracle or text

    def df(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracle[f.__name__] = oracle
            return f

        return keep
