"""Spark's rows against DuckDB's over the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(values):
    return sorted((tuple(plain(x) for x in r) for r in values), key=repr)


def same(df, c, text):
    """Names and rows, in any order."""
    names = sorted(df.columns)
    found = rows(df.select(*(f"`{n}`" for n in names)).collect())
    assert sorted(c.sql(text).columns) == names
    assert found == rows(c.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({text})").fetchall())
