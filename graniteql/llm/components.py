"""Connected components of a graph of longs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is tied to the least of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(u, v) pairs -> (node, root): the least node of the component, for all nodes but the roots.

    The number of rounds is about the logarithm of the longest path. Each round is written, so a lost executor
    repeats tasks of one round only; the driver sees a count and a checksum.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}0")
    before, k = None, 0
    mark = _mark(now)
    while mark != before and mark[0]:
        large = scratch.write(_large(now), f"{name}{k}large")
        now = scratch.write(_small(large), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}", f"{name}{k}large")
        before, mark, k = mark, _mark(now), k + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
