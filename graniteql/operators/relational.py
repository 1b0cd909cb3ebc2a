"""The dialect's operators that Spark's DataFrames lack, for DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..types import common_type


def mark_in(df: DataFrame, needle: str, values: DataFrame, value: str, mark: str, by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``mark``: three-valued ``needle IN (values)``, for each row among the values of its own key where
    ``by`` gives (column of df, column of values) pairs. One join with the distinct values, one with their counts."""
    by = by or []
    keys = [F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    known = values.select(*keys, F.col(value).alias("_y"))
    hits = known.filter("_y is not null").distinct().withColumn("_hit", F.lit(True))
    stats = known.groupBy(*names).agg(F.count("*").alias("_n"), (F.count("*") - F.count("_y")).alias("_nulls"))
    same = [F.col(a) == F.col(n) for (a, _), n in zip(by, names, strict=True)]
    out = df.join(hits, [F.col(needle) == F.col("_y"), *same], "left").drop("_y", *names)
    out = out.join(stats, same, "left") if by else out.crossJoin(F.broadcast(stats))  # without keys that is one row
    n = F.coalesce("_n", F.lit(0))
    found = F.when(F.col("_hit"), F.lit(True)).when(n == 0, F.lit(False)).when(F.col(needle).isNull() | (F.col("_nulls") > 0), F.lit(None)).otherwise(F.lit(False))
    return out.withColumn(mark, found.cast("boolean")).drop("_hit", "_n", "_nulls", *names)


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, **aggregates: Column) -> DataFrame:
    """Aggregates over GROUPS BETWEEN low AND high: a RANGE over the dense rank of the order. low and high count
    groups of equal rows; Window.unboundedPreceding and the like are allowed."""
    out = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame: WindowSpec = Window.partitionBy(*partition).orderBy("_group").rangeBetween(low, high)
    return out.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).drop("_group")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition with window functions is true."""
    return df.withColumn("_qualify", condition).filter("_qualify").drop("_qualify")


def full_using(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """FULL JOIN ... USING: one key column, from whichever side has the row."""
    return left.join(right, keys, "full")


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a set operation with the left's names and the lossless common type of each column."""
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides of a set operation need as many columns")
    kinds = []
    for (_, a), (_, b) in zip(left.dtypes, right.dtypes, strict=True):
        kind = a if b == "void" else b if a == "void" else common_type(a, b)
        if kind is None and {a, b} <= {"tinyint", "smallint", "int", "bigint", "float", "double"} | {x for x in (a, b) if x.startswith("decimal")}:
            kind = "double"
        if kind is None:
            raise ValueError(f"no common type of {a} and {b}")
        kinds.append(kind)
    cast = lambda df: df.toDF(*left.columns).select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(left.columns, kinds, strict=True)))
    return cast(left), cast(right)


def grouping_mask(*columns: str) -> Column:
    """GROUPING(a, b, ...) as a bit mask, the last column the lowest bit."""
    n = len(columns)
    mask = sum((F.grouping(c).cast("bigint") * (1 << (n - 1 - i)) for i, c in enumerate(columns)), F.lit(0).cast("bigint"))
    return mask
