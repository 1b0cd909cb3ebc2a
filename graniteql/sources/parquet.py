"""Parquet files: schema modes for many files, and typed Hive partitions."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import common_type
from .files import File, SourceError, check_location, list_files

MODES = ("strict", "union", "safe_widening")
_MANY = 64
_NULL = "__HIVE_DEFAULT_PARTITION__"


def file_schemas(spark: SparkSession, files: list[File]) -> dict[tuple, list[File]]:
    """Files by schema, from their footers: ((name, type), ...) -> files."""

    def schema(f: File) -> tuple:
        return tuple((x.name, x.dataType.simpleString()) for x in spark.read.parquet(f.path).schema.fields)

    out: dict[tuple, list[File]] = {}
    with ThreadPoolExecutor(32) as pool:
        for f, found in zip(files, pool.map(schema, files), strict=True):
            out.setdefault(found, []).append(f)
    return out


def merged_schema(schemas: list[tuple], mode: str) -> list[tuple[str, str]]:
    if mode not in MODES:
        raise SourceError(f"schema_mode is one of {', '.join(MODES)}")
    first = list(schemas[0])
    if mode == "strict":
        for other in schemas[1:]:
            if list(other) != first:
                raise SourceError("the files' schemas differ")
        return first
    merged = dict(first)
    for other in schemas[1:]:
        for name, kind in other:
            if name not in merged:
                merged[name] = kind
            elif merged[name] != kind:
                wider = common_type(merged[name], kind) if mode == "safe_widening" else None
                if wider is None:
                    raise SourceError(f"column {name} is {merged[name]} and {kind}")
                merged[name] = wider
    return list(merged.items())


def partition_values(path: str) -> dict[str, str | None]:
    """key=value folders of a path."""
    out: dict[str, str | None] = {}
    for part in path.split("/")[:-1]:
        if "=" in part:
            key, value = part.split("=", 1)
            if not key or key in out:
                raise SourceError(f"empty or repeated partition key in {path}")
            out[key] = None if value == _NULL else unquote(value)
    return out


def partition_type(values: list[str | None]) -> str:
    """boolean, bigint or date if all values are; else string."""
    seen = [v for v in values if v is not None]
    for kind, pattern in (("boolean", r"(?i)true|false"), ("bigint", r"-?\d{1,18}"), ("date", r"\d{4}-\d\d-\d\d")):
        if seen and all(re.fullmatch(pattern, v) for v in seen):
            return kind
    return "string"


def read_parquet(spark: SparkSession, location: str, union_by_name: bool | None = None, schema_mode: str | None = None, hive_partitioning: bool = False) -> DataFrame:
    """Files of equal schema are one scan, with column pruning and pushed filters; several schemas are a union of
    such scans, each cast to the common one. Hive keys are ordinary columns of the scan and prune its files."""
    if union_by_name is not None and schema_mode is not None:
        raise SourceError("union_by_name and schema_mode exclude each other")
    mode = schema_mode or ("union" if union_by_name else "strict")
    files = list_files(spark, location, (".parquet",))
    if mode not in MODES:
        raise SourceError(f"schema_mode is one of {', '.join(MODES)}")
    if len(files) == 1 and not hive_partitioning:
        return spark.read.parquet(*_paths(location, files))
    if len(files) > _MANY and mode == "union" and not hive_partitioning:
        # footers are merged by Spark's tasks, not one by one from here; strict needs each file's own
        return spark.read.option("mergeSchema", "true").parquet(*_paths(location, files))
    groups = file_schemas(spark, files)
    columns = merged_schema(list(groups), mode)
    keys: dict[str, str] = {}
    if hive_partitioning:
        found = [partition_values(f.path) for f in files]
        if any(set(x) != set(found[0]) for x in found):
            raise SourceError("the files' partition keys differ")
        keys = {k: partition_type([x[k] for x in found]) for k in found[0]}
        columns = [c for c in columns if c[0] not in keys]
    parts = []
    for schema, own in groups.items():
        names = {n for n, _ in schema}
        reader = spark.read
        if hive_partitioning and keys:
            reader = reader.option("basePath", _base(own[0].path)).schema(", ".join([*(f"`{n}` {t}" for n, t in schema if n not in keys), *(f"`{k}` {t}" for k, t in keys.items())]))
        paths = [f.path for f in own] if len(groups) > 1 or hive_partitioning else _paths(location, own)
        df = reader.parquet(*paths)
        chosen = [(F.col(f"`{n}`").cast(t) if n in names else F.lit(None).cast(t)).alias(n) for n, t in columns]
        parts.append(df.select(*chosen, *(F.col(f"`{k}`").cast(t).alias(k) for k, t in keys.items())))
    return reduce(DataFrame.unionByName, parts)


def _paths(location: str, files: list[File]) -> list[str]:
    return [f.path for f in files] if any(c in location for c in "*?[{") else [check_location(location)]


def _base(path: str) -> str:
    out = []
    for part in path.split("/"):
        if "=" in part:
            break
        out.append(part)
    return "/".join(out)
