"""COPY TO and the rendering of results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import SourceError, check_location, list_files, move, remove

_COPY = {"format", "delimiter", "header", "quote", "escape", "null", "encoding", "single"}


def copy_to(spark: SparkSession, df: DataFrame, location: str, options: dict[str, Any], check: Callable[[], None] = lambda: None) -> int:
    """Writes beside the target, then renames, so a reader sees all or nothing. Returns the rows. check: called before
    the renaming; what it raises leaves the target as it was.

    One file by default, as the dialect says; with ``single false`` a folder of files that all tasks write.
    """
    location = check_location(location)
    if unknown := set(options) - _COPY:
        raise SourceError(f"unknown COPY option {unknown.pop()}")
    kind = str(options.get("format") or ("parquet" if location.lower().endswith(".parquet") else "csv")).lower()
    if str(options.get("encoding", "utf-8")).lower().replace("-", "") != "utf8":
        raise SourceError("the encoding is UTF-8")
    single = str(options.get("single", "true")).lower() == "true"
    temporary = f"{location.rstrip('/')}.writing-{uuid.uuid4().hex}"
    counted = Observation()
    df = df.observe(counted, F.count(F.lit(1)).alias("n"))
    writer = (df.coalesce(1) if single else df).write.mode("error")
    try:
        if kind == "parquet":
            writer.parquet(temporary)
        elif kind == "csv":
            null = str(options.get("null", ""))
            (
                writer.option("header", str(options.get("header", "true")).lower())
                .option("sep", options.get("delimiter", ","))
                .option("quote", options.get("quote", '"'))
                .option("escape", options.get("escape", '"'))
                .option("nullValue", null)
                .option("emptyValue", '""')
                .option("ignoreLeadingWhiteSpace", "false")
                .option("ignoreTrailingWhiteSpace", "false")
                .csv(temporary)
            )
        else:
            raise SourceError(f"COPY writes csv and parquet, not {kind}")
        check()
        if single:
            (file,) = [f for f in list_files(spark, temporary) if f.size or kind == "csv"][:1]
            move(spark, file.path, location)
        else:
            move(spark, temporary, location)
    finally:
        remove(spark, temporary)
    return counted.get["n"]


def text_of(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (date, time)):
        return value.isoformat()
    if isinstance(value, timedelta):
        return str(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    return str(value)


def render(df: DataFrame, how: str = "table", null: str = "") -> Iterator[str]:
    """Lines of the result as table, csv or jsonl; rows come from the executors a partition at a time."""
    names = df.columns
    if how == "jsonl":
        for row in df.toLocalIterator():
            yield json.dumps({n: v if v is None or isinstance(v, (bool, int, float, str, list, dict)) else text_of(v) for n, v in zip(names, row, strict=True)}, ensure_ascii=False)
        return
    if how == "csv":
        yield ",".join(_cell(n) for n in names)
        for row in df.toLocalIterator():
            yield ",".join(null if v is None else _cell(text_of(v)) for v in row)
        return
    if how != "table":
        raise SourceError("results are rendered as table, csv or jsonl")
    rows = [["NULL" if v is None else text_of(v) for v in row] for row in df.toLocalIterator()]
    widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    yield " | ".join(n.ljust(w) for n, w in zip(names, widths, strict=True)).rstrip()
    yield "-+-".join("-" * w for w in widths)
    for r in rows:
        yield " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()
    yield f"({len(rows)} row{'' if len(rows) == 1 else 's'})"


def _cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') or text == "" else text
