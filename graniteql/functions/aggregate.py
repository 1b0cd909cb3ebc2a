"""Aggregates of the dialect as Spark SQL text: exact sums, double averages, 64-bit counts and ranks."""

from __future__ import annotations

from collections.abc import Callable

from ..sql.parser import SqlError
from ..types import INTEGRAL
from .scalar import _decimal

AGGREGATES = {"count", "sum", "avg", "min", "max"}
RANKS = {"row_number", "rank", "dense_rank", "ntile"}
WINDOW_ONLY = RANKS | {"percent_rank", "cume_dist", "lead", "lag", "first_value", "last_value"}


def aggregate(name: str, args: list[str], star: bool, distinct: bool, tail: str, kind: Callable[[str], str]) -> str:
    """tail: a FILTER or OVER clause, which belongs to each single call."""
    if name == "count":
        if star or not args:
            return f"count(*){tail}"
        return f"count({'DISTINCT ' if distinct else ''}{', '.join(args)}){tail}"
    if len(args) != 1:
        raise SqlError(f"{name} takes one argument")
    x, d = args[0], "DISTINCT " if distinct else ""
    if name in ("min", "max"):
        return f"{name}({x}){tail}"
    found = kind(x)
    if found in INTEGRAL:
        exact = f"CAST({x} AS DECIMAL(38,0))"
    elif digits := _decimal(found):
        exact = f"CAST({x} AS DECIMAL(38,{digits[1]}))"
    elif found in ("float", "double", "void"):
        exact = f"CAST({x} AS DOUBLE)"
    else:
        raise SqlError(f"{name} takes numbers, not {found}")
    if name == "sum":
        if found in ("float", "double", "void"):
            return f"sum({d}{exact}){tail}"
        scale = digits[1] if found not in INTEGRAL else 0
        return f"CAST(sum({d}{exact}){tail} AS DECIMAL(38,{scale}))"
    if found in ("float", "double", "void"):
        return f"avg({d}{exact}){tail}"
    return f"(CAST(sum({d}{exact}){tail} AS DOUBLE) / nullif(count({d}{x}){tail}, 0))"
