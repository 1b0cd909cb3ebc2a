"""SQL type names of the dialect and their Spark types."""

from __future__ import annotations

from .sql.parser import SqlError

_SIGNED = {"TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "SIGNED", "INT1", "INT2", "INT4", "INT8", "LONG"}
_UNSIGNED = {"UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT", "UINT8", "UINT64", "UNSIGNED"}
_FLOATING = {"FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION", "FLOAT4", "FLOAT8"}
_TEXT = {"VARCHAR", "TEXT", "CHAR", "STRING", "CHARACTER", "CHARACTER VARYING", "CHAR VARYING", "BPCHAR"}

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def is_unsigned(name: str) -> bool:
    return name in _UNSIGNED or name.endswith(" UNSIGNED")


def spark_type(name: str, args: list[int]) -> str:
    """Whole numbers are 64-bit, floating ones double; a bare DECIMAL is (18,3). Unsigned ones are decimal(20,0)."""
    if name in _SIGNED:
        return "BIGINT"
    if is_unsigned(name):
        return "DECIMAL(20,0)"
    if name in _FLOATING:
        return "DOUBLE"
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        p, s = (args + [0])[:2] if args else (18, 3)
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise SqlError(f"DECIMAL({p},{s}) isn't a type")
        return f"DECIMAL({p},{s})"
    if name in _TEXT:
        return "STRING"
    if name in ("BOOLEAN", "BOOL"):
        return "BOOLEAN"
    if name in ("BINARY", "BLOB", "BYTEA", "VARBINARY"):
        return "BINARY"
    if name == "DATE":
        return "DATE"
    if name == "TIME":
        return f"TIME({min(args[0], 6) if args else 6})"
    if name in ("TIMESTAMP", "DATETIME"):
        return "TIMESTAMP_NTZ"
    if name in ("TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE"):
        return "TIMESTAMP"
    if name.startswith("INTERVAL "):
        return name
    if name == "UUID":
        return "UUID"
    raise SqlError(f"unknown type {name}")


def common_type(a: str, b: str) -> str | None:
    """Lossless common type of two Spark type names for files merged with widening; None if there is none."""
    order = {t: i for i, t in enumerate(INTEGRAL)}
    if a == b:
        return a
    if a in order and b in order:
        return max(a, b, key=order.__getitem__)
    if {a, b} == {"float", "double"}:
        return "double"
    if a.startswith("decimal") or b.startswith("decimal"):
        (p, s), (q, t) = _digits(a), _digits(b)
        if min(p, q) < 0:
            return None
        scale, whole = max(s, t), max(p - s, q - t)
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None
    return None


def _digits(name: str) -> tuple[int, int]:
    if name.startswith("decimal"):
        p, s = name[8:-1].split(",")
        return int(p), int(s)
    return {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0)}.get(name, (-1, 0))
