"""Scalar functions of the dialect as Spark SQL text.

Each takes the texts of its arguments and ``kind``, which tells the Spark type of a text. They stay inside
Spark's own expressions, so whole-stage code generation and pushdown see through them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sql.parser import SqlError
from ..types import INTEGRAL

Kind = Callable[[str], str]


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(text: str) -> str | None:
    if len(text) > 1 and text[0] == text[-1] == "'":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return None


def _count(n: int, *sizes: int) -> None:
    if n not in sizes:
        raise SqlError(f"wrong number of arguments: {n}")


def _substring(args: list[str], kind: Kind) -> str:
    _count(len(args), 2, 3)
    s, start = args[:2]
    if len(args) == 2:
        return f"substring({s}, CAST({start} AS INT))"
    size = args[2]
    at, n = f"CAST({start} AS INT)", f"CAST({size} AS INT)"
    if start.isdigit() and size.isdigit():
        return f"substring({s}, {max(1, int(start))}, {max(0, int(size) - (int(start) == 0))})"
    checked = f"CASE WHEN {n} < 0 THEN CAST(raise_error('negative length in substring') AS INT) ELSE {n} END"
    return f"CASE WHEN {at} = 0 THEN substring({s}, 1, {checked} - 1) ELSE substring({s}, {at}, {checked}) END"


def _trim(side: str) -> Callable[[list[str], Kind], str]:
    def text(args: list[str], kind: Kind) -> str:
        _count(len(args), 1, 2)
        return f"trim({side} {args[1] if len(args) == 2 else quote(' ')} FROM {args[0]})"

    return text


def _concat(args: list[str], kind: Kind) -> str:
    return f"concat_ws('', {', '.join(f'CAST({a} AS STRING)' for a in args)})"


def _regexp_replace(args: list[str], kind: Kind) -> str:
    """All matches; back references are \\1, and $ is no more than itself."""
    _count(len(args), 3)
    known = _literal(args[2])
    if known is not None:
        parts = re.split(r"(\\\d|\\\\)", known)
        java = "".join(("$" + p[1]) if re.fullmatch(r"\\\d", p) else "\\\\" if p == "\\\\" else p.replace("\\", "\\\\").replace("$", "\\$") for p in parts)
        return f"regexp_replace({args[0]}, {args[1]}, {quote(java)})"
    safe = f"replace({args[2]}, '$', {quote(chr(92) + '$')})"
    turned = f"regexp_replace({safe}, {quote(r'\\(\d)')}, {quote(chr(92) + '$$1')})"
    return f"regexp_replace({args[0]}, {args[1]}, {turned})"


def _decimal(name: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
    return (int(m[1]), int(m[2])) if m else None


def _whole(how: str) -> Callable[[list[str], Kind], str]:
    def text(args: list[str], kind: Kind) -> str:
        _count(len(args), 1)
        x = args[0]
        found = kind(x)
        if d := _decimal(found):
            return f"CAST({how}({x}) AS DECIMAL({d[0]},0))"
        # on doubles Spark's own would give a 64-bit integer; rint-like arithmetic keeps range, NaN and infinities
        y = f"CAST({x} AS DOUBLE)"
        if found in INTEGRAL:
            return y
        return f"CASE WHEN abs({y}) < 9.0E15D THEN CAST({how}({y}) AS DOUBLE) ELSE {y} END"

    return text


def _round(args: list[str], kind: Kind) -> str:
    _count(len(args), 1, 2)
    x, n = args[0], args[1] if len(args) == 2 else "0"
    found = kind(x)
    if d := _decimal(found):
        if not re.fullmatch(r"-?\s*\d+|\(-\d+\)", n):
            raise SqlError("the digits of ROUND on a decimal must be constant")
        scale = min(d[1], max(0, int(n.strip("()").replace(" ", ""))))
        return f"CAST(round({x}, {n}) AS DECIMAL({d[0]},{scale}))"
    if found in INTEGRAL:
        return f"CAST(round({x}, {n}) AS {found.upper()})"
    return f"round({x}, {n})"


PARTS = ("year", "month", "day", "hour", "minute", "second")


def _part(args: list[str], kind: Kind) -> str:
    _count(len(args), 2)
    part = (_literal(args[0]) or "").lower().rstrip("s")
    if part not in PARTS:
        raise SqlError(f"unknown date part {args[0]}")
    if part == "second":
        return f"CAST(floor(extract(SECOND FROM {args[1]})) AS BIGINT)"
    return f"CAST(extract({part.upper()} FROM {args[1]}) AS BIGINT)"


def _trunc(args: list[str], kind: Kind) -> str:
    _count(len(args), 2)
    unit = (_literal(args[0]) or "").lower()
    if unit not in PARTS:
        raise SqlError(f"unknown unit {args[0]}")
    if kind(args[1]) == "timestamp":
        raise SqlError("date_trunc takes no time stamp with time zone")
    done = f"date_trunc({quote(unit.upper())}, CAST({args[1]} AS TIMESTAMP))" if kind(args[1]) == "date" else f"date_trunc({quote(unit.upper())}, {args[1]})"
    return f"CAST({done} AS {'DATE' if unit in ('year', 'month', 'day') else 'TIMESTAMP_NTZ'})"


def _one(pattern: str, n: int = 1) -> Callable[[list[str], Kind], str]:
    def text(args: list[str], kind: Kind) -> str:
        _count(len(args), n)
        return pattern.format(*args)

    return text


SCALAR: dict[str, Callable[[list[str], Kind], str]] = {
    "substring": _substring,
    "substr": _substring,
    "length": _one("CAST(length({0}) AS BIGINT)"),
    "char_length": _one("CAST(length({0}) AS BIGINT)"),
    "character_length": _one("CAST(length({0}) AS BIGINT)"),
    "lower": _one("lower({0})"),
    "upper": _one("upper({0})"),
    "trim": _trim("BOTH"),
    "ltrim": _trim("LEADING"),
    "rtrim": _trim("TRAILING"),
    "concat": _concat,
    "replace": _one("replace({0}, {1}, {2})", 3),
    "regexp_replace": _regexp_replace,
    "regex_replace": _regexp_replace,
    "starts_with": _one("startswith({0}, {1})", 2),
    "ends_with": _one("endswith({0}, {1})", 2),
    "contains": _one("contains({0}, {1})", 2),
    "coalesce": lambda args, kind: f"coalesce({', '.join(args)})",
    "nullif": _one("CASE WHEN {0} = {1} THEN NULL ELSE {0} END", 2),
    "abs": _one("abs({0})"),
    "ceil": _whole("ceil"),
    "ceiling": _whole("ceil"),
    "floor": _whole("floor"),
    "round": _round,
    "date_part": _part,
    "datepart": _part,
    "year": lambda args, kind: _part(["'year'", *args], kind),
    "month": lambda args, kind: _part(["'month'", *args], kind),
    "day": lambda args, kind: _part(["'day'", *args], kind),
    "date_trunc": _trunc,
    "to_timestamp_seconds": _one("CAST(timestamp_seconds({0}) AS TIMESTAMP_NTZ)"),
}


def cast(text: str, target: str, kind: Kind) -> str:
    """A strict cast; what Spark lacks is spelled out."""
    if target == "UUID":
        low = f"lower(CAST({text} AS STRING))"
        return f"CASE WHEN {text} IS NULL OR {low} RLIKE '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$' THEN {low} ELSE raise_error(concat('not a UUID: ', {text})) END"
    if target == "DATE" and kind(text) in INTEGRAL:
        return f"date_from_unix_date(CAST({text} AS INT))"
    return f"CAST({text} AS {target})"


def unsigned(text: str) -> str:
    """A whole number of 64 bits without sign; others are errors."""
    return f"CASE WHEN {text} < 0 OR {text} > 18446744073709551615BD THEN CAST(raise_error(concat('not an unsigned number of 64 bits: ', {text})) AS DECIMAL(20,0)) ELSE {text} END"


def length_of(text: str, kind: str) -> str:
    """Seconds of an interval of whatever kind, for comparisons: a month is 30 days, a day 24 hours."""
    mixed = kind == "interval"
    if not mixed:
        whole = "YEAR TO MONTH" if "year" in kind or "month" in kind else "DAY TO SECOND"
        text = f"CAST({text} AS INTERVAL {whole})"
    part = lambda unit, factor: f"CAST(extract({unit}{'S' if mixed else ''} FROM {text}) AS DECIMAL(18,6)) * {factor}"
    months = [part("YEAR", 12 * 30 * 86400), part("MONTH", 30 * 86400)]
    clock = [part("DAY", 86400), part("HOUR", 3600), part("MINUTE", 60), part("SECOND", 1)]
    return f"({' + '.join([*months, *clock] if mixed else months if 'YEAR' in whole else clock)})"


def at_zone(text: str, zone: str, kind: Kind) -> str:
    """Local time in a zone to an instant, and back. A local time that the zone skips is an error; of two
    instants with the same local time the later is meant (for zones that shift by half an hour or an hour)."""
    if kind(text) == "timestamp":
        return f"CAST(from_utc_timestamp({text}, {zone}) AS TIMESTAMP_NTZ)"
    local = f"CAST({text} AS TIMESTAMP)"
    first = f"to_utc_timestamp({local}, {zone})"
    later = [f"({first} + INTERVAL '{m}' MINUTE)" for m in (60, 30)]
    return (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN from_utc_timestamp({first}, {zone}) <> {local} THEN CAST(raise_error(concat('no such local time: ', {text})) AS TIMESTAMP) "
        + "".join(f"WHEN from_utc_timestamp({x}, {zone}) = {local} THEN {x} " for x in later)
        + f"ELSE {first} END"
    )


_UNITS = {"year": ("m", 12), "month": ("m", 1), "week": ("d", 7), "day": ("d", 1), "hour": ("u", 3_600_000_000), "minute": ("u", 60_000_000), "second": ("u", 1_000_000), "millisecond": ("u", 1000), "microsecond": ("u", 1)}


def interval_parts(value: str, low: str | None, high: str | None) -> tuple[int, int, int]:
    """Months, days and microseconds of an interval literal."""
    got = {"m": 0, "d": 0, "u": 0}

    def add(number: str, unit: str) -> None:
        unit = {"min": "minute", "sec": "second", "hr": "hour", "mon": "month"}.get(unit.lower().rstrip("s"), unit.lower().rstrip("s"))
        if unit not in _UNITS:
            raise SqlError(f"unknown unit {unit} in an interval")
        key, factor = _UNITS[unit]
        whole = float(number) * factor
        if whole != int(whole):
            raise SqlError(f"{number} {unit} is no whole interval")
        got[key] += int(whole)

    if low and high:
        names = ["YEAR", "MONTH"] if low in ("YEAR", "MONTH") else ["DAY", "HOUR", "MINUTE", "SECOND"]
        names = names[names.index(low) : names.index(high) + 1]
        sign, digits = (-1, value[1:]) if value.strip().startswith("-") else (1, value)
        numbers = re.split(r"[-\s:]+", digits.strip())
        if len(numbers) != len(names):
            raise SqlError(f"interval {value!r} doesn't fit {low} TO {high}")
        for number, name in zip(numbers, names, strict=True):
            add(number, name.lower())
        return sign * got["m"], sign * got["d"], sign * got["u"]
    if low:
        add(value.strip(), low.lower())
    else:
        rest = value.strip()
        while rest:
            m = re.match(r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", rest)
            if m:
                add(m[1], m[2])
            elif m := re.match(r"(-?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?\s*", rest):
                for number, unit in zip(m.groups()[1:], ("hour", "minute", "second"), strict=True):
                    if number:
                        add(m[1] + number, unit)
            else:
                raise SqlError(f"can't read the interval {value!r}")
            rest = rest[m.end() :]
    return got["m"], got["d"], got["u"]


def interval(value: str, low: str | None, high: str | None) -> tuple[str, str]:
    """Spark text of an interval literal, and its class: ym, dt or mixed."""
    months, days, micros = interval_parts(value, low, high)
    if months and (days or micros):
        return f"make_interval(0, {months}, 0, {days}, 0, 0, CAST({micros} / 1000000.0D AS DECIMAL(18,6)))", "mixed"
    if months or (low in ("YEAR", "MONTH") and not days and not micros):
        return f"INTERVAL '{months}' MONTH", "ym"
    if not micros:
        return f"INTERVAL '{days}' DAY", "dt"
    sign = "-" if days * 86_400_000_000 + micros < 0 else ""
    total = abs(days * 86_400_000_000 + micros)
    d, rest = divmod(total, 86_400_000_000)
    h, rest = divmod(rest, 3_600_000_000)
    m, rest = divmod(rest, 60_000_000)
    return f"INTERVAL '{sign}{d} {h:02}:{m:02}:{rest // 1_000_000:02}.{rest % 1_000_000:06}' DAY TO SECOND", "dt"
