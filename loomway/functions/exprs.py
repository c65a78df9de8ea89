"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four ASCII separators.
_WS = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)\A{_WS}++|(?<!{_WS}){_WS}++\z"

MIN_LONG, MAX_LONG = -(2**63), 2**63 - 1


def strip_ws(c: Column) -> Column:
    """`c` without white space around it (any Unicode white space, linear in the text's length)."""
    return F.when(c.rlike(rf"(?U)\A{_WS}|{_WS}\z"), F.regexp_replace(c, _EDGES, "")).otherwise(c)


def norm_key(c: Column) -> Column:
    """A key without white space around it and without case; null where nothing is left."""
    k = F.lower(strip_ws(c))
    return F.when(k != "", k)


def finite(c: Column) -> Column:
    """True where `c` is a finite number; null and NaN give false."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def let(x: Column, f) -> Column:
    """f of x, where x stands once in the plan and is evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def micros(c: Column) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def code_map(c: Column, mapping: dict, default=None) -> Column:
    """CASE over equal values; unknown and null give `default`."""
    out = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def drawn_below(key: str, share: float) -> Column:
    """Whether a key belongs to a stable sample of a share of all keys, by the first digits of its MD5."""
    return F.substring(F.md5(F.col(key)), 1, 8) < F.lit(f"{round(share * 16**8):08x}")


def drawn_below_sql(key: str, share: float) -> str:
    return f"substr(md5({key}), 1, 8) < '{round(share * 16**8):08x}'"


def looked_up(c: Column, mapping: dict, what: str = "code") -> Column:
    """Entry of a code; null for null. A code without an entry is an error."""
    known = code_map(c, mapping)
    return F.when(c.isNotNull() & known.isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), c.cast("string")))).otherwise(known)


def clock_minutes(c: Column) -> Column:
    """Minutes since 00:00 of H:MM, HH:MM or HH:MM:SS with hours 0-23, minutes and seconds 0-59; else null."""
    ok = c.rlike(r"\A([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?\z")
    parts = F.split(c, ":")
    return F.when(ok, F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int"))


def clock_seconds(c: Column) -> Column:
    """Seconds since 00:00 of a clock text, null where it can't be read."""
    parts = F.split(c, ":")
    return clock_minutes(c) * 60 + F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0))


def iso_weekday(c: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c) + 1
