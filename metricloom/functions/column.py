"""The 46 row-level functions: name -> builder of a Column from Columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats tried in turn where text is read as a date.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd")


def num(c: Column) -> Column:
    return c.try_cast("double")


def stamp(c: Column) -> Column:
    """A timestamp from a date, a timestamp or text."""
    text = c.cast("string")
    # the plain cast reads ISO forms, dates and timestamps among them, fastest
    return F.coalesce(F.when(F.length(text) >= 10, text.try_cast("timestamp")), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS], text.try_cast("timestamp"))


def fold(f):
    return lambda *cols: functools.reduce(f, map(num, cols))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(num(a), num(b))


def mean(*cols: Column) -> Column:
    cols = [num(c) for c in cols]
    total = functools.reduce(operator.add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.try_divide(total, functools.reduce(operator.add, [c.isNotNull().cast("int") for c in cols]))


def pick(f):
    return lambda *cols: f(*map(num, cols)) if len(cols) > 1 else num(cols[0])


def python_slice(c: Column, start: int, end: int | None) -> Column:
    """Characters [start:end] as Python takes them."""
    n = F.length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.lit(end) if end >= 0 else n + end
    return F.when(c.isNotNull(), F.substring(c, a + 1, F.greatest(b - a, F.lit(0))))


def _int(v) -> int:
    return int(v)


def substring(c: Column, start=0, length=None) -> Column:
    start = _int(start)
    return python_slice(c.cast("string"), start, None if length is None else start + _int(length) if start >= 0 or start + _int(length) < 0 else None)


def left(c: Column, n=1) -> Column:
    return python_slice(c.cast("string"), 0, _int(n))


def right(c: Column, n=1) -> Column:
    n = _int(n)
    return python_slice(c.cast("string"), -n, None)  # n = 0 is the whole text


def replace(c: Column, old, new) -> Column:
    return F.replace(c.cast("string"), old if isinstance(old, Column) else F.lit(old), new if isinstance(new, Column) else F.lit(new))


def rounded(c: Column, decimals=0) -> Column:
    """Half to even."""
    return F.bround(num(c), _int(decimals or 0))


def date_diff(a: Column, b: Column, unit: str = "day") -> Column:
    a, b = stamp(a), stamp(b)
    days = F.floor((F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000)
    if unit in ("day", "week"):
        return (days if unit == "day" else F.floor(days / 7)).cast("double")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return (months if unit == "month" else F.year(b) - F.year(a)).cast("double")


def date_add(c: Column, n, unit: str = "day") -> Column:
    n = n.cast("int") if isinstance(n, Column) else F.lit(int(n))
    if unit in ("day", "week"):
        return stamp(c) + F.make_dt_interval(n * (7 if unit == "week" else 1))
    return stamp(c) + F.make_ym_interval(n if unit == "year" else F.lit(0), F.lit(0) if unit == "year" else n)


def clip(v: Column, lo: Column, hi: Column) -> Column:
    v = num(v)
    return F.when(v.isNotNull(), F.least(F.greatest(v, num(lo)), num(hi)))


def between_dates(v: Column, lo: Column, hi: Column) -> Column:
    return flag(stamp(v).between(stamp(lo), stamp(hi)))


def in_set(v: Column, *members) -> Column:
    members = [(m if isinstance(m, Column) else F.lit(m)).cast("string") for m in members]
    hit = functools.reduce(operator.or_, [F.coalesce(v.cast("string") == m, F.lit(False)) for m in members])
    return F.when(v.isNotNull(), hit.cast("double"))


COLUMN_FUNCTIONS = {
    "value": lambda c: c,
    "abs": lambda c: F.abs(num(c)),
    "sum": fold(operator.add),
    "subtract": fold(operator.sub),
    "multiply": fold(operator.mul),
    "divide": divide,
    "percent_of": lambda a, b: divide(a, b) * 100,
    "min": pick(F.least),
    "max": pick(F.greatest),
    "avg": mean,
    "coalesce": lambda *c: F.coalesce(*c),
    "if_null": lambda v, other: F.coalesce(v, other),
    "nullif": lambda v, s: F.nullif(num(v), num(s)),
    "null_if_zero": lambda v: F.nullif(num(v), F.lit(0.0)),
    "zero_if_null": lambda v: F.coalesce(num(v), F.lit(0.0)),
    "is_null": lambda v: v.isNull().cast("double"),
    "is_not_null": lambda v: v.isNotNull().cast("double"),
    "if_else": lambda c, a, b: F.when(c.isNotNull() & (num(c) != 0), a).otherwise(b),
    "round": rounded,
    "floor": lambda c: F.floor(num(c)).cast("double"),
    "ceil": lambda c: F.ceil(num(c)).cast("double"),
    "power": lambda a, b: finite(F.pow(num(a), num(b))),
    "log": lambda c: F.when(num(c) > 0, F.ln(num(c))),
    "log10": lambda c: F.when(num(c) > 0, F.log10(num(c))),
    "sqrt": lambda c: F.when(num(c) >= 0, F.sqrt(num(c))),
    "date_diff": date_diff,
    "date_add": date_add,
    "epoch_day": lambda c: F.unix_date(stamp(c).cast("date")).cast("double"),
    "weighted_product": fold(operator.mul),
    "safe_divide": divide,
    "clip": clip,
    "parse_date": stamp,
    "parse_number": num,
    "trim": lambda c: F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""),
    "upper": lambda c: F.upper(c.cast("string")),
    "lower": lambda c: F.lower(c.cast("string")),
    "substring": substring,
    "left": left,
    "right": right,
    "replace": replace,
    "concat": lambda *c: F.concat_ws("", *[x.cast("string") for x in c]),
    # the first 32 bits of the text's MD5, which any SQL engine can repeat
    "hash_bucket": lambda c, n=10: F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(max(_int(n), 1))).cast("double"),
    "json_extract": lambda c, path: F.get_json_object(c.cast("string"), path if path.startswith("$") else f"$.{path}"),
    "coalesce_date": lambda *c: F.coalesce(*map(stamp, c)),
    "is_between_dates": between_dates,
    "flag_in_set": in_set,
}
ALIASES = {"identity": "value", "add": "sum", "sub": "subtract", "mul": "multiply", "product": "multiply", "div": "divide", "ratio": "divide", "share": "percent_of", "mean": "avg"}
COLUMN_FUNCTIONS |= {alias: COLUMN_FUNCTIONS[name] for alias, name in ALIASES.items()}
