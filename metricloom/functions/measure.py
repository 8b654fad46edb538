"""The 41 functions of measures: name -> builder over scalar Columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .column import date_add as _date_add
from .column import date_diff, divide, finite, mean, num, stamp


def fold(f):
    return lambda *xs: functools.reduce(f, map(num, xs))


def pairwise(f):
    """A two-argument function over more arguments folds from the left."""
    return lambda *xs: functools.reduce(f, xs)


def growth(cur: Column, prev: Column) -> Column:
    return F.try_divide(num(cur) - num(prev), num(prev))


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    v, lo, hi = num(v), num(lo), num(hi)
    return F.when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(v, lo), hi))


def label(v: Column, positive="Positive", negative="Negative", neutral="Neutral") -> Column:
    v = num(v)
    return F.when(v > 0, positive).when(v < 0, negative).when(v.isNotNull(), neutral)


def positive(f):
    """f over values that must all be above zero."""
    return lambda *xs: F.when(functools.reduce(operator.and_, [F.coalesce(num(x) > 0, F.lit(False)) for x in xs]), f([num(x) for x in xs]))


def total(xs):
    return functools.reduce(operator.add, xs)


def weighted(*xs: Column) -> Column:
    if len(xs) % 2:
        return F.lit(None).cast("double")
    pairs = [(num(v), num(w)) for v, w in zip(xs[::2], xs[1::2], strict=True)]
    ok = [v.isNotNull() & w.isNotNull() & (w != 0) for v, w in pairs]
    return F.try_divide(total(F.when(o, v * w).otherwise(0.0) for o, (v, w) in zip(ok, pairs, strict=True)), total(F.when(o, w).otherwise(0.0) for o, (_, w) in zip(ok, pairs, strict=True)))


def pick(f):
    return lambda *xs: f(*map(num, xs)) if len(xs) > 1 else num(xs[0])


def all_of(xs, test):
    return functools.reduce(operator.and_, map(test, xs)).cast("double")


def truth(c: Column) -> Column:
    return c.cast("double")


MEASURE_FUNCTIONS = {
    "growth_pct": growth,
    "divide": pairwise(divide),
    "percent": lambda a, b: divide(a, b) * 100,
    "sum": fold(operator.add),
    "subtract": fold(operator.sub),
    "multiply": fold(operator.mul),
    "min": pick(F.least),
    "max": pick(F.greatest),
    "avg": mean,
    "abs": lambda v: F.abs(num(v)),
    "clamp": clamp,
    "attainment": lambda a, t: divide(a, t) * 100,
    "coalesce": lambda *xs: F.coalesce(*xs),
    "if_null": lambda v, other: F.coalesce(v, other),
    "nullif": lambda v, s: F.nullif(num(v), num(s)),
    "null_if_zero": lambda v: F.nullif(num(v), F.lit(0.0)),
    "zero_if_null": lambda v: F.coalesce(num(v), F.lit(0.0)),
    "is_null": lambda v: truth(v.isNull()),
    "is_not_null": lambda v: truth(v.isNotNull()),
    "if_else": lambda c, a, b: F.when(c.isNotNull() & (num(c) != 0), a).otherwise(b),
    "sign_label": label,
    "round": lambda v, decimals=0: F.bround(num(v), int(decimals)),
    "floor": lambda v: F.floor(num(v)).cast("double"),
    "ceil": lambda v: F.ceil(num(v)).cast("double"),
    "power": lambda a, b: finite(F.pow(num(a), num(b))),
    "log": lambda v: F.when(num(v) > 0, F.ln(num(v))),
    "log10": lambda v: F.when(num(v) > 0, F.log10(num(v))),
    "sqrt": lambda v: F.when(num(v) >= 0, F.sqrt(num(v))),
    "date_diff": date_diff,
    "date_add": lambda v, n, unit="day": F.date_format(_date_add(v, n, unit), "yyyy-MM-dd"),
    "epoch_day": lambda v: F.unix_date(stamp(v).cast("date")).cast("double"),
    "geomean_scalars": positive(lambda xs: F.exp(total(map(F.ln, xs)) / len(xs))),
    "weighted_avg_scalars": weighted,
    "harmonic_mean": positive(lambda xs: len(xs) / total(1 / x for x in xs)),
    "min_max_spread": lambda *xs: pick(F.greatest)(*xs) - pick(F.least)(*xs),
    "ratio_safe": divide,
    "bps_change": lambda cur, prev: growth(cur, prev) * 10_000,
    "log_change": lambda cur, prev: F.when((num(cur) > 0) & (num(prev) > 0), F.ln(num(cur) / num(prev))),
    "if_between": lambda v, lo, hi: truth((num(v) >= num(lo)) & (num(v) <= num(hi))),
    "all_null": lambda *xs: all_of(xs, lambda x: x.isNull()),
    "any_null": lambda *xs: truth(~functools.reduce(operator.and_, [x.isNotNull() for x in xs])),
}
ALIASES = {"yoy": "growth_pct", "mom": "growth_pct", "percent_change": "growth_pct", "div": "divide", "ratio": "divide", "percent_of": "percent", "share": "percent", "add": "sum", "sub": "subtract", "mul": "multiply", "product": "multiply", "mean": "avg", "change_direction": "sign_label", "harmonic_mean_scalars": "harmonic_mean"}
MEASURE_FUNCTIONS |= {alias: MEASURE_FUNCTIONS[name] for alias, name in ALIASES.items()}
