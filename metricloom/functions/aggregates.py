"""The 20 aggregations as aggregate Columns of a (conditional) value.

ADDITIVE ones fold from per-period partials; AVERAGES carry a sum and a count;
the rest read detail rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError

LIST_ITEMS, STRING_BYTES = 1_000, 65_536
ADDITIVE = ("sum", "count", "min", "max")
ZERO_WHEN_EMPTY = ("sum", "count")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _percentile(p: float) -> float:
    return p / 100 if p > 1 else p


def _listed(v: Column, order: Column) -> Column:
    items = F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v"))))
    return F.transform(F.sort_array(items), lambda s: s["v"])


def _guard(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)))


def aggregate(name: str, value: Column, when: Column | None = None, *, order: Column | None = None, weight: Column | None = None, percentile: float = 0.5) -> Column:
    """Aggregates ``value`` over rows where ``when`` holds.  order: event time
    for first, last and lists; weight: for weighted_avg."""
    text = name in ("count", "count_distinct", "list_agg", "string_agg", "min", "max", "first", "last")
    v = value if text else _number(value)
    held = v if when is None else F.when(when, v)
    order = order if order is not None else F.lit(0)
    positive = F.when(held > 0, held) if not text else None
    if name == "sum":
        return F.sum(held)
    if name == "count":
        return F.count(held).cast("double")
    if name in ("min", "max"):
        return F.min(held) if name == "min" else F.max(held)
    if name == "avg":
        return F.avg(held)
    if name == "weighted_avg":
        w = _number(weight)
        ok = held.isNotNull() & w.isNotNull() & (w != 0)
        return F.try_divide(F.sum(F.when(ok, held * w)), F.sum(F.when(ok, w)))
    if name == "count_distinct":
        return F.when(F.count(F.lit(1) if when is None else F.when(when, 1)) > 0, F.countDistinct(held).cast("double"))
    if name == "median":
        return F.median(held)
    if name == "percentile":
        return F.percentile(held, F.lit(_percentile(percentile)))
    if name in ("first", "last"):
        key = F.struct(order, held) if when is None else F.when(when, F.struct(order, held))
        return (F.min_by if name == "first" else F.max_by)(held, key)
    if name in ("stddev", "variance"):
        return F.stddev_samp(held) if name == "stddev" else F.var_samp(held)
    if name == "mode":
        return F.mode(held, True)
    if name == "geomean":
        return F.exp(F.avg(F.ln(positive)))
    if name == "harmonic_mean":
        return F.try_divide(F.count(positive).cast("double"), F.sum(1 / positive))
    if name in ("any", "all"):
        return (F.bool_or if name == "any" else F.bool_and)(held != 0).cast("double")
    if name == "list_agg":
        return _guard(F.count(held) <= LIST_ITEMS, _listed(held, order), f"list_agg over {LIST_ITEMS} items")
    if name == "string_agg":
        joined = F.array_join(_listed(held.cast("string"), order), ",")
        return _guard(F.sum(F.octet_length(held.cast("string")) + 1) <= STRING_BYTES + 1, joined, f"string_agg over {STRING_BYTES} bytes")
    raise BindError(f"no aggregation {name!r}")


AGGREGATIONS = ("sum", "count", "min", "max", "avg", "weighted_avg", "count_distinct", "median", "percentile", "first", "last", "stddev", "variance", "mode", "geomean", "harmonic_mean", "any", "all", "list_agg", "string_agg")
