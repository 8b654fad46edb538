"""The 36 series statistics.

A series is an array of (p, v), one for each observed period of the window, the
oldest first; its length is bounded by the window, so higher-order functions do
the work inside the group's row.  ``ctx`` has: anchor, grain, n (window length
in periods), value, and a hook's own extras."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError
from ..plans.calendar import PER_YEAR


@dataclass(frozen=True)
class Context:
    anchor: date
    grain: str
    n: int
    value: float | None = None
    extras: dict = field(default_factory=dict)
    periods: tuple[date, ...] = ()

    def get(self, name: str, default: float) -> float:
        return float(self.extras.get(name, default))


def values(s: Column) -> Column:
    return F.transform(s, lambda x: x["v"])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def size(v: Column) -> Column:
    return F.size(v).cast("double")


def mean(v: Column) -> Column:
    return F.try_divide(total(v), size(v))


def last(v: Column) -> Column:
    return F.try_element_at(v, F.lit(-1))


def first(v: Column) -> Column:
    return F.try_element_at(v, F.lit(1))


def variance(v: Column) -> Column:
    squares = F.aggregate(v, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"), (a["s"] + (x - a["m"]) * (x - a["m"]) * a["n"] / (a["n"] + 1)).alias("s")), lambda a: a["s"])
    return F.when(F.size(v) > 1, squares / (size(v) - 1))


def stdev(v: Column) -> Column:
    return F.sqrt(variance(v))


def median(v: Column) -> Column:
    o = F.sort_array(v)
    n = F.size(v)
    low, high = F.get(o, F.floor((n - 1) / 2).cast("int")), F.get(o, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def indexed(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("v")))


def slope(v: Column) -> Column:
    n, mid = size(v), (size(v) - 1) / 2
    up = F.aggregate(indexed(v), F.lit(0.0), lambda a, x: a + (x["i"] - mid) * x["v"])
    return F.when(F.size(v) > 1, up / (n * (n * n - 1) / 12))


def ewma(v: Column, alpha: float) -> Column:
    rest = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    return F.aggregate(rest, first(v), lambda a, x: alpha * x + (1 - alpha) * a)


def share(s: Column, test) -> Column:
    return F.try_divide(F.size(F.filter(values(s), test)).cast("double"), size(s)) * 100


def needed(ctx: Context) -> float:
    if ctx.value is None:
        raise BindError("the hook needs value:")
    return float(ctx.value)


def run(s: Column, ctx: Context, test) -> Column:
    """Periods in a row that end at the anchor and pass; null if the anchor is
    unobserved, and an unobserved period ends the run."""
    by_period = F.map_from_entries(s)
    back = [F.try_element_at(by_period, F.lit(p)) for p in reversed(ctx.periods)]
    count = F.aggregate(F.array(*back), F.struct(F.lit(0.0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & F.coalesce(test(x), F.lit(False)), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & F.coalesce(test(x), F.lit(False))).alias("on")), lambda a: a["n"])
    return F.when(back[0].isNotNull(), count)


def longest(s: Column, bar: float) -> Column:
    return F.aggregate(values(s), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("best")), lambda a, x: F.struct(F.when(x >= bar, a["n"] + 1).otherwise(0.0).alias("n"), F.greatest(a["best"], F.when(x >= bar, a["n"] + 1).otherwise(0.0)).alias("best")), lambda a: a["best"])


def at_anchor(s: Column, ctx: Context) -> Column:
    return F.try_element_at(F.map_from_entries(s), F.lit(ctx.anchor))


def same_month(s: Column, ctx: Context, before: bool) -> Column:
    fits = F.filter(s, lambda x: (F.month(x["p"]) == ctx.anchor.month) & ((x["p"] < F.lit(ctx.anchor)) if before else F.lit(True)))
    return mean(values(fits))


def cagr(s: Column, ctx: Context) -> Column:
    a, b = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))
    if ctx.grain in ("day", "week"):
        gap = F.date_diff(b["p"], a["p"]) / (7 if ctx.grain == "week" else 1)
    else:
        gap = ((F.year(b["p"]) - F.year(a["p"])) * 12 + F.month(b["p"]) - F.month(a["p"])) / {"month": 1, "quarter": 3, "year": 12}[ctx.grain]
    years = gap / PER_YEAR[ctx.grain]
    return F.when((a["v"] > 0) & (b["v"] > 0) & (years > 0), F.pow(b["v"] / a["v"], 1 / years) - 1)


def autocorrelation(v: Column) -> Column:
    n = F.size(v)
    a, b = F.slice(v, 1, F.greatest(n - 1, F.lit(0))), F.slice(v, 2, F.greatest(n - 1, F.lit(0)))
    ma, mb = mean(a), mean(b)
    dev = lambda x, m: F.transform(x, lambda y: y - m)
    cross = total(F.zip_with(dev(a, ma), dev(b, mb), lambda x, y: x * y))
    sq = lambda x, m: total(F.transform(x, lambda y: (y - m) * (y - m)))
    return F.when(n >= 3, F.try_divide(cross, F.sqrt(sq(a, ma) * sq(b, mb))))


def changes(v: Column) -> Column:
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), lambda x, y: x - y)


def rsi(v: Column, n: int) -> Column:
    d = changes(v)
    d = F.slice(d, F.greatest(F.size(d) - n, F.lit(0)) + 1, F.lit(n))
    gain, loss = total(F.transform(d, lambda x: F.greatest(x, F.lit(0.0)))), total(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))))
    return F.when(F.size(v) > 2, F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + gain / loss)))


def decay_sum(v: Column, decay: float) -> Column:
    n = F.size(v)
    return F.when(n > 0, total(F.transform(v, lambda x, i: x * F.pow(F.lit(decay), (n - 1 - i).cast("double")))))


def theil_sen(v: Column) -> Column:
    pairs = F.flatten(F.transform(indexed(v), lambda a: F.transform(F.filter(indexed(v), lambda b: b["i"] > a["i"]), lambda b: (b["v"] - a["v"]) / (b["i"] - a["i"]))))
    return F.when(F.size(v) > 1, median(pairs))


def changepoint(v: Column) -> Column:
    """The split 1 .. n-1 with the largest gap between both sides' means; the
    first among equals."""
    n = F.size(v)
    gap = lambda k: F.abs(mean(F.slice(v, F.lit(1), k)) - mean(F.slice(v, k + 1, n - k)))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), gap)
    return F.when(n >= 3, F.array_position(gaps, F.array_max(gaps)).cast("double"))


def projection(v: Column, ahead: float) -> Column:
    return last(v) + slope(v) * ahead


def confidence(v: Column, ctx: Context) -> Column:
    side = -1.0 if ctx.extras.get("side", "high") == "low" else 1.0
    return projection(v, ctx.get("periods_ahead", 1)) + side * ctx.get("k", 1.96) * stdev(v)


def bollinger(v: Column, k: float) -> Column:
    return F.try_divide(last(v) - (mean(v) - k * stdev(v)), 2 * k * stdev(v))


def rank_in_series(v: Column) -> Column:
    x = last(v)
    below, equal = F.size(F.filter(v, lambda y: y < x)), F.size(F.filter(v, lambda y: y == x))
    return F.try_divide((below + 0.5 * equal).cast("double"), size(v)) * 100


def outliers(v: Column, k: float) -> Column:
    m, sd = mean(v), stdev(v)
    return F.when(F.size(v) > 1, F.when(sd == 0, 0.0).otherwise(size(F.filter(v, lambda x: F.abs((x - m) / sd) > k))))


HOOKS = {
    "seasonal_index": lambda s, c: F.try_divide(at_anchor(s, c), same_month(s, c, True)),
    "ewma": lambda s, c: ewma(values(s), 2 / (c.n + 1)),
    "period_max": lambda s, c: F.array_max(values(s)),
    "period_min": lambda s, c: F.array_min(values(s)),
    "period_median": lambda s, c: median(values(s)),
    "period_avg": lambda s, c: mean(values(s)),
    "period_sum": lambda s, c: F.when(F.size(s) > 0, total(values(s))),
    "hit_rate": lambda s, c: share(s, lambda v: v >= needed(c)),
    "streak": lambda s, c: run(s, c, lambda v: v >= needed(c)),
    "period_stdev": lambda s, c: stdev(values(s)),
    "period_var": lambda s, c: variance(values(s)),
    "period_cv": lambda s, c: F.try_divide(stdev(values(s)), mean(values(s))) * 100,
    "period_range": lambda s, c: F.array_max(values(s)) - F.array_min(values(s)),
    "period_count": lambda s, c: size(s),
    "miss_rate": lambda s, c: share(s, lambda v: v < needed(c)),
    "miss_streak": lambda s, c: run(s, c, lambda v: v < needed(c)),
    "longest_streak": lambda s, c: longest(s, needed(c)),
    "cagr": cagr,
    "slope": lambda s, c: slope(values(s)),
    "mad": lambda s, c: median(F.transform(values(s), lambda x: F.abs(x - median(values(s))))),
    "projection": lambda s, c: projection(values(s), c.get("periods_ahead", 1)),
    "autocorrelation": lambda s, c: autocorrelation(values(s)),
    "rsi": lambda s, c: rsi(values(s), int(c.get("n", c.n or 14))),
    "bollinger": lambda s, c: bollinger(values(s), c.get("k", 2)),
    "exponential_decay_sum": lambda s, c: decay_sum(values(s), c.get("decay", 0.5)),
    "theil_sen_slope": lambda s, c: theil_sen(values(s)),
    "changepoint": lambda s, c: changepoint(values(s)),
    "outlier_count": lambda s, c: outliers(values(s), c.get("k", 3)),
    "percentile_rank_series": lambda s, c: rank_in_series(values(s)),
    "weighted_ewma": lambda s, c: ewma(values(s), c.get("alpha", 2 / (c.n + 1))),
    "run_rate": lambda s, c: last(values(s)) * PER_YEAR[c.grain],
    "target_trajectory": lambda s, c: F.try_divide(last(values(s)), F.when(F.size(s) > 1, F.lit(needed(c)))),
    "forecast_confidence": lambda s, c: confidence(values(s), c),
    "seasonal_decompose": lambda s, c: F.try_divide(same_month(s, c, False), mean(values(s))),
}
#: These two read entities of detail rows and are planned by the engine.
COHORT_HOOKS = ("cohort_retention", "survival_rate")
