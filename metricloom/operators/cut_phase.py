"""Analytic operators across the groups of a cut.

Windows run over aggregated groups, a row each; ``partition`` is empty for the
whole cut."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


class Cut:
    """Builds a cut operator's Column from its source, partition and order."""

    def __init__(self, source: Column, partition: list[Column], ties: list[Column], spec: dict):
        self.v, self.spec = source, spec
        self.all = Window.partitionBy(*partition)
        self.down = spec.get("order", "desc") == "desc"
        first = source.desc_nulls_last() if self.down else source.asc_nulls_last()
        self.by = self.all.orderBy(first, *[c for c in spec.get("order_by", [])])
        self.rows = self.all.orderBy(first, *ties)
        self.to_here = self.rows.rowsBetween(Window.unboundedPreceding, 0)

    def held(self, c: Column) -> Column:
        """Null where the source is."""
        return F.when(self.v.isNotNull(), c)

    def stat(self, name: str) -> Column:
        """A number of the whole partition: given, or by a window."""
        given = self.spec.get("stats")
        return given[name] if given else BUILDERS[name](self.v).over(self.all)

    def sum(self) -> Column:
        return self.stat("sum")

    def share_so_far(self) -> Column:
        return self.held(F.try_divide(F.sum(self.v).over(self.to_here) * 100, self.sum()))

    def rank(self, down: bool | None = None) -> Column:
        by = self.by if down is None else self.all.orderBy(self.v.desc_nulls_last() if down else self.v.asc_nulls_last())
        return self.held(F.rank().over(by)).cast("double")

    def count(self) -> Column:
        return F.count(self.v).over(self.all)


BUILDERS = {"sum": F.sum, "avg": F.avg, "max": F.max, "sd": F.stddev_samp, "squares": lambda v: F.sum(v * v), "largest": lambda v: F.max(F.abs(v))}
#: What operators need of the whole partition, and nothing of other groups.
STATS = {
    op: {n: BUILDERS[n] for n in names}
    for op, names in {"percent_of_total": ("sum",), "contribution": ("sum",), "gap_to_leader": ("max",), "gap_to_avg": ("avg",), "zscore": ("avg", "sd"), "concentration": ("sum", "squares"), "normalize": ("sum", "largest")}.items()
}


def _abc(c: Cut) -> Column:
    first = F.row_number().over(c.rows) == 1
    share = c.share_so_far()
    return c.held(F.when((share <= c.spec.get("a_share", 80)) | first, "A").when(share <= c.spec.get("b_share", 95), "B").otherwise("C"))


def _zscore(c: Cut) -> Column:
    sd = c.stat("sd")
    return F.when(sd == 0, c.held(F.lit(0.0))).otherwise((c.v - c.stat("avg")) / sd)


def _contribution(c: Cut) -> Column:
    total = c.spec.get("total")
    return F.try_divide(c.v * 100, total if total is not None else c.sum())


CUT_OPS = {
    "rank": lambda c: c.rank(),
    "percent_of_total": _contribution,
    "ntile": lambda c: F.ceil(c.rank() * c.spec["tiles"] / c.count()).cast("double"),
    "dense_rank": lambda c: c.held(F.dense_rank().over(c.by)).cast("double"),
    "row_number": lambda c: F.row_number().over(c.rows).cast("double"),
    "cumulative_share": lambda c: c.share_so_far(),
    "running_total": lambda c: c.held(F.sum(c.v).over(c.to_here)),
    "contribution": _contribution,
    "percent_rank": lambda c: F.when(c.count() == 1, c.held(F.lit(0.0))).otherwise((c.rank() - 1) * 100 / F.nullif(c.count() - 1, F.lit(0))),
    "gap_to_leader": lambda c: c.v - c.stat("max"),
    "gap_to_avg": lambda c: c.v - c.stat("avg"),
    "zscore": _zscore,
    "running_avg": lambda c: c.held(F.avg(c.v).over(c.to_here)),
    "top_n": lambda c: F.when(F.coalesce(c.rank() <= c.spec["n"], F.lit(False)), 1.0).otherwise(0.0),
    "bottom_n": lambda c: F.when(F.coalesce(c.rank(down=False) <= c.spec["n"], F.lit(False)), 1.0).otherwise(0.0),
    "rank_pct_change": lambda c: c.rank(),
    # sum of squared shares without a window in a window
    "concentration": lambda c: F.try_divide(c.stat("squares"), c.sum() * c.sum()),
    "abc_class": _abc,
    "pareto_flag": lambda c: c.held(F.when((c.share_so_far() <= c.spec.get("share", 80)) | (F.row_number().over(c.rows) == 1), 1.0).otherwise(0.0)),
    "normalize": lambda c: F.try_divide(c.v, c.sum() if c.spec.get("method", "max") == "sum" else c.stat("largest")),
}
