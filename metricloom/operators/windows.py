"""Entity windows over detail rows (``over:``)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import BindError


def entity_window(fn: str, of: Column | None, partition_by: list[Column], order_by: list[Column], n: int = 1) -> Column:
    """row_number, rank, dense_rank (of ascending ``of`` values; null keeps
    null), lag, lead, running_sum (null rows stay null), running_avg, last_n."""
    base = Window.partitionBy(*partition_by)
    w = base.orderBy(*[c.asc_nulls_last() for c in order_by])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if fn == "row_number" or (fn in ("rank", "dense_rank") and of is None):
        return F.row_number().over(w).cast("double")
    if fn in ("rank", "dense_rank"):
        by = base.orderBy(of.asc_nulls_last())
        return F.when(of.isNotNull(), (F.rank() if fn == "rank" else F.dense_rank()).over(by)).cast("double")
    if fn in ("lag", "lead"):
        return (F.lag if fn == "lag" else F.lead)(of, n).over(w)
    if fn == "running_sum":
        return F.when(of.isNotNull(), F.sum(of).over(so_far))
    if fn == "running_avg":
        return F.avg(of).over(so_far)
    if fn == "last_n":
        return F.transform(F.collect_list(F.struct(of.alias("v"))).over(w.rowsBetween(-(n - 1), 0)), lambda s: s["v"])
    raise BindError(f"no entity window {fn!r}")


ENTITY_WINDOWS = ("row_number", "rank", "dense_rank", "lag", "lead", "running_sum", "running_avg", "last_n")
