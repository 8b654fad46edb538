"""One query per operator over the benchmark tables, with equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import compute_df
from .functions.column import COLUMN_FUNCTIONS
from .functions.measure import MEASURE_FUNCTIONS
from .operators.filters import predicate
from .operators.windows import entity_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ANCHOR = "1998-06"
MODEL = {"kind": "physical", "sources": {"lineitem": {}}, "joins": []}
BASES = {
    "qty": {"sql": "l_quantity", "agg": "sum"},
    "n": {"sql": "l_quantity", "agg": "count"},
    "price": {"sql": "l_extendedprice", "agg": "sum"},
}


def context(sf_dir: str, keys: list[str], tables: tuple[str, ...] = ("lineitem",), month=ANCHOR, filters: dict | None = None, **more) -> dict:
    return {
        "execution": {"kpi_id": 1, "view_details": [{"view_id": 1, "measures_required": [{"measure_key": k} for k in keys]}]},
        "filters": ({"month": {"value": [month]}} if month else {}) | (filters or {}),
        "datasets": {t: {"alias": t, "path": f"{sf_dir}/{t}.parquet"} for t in tables},
        **more,
    }


def metric(spark: SparkSession, sf_dir: str, measures: dict, keys: list[str], dims=("l_returnflag",), bases: dict | None = None, **kpi) -> DataFrame:
    """Requested measures by ``dims`` over lineitem months."""
    spec = {"kpi_id": 1, "time": {"column": "l_shipdate", "grain": "month", "filter_code": "month"}, "dimensions": [{"name": d} for d in dims], "base_measures": BASES | (bases or {}), "measures": measures, **kpi}
    month = kpi.pop("month", ANCHOR)
    return compute_df(context(sf_dir, keys, month=month), spark=spark, kpi=spec, model=MODEL)


def flat(c: Column, kind: str) -> Column:
    return F.round(c.cast("double"), 6) if kind != "string" else c


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


# -- measure operators over months ---------------------------------------

MONTHLY = "WITH m AS (SELECT l_returnflag AS g, CAST(date_trunc('month', l_shipdate) AS DATE) AS p, sum(l_quantity) AS qty, CAST(count(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)"


def P(month: str, col: str = "qty") -> str:
    return f"sum(CASE WHEN p = DATE '{month}-01' THEN {col} END)"


def W(a: str, b: str, col: str = "qty") -> str:
    return f"coalesce(sum(CASE WHEN p BETWEEN DATE '{a}-01' AND DATE '{b}-01' THEN {col} END), 0)"


NOW, AGO, YEAR = P("1998-06"), P("1998-05"), P("1997-06")
CURRENT = {"cur": {"of": "qty", "op": "point"}, "old": {"of": "qty", "op": "point", "offset": {"years": 1}}, "cnt": {"of": "n", "op": "point"}, "three": {"of": "qty", "op": "window", "trailing": {"months": 3}}}
#: name: (measure, SQL value), or (measure, SQL value, further measures)
MEASURES: dict[str, tuple] = {
    "op_point": ({"of": "qty", "op": "point"}, NOW),
    "op_point_offset": ({"of": "qty", "op": "point", "offset": {"years": 1}}, YEAR),
    "op_window": ({"of": "qty", "op": "window", "trailing": {"months": 3}}, W("1998-04", "1998-06")),
    "op_arithmetic": ({"op": "arithmetic", "fn": "growth_pct", "left": "cur", "right": "old"}, f"({NOW} - {YEAR}) / {YEAR}"),
    "op_fn": ({"op": "fn", "fn": "percent", "inputs": ["cur", "three"]}, f"{NOW} / {W('1998-04', '1998-06')} * 100"),
    "op_expr": ({"op": "expr", "expr": "case when cur > old then (cur - old) / cnt else 0 end"}, f"CASE WHEN {NOW} > {YEAR} THEN ({NOW} - {YEAR}) / {P('1998-06', 'n')} ELSE 0 END"),
    "op_constant": ({"op": "constant", "value": {"A": 1, "R": 2}, "by": "l_returnflag", "default": 9}, "CASE g WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 9 END"),
    "op_predicate": ({"op": "predicate", "predicates": [{"of": "cur", "cmp": ">", "vs": "old"}, {"of": "cnt", "cmp": "between", "low": 1, "high": 1000000}]}, f"CASE WHEN {NOW} > {YEAR} AND {P('1998-06', 'n')} BETWEEN 1 AND 1000000 THEN 1 ELSE 0 END"),
    "op_expanding_window": ({"of": "qty", "op": "expanding_window"}, W("1998-01", "1998-06")),
    "op_rate": ({"of": "qty", "op": "rate", "vs": "n"}, f"{NOW} / {P('1998-06', 'n')}"),
    "op_cumulative_point": ({"of": "qty", "op": "cumulative_point"}, W("1998-01", "1998-06")),
    "op_n_period_avg": ({"of": "qty", "op": "n_period_avg", "trailing": {"months": 4}}, "avg(CASE WHEN p BETWEEN DATE '1998-03-01' AND DATE '1998-06-01' THEN qty END)"),
    "op_weighted_window": ({"of": "qty", "op": "weighted_window", "weight": "n", "trailing": {"months": 3}}, f"{W('1998-04', '1998-06', 'qty * n')} / {W('1998-04', '1998-06', 'n')}"),
    "op_snapshot_compare": ({"of": "cur", "op": "snapshot_compare", "vs": "three"}, f"({NOW} - {W('1998-04', '1998-06')}) / {W('1998-04', '1998-06')}"),
    "op_lag": ({"of": "qty", "op": "lag", "offset": {"months": 1}}, AGO),
    "op_lead": ({"of": "qty", "op": "lead", "offset": {"months": 2}}, P("1998-08")),
    "op_index": ({"of": "qty", "op": "index", "offset": {"years": 1}}, f"{NOW} * 100 / {YEAR}"),
    "op_vs_target": ({"of": "cur", "op": "vs_target", "value": 1000, "as": "pct"}, f"({NOW} - 1000) * 100 / 1000"),
    "op_threshold": ({"of": "cur", "op": "threshold", "cmp": ">=", "vs": "old"}, f"CASE WHEN {NOW} >= {YEAR} THEN 1 ELSE 0 END"),
    "op_diff": ({"of": "three", "op": "diff", "offset": {"years": 1}}, f"{W('1998-04', '1998-06')} - {W('1997-04', '1997-06')}"),
    "op_pct_change": ({"of": "qty", "op": "pct_change", "offset": {"months": 1}}, f"({NOW} - {AGO}) / {AGO}"),
    "op_compare": ({"of": "cur", "op": "compare", "mode": "yoy"}, f"({NOW} - {YEAR}) / {YEAR}"),
    "op_annualize": ({"of": "three", "op": "annualize", "n": 3}, f"{W('1998-04', '1998-06')} * 12 / 3"),
    "op_vs_prior_window": ({"of": "qty", "op": "vs_prior_window", "trailing": {"months": 3}, "offset": {"years": 1}}, f"({W('1998-04', '1998-06')} - {W('1997-04', '1997-06')}) / {W('1997-04', '1997-06')}"),
    "op_delta_contribution": ({"of": "cur", "op": "delta_contribution", "vs": "old"}, f"{NOW} - {YEAR}"),
    "op_baseline_index": ({"of": "cur", "op": "baseline_index", "vs": "old"}, f"{NOW} / {YEAR} * 100"),
    "op_compound_growth": ({"of": "cur", "op": "compound_growth", "n": 6}, f"pow({NOW} / {P('1997-12')}, 1.0 / 6) - 1"),
    "op_seasonal_adjust": ({"of": "qty", "op": "seasonal_adjust", "trailing": {"months": 25}}, f"{NOW} * avg(CASE WHEN p BETWEEN DATE '1996-06-01' AND DATE '1998-06-01' THEN qty END) / avg(CASE WHEN p BETWEEN DATE '1996-06-01' AND DATE '1998-06-01' AND month(p) = 6 THEN qty END)"),
    "op_filtered_point": ({"op": "filtered_point", "of": "n", "where": {"column": "l_linestatus", "op": "eq", "value": "O"}}, "(SELECT count(*) FROM lineitem WHERE l_returnflag = g AND l_linestatus = 'O' AND l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01')"),
    "op_filtered_window": ({"op": "filtered_window", "column": "l_quantity", "agg": "sum", "where": {"column": "l_linestatus", "op": "eq", "value": "F"}, "trailing": {"months": 2}}, "(SELECT coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_returnflag = g AND l_linestatus = 'F' AND l_shipdate >= DATE '1998-05-01' AND l_shipdate < DATE '1998-07-01')"),
    "op_filtered_compare": ({"op": "filtered_compare", "of": "qty", "mode": "yoy", "where": {"column": "l_linestatus", "op": "eq", "value": "F"}}, "(SELECT sum(CASE WHEN l_shipdate >= DATE '1998-06-01' THEN l_quantity END) / sum(CASE WHEN l_shipdate < DATE '1997-07-01' THEN l_quantity END) - 1 FROM lineitem WHERE l_returnflag = g AND l_linestatus = 'F' AND l_shipdate >= DATE '1997-06-01' AND l_shipdate < DATE '1998-07-01')"),
}
#: Window ranges: name: (window, first month, last month)
RANGES = {
    "trailing_inclusive": ({"trailing": {"months": 6}}, "1998-01", "1998-06"),
    "trailing_exclusive": ({"trailing": {"months": 6}, "inclusive": False}, "1997-12", "1998-05"),
    "trailing_quarters": ({"trailing": {"quarters": 2}}, "1998-01", "1998-06"),
    "trailing_offset": ({"trailing": {"months": 3}, "offset": {"years": 1}}, "1997-04", "1997-06"),
    "leading": ({"range": "leading", "trailing": {"months": 3}}, "1998-06", "1998-08"),
    "ytd": ({"range": "ytd"}, "1998-01", "1998-06"),
    "cumulative": ({"range": "cumulative"}, "1998-01", "1998-06"),
    "qtd": ({"range": "qtd"}, "1998-04", "1998-06"),
    "mtd": ({"range": "mtd"}, "1998-06", "1998-06"),
    "full_month": ({"range": "full_month"}, "1998-06", "1998-06"),
    "full_quarter": ({"range": "full_quarter"}, "1998-04", "1998-06"),
    "full_year": ({"range": "full_year"}, "1998-01", "1998-12"),
}
MEASURES |= {f"range_{k}": ({"of": "qty", "op": "window", **w}, W(a, b)) for k, (w, a, b) in RANGES.items()}


def _measure(spec: dict) -> Query:
    return lambda spark, d: metric(spark, d, CURRENT | {"value": spec}, ["value"]).select("l_returnflag", flat(F.col("value"), "double").alias("value"))


for _name, (_spec, _sql) in MEASURES.items():
    add(_name, _measure(_spec), f"{MONTHLY} SELECT g AS l_returnflag, round(CAST({_sql} AS DOUBLE), 6) AS value FROM m GROUP BY g")

for _op in ("band", "envelope"):
    add(f"op_{_op}", lambda s, d, o=_op: metric(s, d, CURRENT | {"value": {"op": o, "of": "cur", "low": 0.5, "high": 2}}, ["value"]).select("l_returnflag", "value_low", "value_high"), f"{MONTHLY} SELECT g AS l_returnflag, {NOW} * 0.5 AS value_low, {NOW} * 2.0 AS value_high FROM m GROUP BY g")
add("op_dimension", lambda s, d: metric(s, d, CURRENT | {"l_returnflag": {"kind": "dimension"}}, ["l_returnflag", "cur"]).select("l_returnflag", "cur"), f"{MONTHLY} SELECT g AS l_returnflag, {NOW} AS cur FROM m GROUP BY g")


def _trend(spec: dict, **kpi) -> Query:
    return lambda s, d: metric(s, d, CURRENT | {"value": spec}, ["value"], **kpi).select("l_returnflag", F.explode("value").alias("x")).select("l_returnflag", F.col("x.period").cast("string").alias("period"), flat(F.col("x.value"), "double").alias("value"))


def _trend_sql(a: str, b: str, value: str, where: str = "") -> str:
    return f"WITH m AS (SELECT l_returnflag AS g, CAST(date_trunc('month', l_shipdate) AS DATE) AS p, sum(l_quantity) AS qty, CAST(count(l_quantity) AS DOUBLE) AS n FROM lineitem {where} GROUP BY 1, 2) SELECT g AS l_returnflag, CAST(p AS VARCHAR) AS period, round({value}, 6) AS value FROM m WHERE p BETWEEN DATE '{a}-01' AND DATE '{b}-01'"


add("op_trend", _trend({"of": "qty", "op": "trend", "trailing": {"months": 12}}), _trend_sql("1997-07", "1998-06", "qty"))
add("op_shifted_trend", _trend({"of": "qty", "op": "shifted_trend", "trailing": {"months": 6}, "offset": {"years": 1}}), _trend_sql("1997-01", "1997-06", "qty"))
add("op_trend_arithmetic", _trend({"of": ["qty", "n"], "op": "trend_arithmetic", "fn": "divide", "trailing": {"months": 6}}), _trend_sql("1998-01", "1998-06", "qty / n"))
add("op_filtered_trend", _trend({"of": "qty", "op": "filtered_trend", "where": {"column": "l_linestatus", "op": "eq", "value": "F"}, "trailing": {"months": 6}}), _trend_sql("1998-01", "1998-06", "qty", "WHERE l_linestatus = 'F'"))

# -- cut operators ---------------------------------------------------------

CUT = """WITH t AS (SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_shipdate >= DATE '1998-06-01' THEN l_quantity END) AS v, sum(CASE WHEN l_shipdate < DATE '1997-07-01' THEN l_quantity END) AS o
 FROM lineitem WHERE l_shipdate >= DATE '1997-06-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1, 2),
 r AS (SELECT *, sum(v) OVER (ORDER BY v DESC, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) * 100 / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, l_returnflag, l_linestatus) AS i FROM t)"""
CUT_SQL = {
    "rank": ({}, "rank() OVER (ORDER BY v DESC)"),
    "percent_of_total": ({}, "v * 100 / sum(v) OVER ()"),
    "ntile": ({"tiles": 3}, "ceil(rank() OVER (ORDER BY v DESC) * 3.0 / count(v) OVER ())"),
    "dense_rank": ({}, "dense_rank() OVER (ORDER BY v DESC)"),
    "row_number": ({}, "i"),
    "cumulative_share": ({}, "share"),
    "running_total": ({}, "sum(v) OVER (ORDER BY v DESC, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING)"),
    "contribution": ({"vs": "old"}, "(v - o) * 100 / sum(v - o) OVER ()"),
    "percent_rank": ({}, "percent_rank() OVER (ORDER BY v DESC) * 100"),
    "gap_to_leader": ({}, "v - max(v) OVER ()"),
    "gap_to_avg": ({}, "v - avg(v) OVER ()"),
    "zscore": ({}, "(v - avg(v) OVER ()) / stddev_samp(v) OVER ()"),
    "running_avg": ({}, "avg(v) OVER (ORDER BY v DESC, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING)"),
    "top_n": ({"n": 2}, "CASE WHEN rank() OVER (ORDER BY v DESC) <= 2 THEN 1 ELSE 0 END"),
    "bottom_n": ({"n": 2}, "CASE WHEN rank() OVER (ORDER BY v) <= 2 THEN 1 ELSE 0 END"),
    "rank_pct_change": ({}, "rank() OVER (ORDER BY (v - o) / o DESC)"),
    "concentration": ({}, "sum(v * v) OVER () / (sum(v) OVER () * sum(v) OVER ())"),
    "abc_class": ({}, "CASE WHEN share <= 80 OR i = 1 THEN 'A' WHEN share <= 95 THEN 'B' ELSE 'C' END"),
    "pareto_flag": ({}, "CASE WHEN share <= 80 OR i = 1 THEN 1 ELSE 0 END"),
    "normalize": ({}, "v / max(abs(v)) OVER ()"),
}


def _cut(spec: dict, kind: str) -> Query:
    dims = ("l_returnflag", "l_linestatus")
    return lambda s, d: metric(s, d, CURRENT | {"value": spec}, ["value", "old"], dims).select(*dims, flat(F.col("value"), kind).alias("value"))


for _op, (_extra, _sql) in CUT_SQL.items():
    _kind = "string" if _op == "abc_class" else "double"
    _value = _sql if _kind == "string" else f"round(CAST({_sql} AS DOUBLE), 6)"
    add(f"cut_{_op}", _cut({"op": _op, "of": "qty" if _op == "rank_pct_change" else "cur", **_extra}, _kind), f"{CUT} SELECT l_returnflag, l_linestatus, {_value} AS value FROM r")

add("cut_partition_by", _cut({"op": "percent_of_total", "of": "cur", "partition_by": ["l_returnflag"]}, "double"), f"{CUT} SELECT l_returnflag, l_linestatus, round(v * 100 / sum(v) OVER (PARTITION BY l_returnflag), 6) AS value FROM r")
add("cut_derived", lambda s, d: metric(s, d, CURRENT | {"rk": {"op": "rank", "of": "cur"}, "value": {"op": "expr", "expr": "rk * 10 + 1"}}, ["value"]).select("l_returnflag", "value"), f"{MONTHLY} SELECT g AS l_returnflag, CAST(rank() OVER (ORDER BY {NOW} DESC) * 10 + 1 AS DOUBLE) AS value FROM m GROUP BY g")

# -- hooks -----------------------------------------------------------------

SERIES = """WITH m AS (SELECT l_returnflag AS g, CAST(date_trunc('month', l_shipdate) AS DATE) AS p, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate >= DATE '1996-07-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1, 2),
 x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) - 1 AS i, lag(qty) OVER (PARTITION BY g ORDER BY p) AS was, avg(qty) OVER (PARTITION BY g) AS mu, stddev_samp(qty) OVER (PARTITION BY g) AS sd, count(*) OVER (PARTITION BY g) AS k, median(qty) OVER (PARTITION BY g) AS med, first_value(qty) OVER (PARTITION BY g ORDER BY p) AS first_v, last_value(qty) OVER (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v FROM m),
 s AS (SELECT g, list(qty ORDER BY p) AS v, any_value(mu) AS mu, any_value(sd) AS sd, any_value(k) AS k, any_value(med) AS med, any_value(first_v) AS first_v, any_value(last_v) AS last_v, regr_slope(qty, i) AS slope, BAR AS bar FROM x GROUP BY g)"""
JUNE = "avg(CASE WHEN month(p) = 6{0} THEN qty END)"
RUNS = "(SELECT {0} FROM (SELECT x2.g AS g2, x2.p, sum(CASE WHEN x2.qty {1} (SELECT bar FROM s s2 WHERE s2.g = x2.g) THEN 1 ELSE 0 END) OVER (PARTITION BY x2.g ORDER BY x2.p {2} ROWS UNBOUNDED PRECEDING) AS breaks, x2.qty AS q2 FROM x x2) AS b WHERE b.g2 = s.g {3})"
HOOK_BAR = 1000.0
HOOK_SQL = {
    "seasonal_index": ({}, "(SELECT sum(CASE WHEN p = DATE '1998-06-01' THEN qty END) / " + JUNE.format(" AND p < DATE '1998-06-01'") + " FROM m WHERE m.g = s.g)"),
    "ewma": ({}, "list_reduce(v, lambda a, b: b * (2.0 / 25) + a * (1 - 2.0 / 25))"),
    "period_max": ({}, "list_max(v)"),
    "period_min": ({}, "list_min(v)"),
    "period_median": ({}, "med"),
    "period_avg": ({}, "mu"),
    "period_sum": ({}, "list_sum(v)"),
    "hit_rate": ({"value": HOOK_BAR}, "len(list_filter(v, lambda q: q >= bar)) * 100.0 / k"),
    "streak": ({"value": HOOK_BAR}, RUNS.format("count(*)", "<", "DESC", "AND breaks = 0")),
    "period_stdev": ({}, "sd"),
    "period_var": ({}, "sd * sd"),
    "period_cv": ({}, "sd / mu * 100"),
    "period_range": ({}, "list_max(v) - list_min(v)"),
    "period_count": ({}, "k"),
    "miss_rate": ({"value": HOOK_BAR}, "len(list_filter(v, lambda q: q < bar)) * 100.0 / k"),
    "miss_streak": ({"value": HOOK_BAR}, RUNS.format("count(*)", ">=", "DESC", "AND breaks = 0")),
    "longest_streak": ({"value": HOOK_BAR}, "coalesce((SELECT max(c) FROM " + RUNS.format("breaks, count(*) AS c", "<", "ASC", "AND q2 >= s.bar GROUP BY breaks").replace("(SELECT breaks", "(SELECT breaks", 1) + " AS runs), 0)"),
    "cagr": ({}, "pow(last_v / first_v, 1 / ((k - 1) / 12.0)) - 1"),
    "slope": ({}, "slope"),
    "mad": ({}, "(SELECT median(abs(qty - med)) FROM x WHERE x.g = s.g)"),
    "projection": ({"periods_ahead": 2}, "last_v + slope * 2"),
    "autocorrelation": ({}, "(SELECT corr(qty, was) FROM x WHERE x.g = s.g)"),
    "rsi": ({"n": 14}, "(SELECT 100 - 100 / (1 + sum(greatest(qty - was, 0)) / sum(greatest(was - qty, 0))) FROM x WHERE x.g = s.g AND x.i > x.k - 15)"),
    "bollinger": ({"k": 2}, "(last_v - (mu - 2 * sd)) / (4 * sd)"),
    "exponential_decay_sum": ({"decay": 0.5}, "(SELECT sum(qty * pow(0.5, x.k - 1 - i)) FROM x WHERE x.g = s.g)"),
    "theil_sen_slope": ({}, "(SELECT median((b.qty - a.qty) / (b.i - a.i)) FROM x a, x b WHERE a.g = s.g AND b.g = s.g AND b.i > a.i)"),
    "changepoint": ({}, "(SELECT arg_max(c.i, struct_pack(d := abs((SELECT avg(a.qty) FROM x a WHERE a.g = c.g AND a.i < c.i) - (SELECT avg(b.qty) FROM x b WHERE b.g = c.g AND b.i >= c.i)), j := -c.i)) FROM x c WHERE c.g = s.g AND c.i > 0)"),
    "outlier_count": ({"k": 1}, "(SELECT count(*) FROM x WHERE x.g = s.g AND abs((qty - x.mu) / x.sd) > 1)"),
    "percentile_rank_series": ({}, "(SELECT (sum(CASE WHEN qty < x.last_v THEN 1 ELSE 0 END) + 0.5 * sum(CASE WHEN qty = x.last_v THEN 1 ELSE 0 END)) * 100 / count(*) FROM x WHERE x.g = s.g)"),
    "weighted_ewma": ({"alpha": 0.3}, "list_reduce(v, lambda a, b: b * 0.3 + a * 0.7)"),
    "run_rate": ({}, "last_v * 12"),
    "target_trajectory": ({"value": HOOK_BAR}, "last_v / bar"),
    "forecast_confidence": ({"side": "low"}, "last_v + slope - 1.96 * sd"),
    "seasonal_decompose": ({}, "(SELECT " + JUNE.format("") + " / avg(qty) FROM m WHERE m.g = s.g)"),
}


def _hook(name: str, extra: dict) -> Query:
    spec = {"op": "hook", "hook": name, "of": "qty", "trailing": {"months": 24}, **extra}
    return lambda s, d: metric(s, d, {"value": spec}, ["value"]).select("l_returnflag", flat(F.col("value"), "double").alias("value"))


for _name, (_extra, _sql) in HOOK_SQL.items():
    add(f"hook_{_name}", _hook(_name, _extra), SERIES.replace("BAR AS", f"{HOOK_BAR} AS") + f" SELECT g AS l_returnflag, round(CAST({_sql} AS DOUBLE), 6) AS value FROM s")


def _cohort(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        kpi = {"kpi_id": 1, "time": {"column": "ts", "grain": "day", "filter_code": "day"}, "dimensions": [{"name": "event_type"}], "base_measures": {"n": {"sql": "event_id", "agg": "count"}}, "measures": {"value": {"op": "hook", "hook": name, "cohort_column": "user_id", "entry_period": "2024-01-10"}}}
        ctx = context(d, ["value"], ("events",), None, {"day": {"value": ["2024-01-15"]}})
        return compute_df(ctx, spark=spark, kpi=kpi, model={"kind": "physical", "sources": {"events": {}}}).select("event_type", flat(F.col("value"), "double").alias("value"))

    return run


for _name, _cmp in (("cohort_retention", "="), ("survival_rate", "<=")):
    add(f"hook_{_name}", _cohort(_name), f"WITH e AS (SELECT event_type, user_id, min(CAST(ts AS DATE)) AS f, max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 1 ELSE 0 END) AS t FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-16' GROUP BY 1, 2) SELECT event_type, round(CAST(sum(CASE WHEN f {_cmp} DATE '2024-01-10' AND t = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN f {_cmp} DATE '2024-01-10' THEN 1 ELSE 0 END), 0), 6) AS value FROM e GROUP BY 1")

# -- aggregations ----------------------------------------------------------

AGG_SQL = {
    "sum": "sum(v)", "count": "count(v)", "min": "min(v)", "max": "max(v)", "avg": "avg(v)", "weighted_avg": "sum(v * w) / sum(w)", "count_distinct": "count(DISTINCT v)",
    "median": "median(v)", "percentile": "quantile_cont(v, 0.9)", "first": "arg_min(v, struct_pack(a := t, b := v))", "last": "arg_max(v, struct_pack(a := t, b := v))", "stddev": "stddev_samp(v)",
    "variance": "var_samp(v)", "mode": "(SELECT z.v FROM (SELECT l_returnflag AS g2, l_quantity AS v, count(*) AS c FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1, 2) AS z WHERE z.g2 = g ORDER BY c DESC, v LIMIT 1)",
    "geomean": "exp(avg(ln(v)))", "harmonic_mean": "count(v) / sum(1 / v)", "any": "CASE WHEN bool_or(v <> 0) THEN 1 ELSE 0 END", "all": "CASE WHEN bool_and(v <> 0) THEN 1 ELSE 0 END",
}


def _agg(name: str) -> Query:
    base = {"a": {"sql": "l_quantity", "agg": name, "weight_column": "l_discount", "percentile": 90}}
    if name != "weighted_avg":
        del base["a"]["weight_column"]
    return lambda s, d: metric(s, d, {"value": {"of": "a", "op": "point"}}, ["value"], bases=base).select("l_returnflag", flat(F.col("value"), "double").alias("value"))


for _name, _sql in AGG_SQL.items():
    add(f"agg_{_name}", _agg(_name), f"WITH d AS (SELECT l_returnflag AS g, l_quantity AS v, nullif(l_discount, 0) AS w, l_shipdate AS t FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01') SELECT g AS l_returnflag, round(CAST({_sql} AS DOUBLE), 6) AS value FROM d GROUP BY g")


def _listed(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        kpi = {"kpi_id": 1, "dimensions": [{"name": "n_regionkey"}], "base_measures": {"a": {"sql": "n_name", "agg": name}}, "measures": {"value": {"of": "a", "op": "point"}}}
        out = compute_df(context(d, ["value"], ("nation",), None), spark=spark, kpi=kpi, model={"kind": "physical", "sources": {"nation": {}}})
        return out.select("n_regionkey", F.col("value") if name == "string_agg" else F.array_join("value", "|").alias("value"))

    return run


add("agg_list_agg", _listed("list_agg"), "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS value FROM nation GROUP BY 1")
add("agg_string_agg", _listed("string_agg"), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")

# -- filters ---------------------------------------------------------------

FILTER_SQL = {
    "in": ("o_orderpriority", ["1-URGENT", "2-HIGH"], "IN ('1-URGENT', '2-HIGH')"), "eq": ("o_orderstatus", "F", "= 'F'"), "ne": ("o_orderstatus", "F", "<> 'F'"),
    "lt": ("o_totalprice", 100000.0, "< 100000"), "lte": ("o_totalprice", 100000.0, "<= 100000"), "gt": ("o_totalprice", 100000.0, "> 100000"), "gte": ("o_totalprice", 100000.0, ">= 100000"),
    "like": ("o_orderpriority", "%-H%", "LIKE '%-H%'"), "ilike": ("o_orderpriority", "%-h%", "ILIKE '%-h%'"), "not_like": ("o_orderpriority", "1%", "NOT LIKE '1%'"),
    "between": ("o_totalprice", [50000.0, 90000.0], "BETWEEN 50000 AND 90000"), "not_between": ("o_totalprice", [50000.0, 90000.0], "NOT BETWEEN 50000 AND 90000"),
    "is_null": ("o_orderstatus", None, "IS NULL"), "is_not_null": ("o_orderstatus", None, "IS NOT NULL"),
}


def _filter(column: str, op: str, value) -> Query:
    # pending orders have no status, so that some are null
    return lambda s, d: s.read.parquet(f"{d}/orders.parquet").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")).filter(predicate(F.col(column), op, value)).select("o_orderkey", "o_orderstatus", "o_totalprice")


_ORDERS = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"
for _op, (_column, _value, _sql) in FILTER_SQL.items():
    add(f"filter_{_op}", _filter(_column, _op, _value), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_ORDERS} WHERE {_column} {_sql}")
add("filter_regexp", _filter("o_orderpriority", "regexp", "^[12]-"), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_ORDERS} WHERE regexp_matches(o_orderpriority, '^[12]-')")
add("filter_regexp_insensitive", _filter("o_orderpriority", "regexp_insensitive", "high$"), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_ORDERS} WHERE regexp_matches(o_orderpriority, 'high$', 'i')")


def _masked(where) -> Query:
    return lambda s, d: metric(s, d, {"value": {"of": "a", "op": "point"}}, ["value"], bases={"a": {"sql": "l_quantity", "agg": "sum", "where": where}}).select("l_returnflag", "value")


add("filter_mask", _masked({"or": [{"column": "l_linestatus", "op": "eq", "value": "O"}, {"not": {"column": "l_discount", "op": "gt", "value": 0.03}}]}), "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' OR NOT l_discount > 0.03 THEN l_quantity END) AS value FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    """Two cuts; the wider one ignores the request's filter."""
    kpi = {"kpi_id": 1, "time": {"column": "l_shipdate", "grain": "month", "filter_code": "month"}, "dimensions": [{"name": "l_returnflag"}, {"name": "l_linestatus"}], "default_dimensions": ["l_returnflag"], "base_measures": BASES, "measures": {"cur": CURRENT["cur"]}, "cuts": [{"name": "G", "ignore_filters": ["l_linestatus"], "also_emit": ["R"]}, {"name": "R", "group_by": ["l_linestatus"]}], "default_cut": "G"}
    ctx = context(d, ["cur"], filters={"l_linestatus": {"value": ["O"]}})
    return compute_df(ctx, spark=spark, kpi=kpi, model=MODEL).select("output_cut", "l_returnflag", "l_linestatus", "cur")


_JUNE = "l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01'"
add("cuts_ignore_filters", _cuts, f"SELECT 'G' AS output_cut, l_returnflag, NULL AS l_linestatus, sum(l_quantity) AS cur FROM lineitem WHERE {_JUNE} GROUP BY 2 UNION ALL SELECT 'R', l_returnflag, l_linestatus, sum(l_quantity) FROM lineitem WHERE {_JUNE} AND l_linestatus = 'O' GROUP BY 2, 3")
add("having", lambda s, d: metric(s, d, CURRENT, ["cur"], having={"predicates": [{"of": "cur", "cmp": ">", "vs": "old"}]}).select("l_returnflag", "cur"), f"{MONTHLY} SELECT g AS l_returnflag, {NOW} AS cur FROM m GROUP BY g HAVING {NOW} > {YEAR}")



def _between_cuts(measures: dict) -> Query:
    """The finer cut reads the wider one, which ignores the request's filter."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        kpi = {"kpi_id": 1, "time": {"column": "l_shipdate", "grain": "month", "filter_code": "month"}, "dimensions": [{"name": "l_returnflag"}, {"name": "l_linestatus"}], "default_dimensions": ["l_returnflag"], "base_measures": BASES, "measures": CURRENT | measures, "cuts": [{"name": "R", "group_by": ["l_linestatus"]}, {"name": "G", "ignore_filters": ["l_linestatus"]}], "default_cut": "R"}
        out = compute_df(context(d, ["cur", "value"], filters={"l_linestatus": {"value": ["O"]}}), spark=spark, kpi=kpi, model=MODEL)
        return out.select("l_returnflag", "l_linestatus", "cur", F.round("value", 6).alias("value"))

    return run


def _between_sql(value: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS cur, round({value}, 6) AS value FROM lineitem WHERE {_JUNE} AND l_linestatus = 'O' GROUP BY 1, 2"


add("cut_versus_cut", _between_cuts({"value": {"op": "percent_of_total", "of": "cur", "versus_cut": "G"}}), _between_sql(f"sum(l_quantity) * 100 / (SELECT sum(l_quantity) FROM lineitem WHERE {_JUNE})"))
add("cut_from_cut", _between_cuts({"value": {"of": "qty", "op": "point", "from_cut": "G", "cuts": ["R"]}}), _between_sql(f"(SELECT sum(w.l_quantity) FROM lineitem AS w WHERE w.l_returnflag = lineitem.l_returnflag AND {_JUNE.replace('l_shipdate', 'w.l_shipdate')})"))

# -- entity windows ----------------------------------------------------------

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
WINDOW_SQL = {
    "row_number": f"row_number() OVER ({_W})", "rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)", "dense_rank": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)",
    "lag": f"lag(o_totalprice, 1) OVER ({_W})", "lead": f"lead(o_totalprice, 1) OVER ({_W})", "running_sum": f"sum(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING)", "running_avg": f"avg(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING)",
    "last_n": f"list_sum(list(o_totalprice) OVER ({_W} ROWS 2 PRECEDING))",
}


def _window(fn: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        value = entity_window(fn, F.col("o_totalprice"), [F.col("o_custkey")], [F.col("o_orderdate"), F.col("o_orderkey")], 3 if fn == "last_n" else 1)
        df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", value.alias("v"))
        v = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) if fn == "last_n" else F.col("v")
        return df.select("o_orderkey", F.round(v.cast("double"), 2).alias("value"))

    return run


for _fn, _sql in WINDOW_SQL.items():
    add(f"over_{_fn}", _window(_fn), f"SELECT o_orderkey, round(CAST({_sql} AS DOUBLE), 2) AS value FROM orders")

# -- column and measure functions --------------------------------------------


class Sql(str):
    """A Spark SQL expression, parsed when a query runs."""


Q, D, X = Sql("l_quantity"), Sql("l_discount"), Sql("l_tax")
S, T, I = Sql("l_returnflag"), Sql("l_shipdate"), Sql("l_partkey")  # noqa: E741
NZ = Sql("CASE WHEN l_linenumber <> 3 THEN l_discount END")
NZ_SQL = "(CASE WHEN l_linenumber <> 3 THEN l_discount END)"
#: name: (arguments, keyword arguments, SQL)
COLUMN_SQL: dict[str, tuple] = {
    "value": ((Q,), {}, "l_quantity"), "abs": ((Sql("l_discount - l_tax"),), {}, "abs(l_discount - l_tax)"), "sum": ((Q, NZ), {}, f"l_quantity + {NZ_SQL}"), "subtract": ((Q, D, X), {}, "l_quantity - l_discount - l_tax"),
    "multiply": ((Q, D), {}, "l_quantity * l_discount"), "divide": ((Q, D), {}, "l_quantity / nullif(l_discount, 0)"), "percent_of": ((D, Q), {}, "l_discount / nullif(l_quantity, 0) * 100"),
    "min": ((Q, NZ), {}, f"least(l_quantity, {NZ_SQL})"), "max": ((Q, NZ), {}, f"greatest(l_quantity, {NZ_SQL})"), "avg": ((Q, NZ), {}, f"(l_quantity + coalesce({NZ_SQL}, 0)) / (1 + CASE WHEN {NZ_SQL} IS NULL THEN 0 ELSE 1 END)"),
    "coalesce": ((NZ, Q), {}, f"coalesce({NZ_SQL}, l_quantity)"), "if_null": ((NZ, X), {}, f"coalesce({NZ_SQL}, l_tax)"), "nullif": ((Q, Sql("10")), {}, "nullif(l_quantity, 10)"), "null_if_zero": ((D,), {}, "nullif(l_discount, 0)"),
    "zero_if_null": ((NZ,), {}, f"coalesce({NZ_SQL}, 0)"), "is_null": ((NZ,), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 1 ELSE 0 END"), "is_not_null": ((NZ,), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 0 ELSE 1 END"),
    "if_else": ((D, Q, X), {}, "CASE WHEN l_discount <> 0 THEN l_quantity ELSE l_tax END"), "round": ((Sql("l_quantity / 4"),), {"decimals": 0}, "round_even(l_quantity / 4, 0)"), "floor": ((Sql("l_quantity / 3"),), {}, "floor(l_quantity / 3)"), "ceil": ((Sql("l_quantity / 3"),), {}, "ceil(l_quantity / 3)"),
    "power": ((Q, Sql("0.5")), {}, "pow(l_quantity, 0.5)"), "log": ((D,), {}, "CASE WHEN l_discount > 0 THEN ln(l_discount) END"), "log10": ((D,), {}, "CASE WHEN l_discount > 0 THEN log10(l_discount) END"), "sqrt": ((D,), {}, "sqrt(l_discount)"),
    "date_diff": ((Sql("DATE '1996-03-15'"), T), {"unit": "month"}, "(year(l_shipdate) - 1996) * 12 + month(l_shipdate) - 3"), "date_add": ((T, 2), {"unit": "month"}, "strftime(l_shipdate + INTERVAL 2 MONTH, '%Y-%m-%d')"), "epoch_day": ((T,), {}, "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"),
    "weighted_product": ((Q, D, X), {}, "l_quantity * l_discount * l_tax"), "safe_divide": ((Q, X), {}, "l_quantity / nullif(l_tax, 0)"), "clip": ((Q, Sql("10"), Sql("30")), {}, "least(greatest(l_quantity, 10), 30)"),
    "parse_date": ((Sql("date_format(l_shipdate, 'yyyy-MM-dd')"),), {}, "strftime(l_shipdate, '%Y-%m-%d')"), "parse_number": ((Sql("'1' || l_partkey"),), {}, "CAST('1' || CAST(l_partkey AS VARCHAR) AS DOUBLE)"),
    "trim": ((Sql("concat(' ', l_returnflag, '\\t ')"),), {}, "l_returnflag"), "upper": ((Sql("lower(l_returnflag)"),), {}, "upper(l_returnflag)"), "lower": ((S,), {}, "lower(l_returnflag)"), "substring": ((I, 1, 2), {}, "substr(CAST(l_partkey AS VARCHAR), 2, 2)"),
    "left": ((I, 2), {}, "left(CAST(l_partkey AS VARCHAR), 2)"), "right": ((I, 2), {}, "right(CAST(l_partkey AS VARCHAR), 2)"), "replace": ((I, "1", "x"), {}, "replace(CAST(l_partkey AS VARCHAR), '1', 'x')"), "concat": ((S, I), {}, "l_returnflag || CAST(l_partkey AS VARCHAR)"),
    "coalesce_date": ((Sql("CAST(NULL AS STRING)"), T), {}, "strftime(l_shipdate, '%Y-%m-%d')"), "is_between_dates": ((T, Sql("'1997-01-01'"), Sql("'1997-12-31'")), {}, "CASE WHEN l_shipdate >= DATE '1997-01-01' AND l_shipdate <= DATE '1997-12-31' THEN 1 ELSE 0 END"),
    "flag_in_set": ((S, "A", "N"), {}, "CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE 0 END"),
}
TEXT = ("trim", "upper", "lower", "substring", "left", "right", "replace", "concat")
DATES = ("date_add", "parse_date", "coalesce_date")


def _function(f, args: tuple, params: dict, kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = f(*[F.expr(a) if isinstance(a, Sql) else a for a in args], **params)
        v = F.date_format(v, "yyyy-MM-dd") if kind == "date" else flat(v, kind)
        return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", v.alias("value"))

    return run


def _functions(prefix: str, table: dict, found: dict) -> None:
    for name, (args, params, sql) in table.items():
        kind = "string" if name in TEXT or name == "sign_label" else "date" if name in DATES and prefix == "fn" else "string" if name == "date_add" else "double"
        value = sql if kind != "double" else f"round(CAST({sql} AS DOUBLE), 6)"
        add(f"{prefix}_{name}", _function(found[name], args, params, kind), f"SELECT l_orderkey, l_linenumber, {value} AS value FROM lineitem")


_functions("fn", COLUMN_SQL, COLUMN_FUNCTIONS)
add("fn_json_extract", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", COLUMN_FUNCTIONS["json_extract"](F.col("props"), "k").cast("double").alias("value")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")
add("fn_hash_bucket", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", COLUMN_FUNCTIONS["hash_bucket"](F.col("o_custkey"), 16).alias("value")), "SELECT o_orderkey, CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS UBIGINT) % 16 AS DOUBLE) AS value FROM orders")

MEASURE_SQL: dict[str, tuple] = {
    "growth_pct": ((Q, D), {}, "(l_quantity - l_discount) / nullif(l_discount, 0)"), "divide": ((Q, D), {}, "l_quantity / nullif(l_discount, 0)"), "percent": ((D, Q), {}, "l_discount / l_quantity * 100"), "sum": ((Q, D, NZ), {}, f"l_quantity + l_discount + {NZ_SQL}"),
    "subtract": ((Q, D), {}, "l_quantity - l_discount"), "multiply": ((Q, D), {}, "l_quantity * l_discount"), "min": ((Q, NZ), {}, f"least(l_quantity, {NZ_SQL})"), "max": ((Q, NZ), {}, f"greatest(l_quantity, {NZ_SQL})"),
    "avg": ((Q, NZ), {}, f"(l_quantity + coalesce({NZ_SQL}, 0)) / (1 + CASE WHEN {NZ_SQL} IS NULL THEN 0 ELSE 1 END)"), "abs": ((Sql("l_discount - l_tax"),), {}, "abs(l_discount - l_tax)"), "clamp": ((Q, NZ, Sql("30")), {}, f"CASE WHEN {NZ_SQL} IS NOT NULL THEN least(greatest(l_quantity, {NZ_SQL}), 30) END"),
    "attainment": ((Q, Sql("20")), {}, "l_quantity / 20 * 100"), "coalesce": ((NZ, Q), {}, f"coalesce({NZ_SQL}, l_quantity)"), "if_null": ((NZ, Q), {}, f"coalesce({NZ_SQL}, l_quantity)"), "nullif": ((Q, Sql("10")), {}, "nullif(l_quantity, 10)"), "null_if_zero": ((D,), {}, "nullif(l_discount, 0)"),
    "zero_if_null": ((NZ,), {}, f"coalesce({NZ_SQL}, 0)"), "is_null": ((NZ,), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 1 ELSE 0 END"), "is_not_null": ((NZ,), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 0 ELSE 1 END"), "if_else": ((D, Q, X), {}, "CASE WHEN l_discount <> 0 THEN l_quantity ELSE l_tax END"),
    "sign_label": ((Sql("l_discount - l_tax"),), {}, "CASE WHEN l_discount - l_tax > 0 THEN 'Positive' WHEN l_discount - l_tax < 0 THEN 'Negative' ELSE 'Neutral' END"), "round": ((Sql("l_quantity / 4"),), {}, "round_even(l_quantity / 4, 0)"), "floor": ((Sql("l_quantity / 3"),), {}, "floor(l_quantity / 3)"), "ceil": ((Sql("l_quantity / 3"),), {}, "ceil(l_quantity / 3)"),
    "power": ((Q, Sql("0.5")), {}, "pow(l_quantity, 0.5)"), "log": ((D,), {}, "CASE WHEN l_discount > 0 THEN ln(l_discount) END"), "log10": ((D,), {}, "CASE WHEN l_discount > 0 THEN log10(l_discount) END"), "sqrt": ((D,), {}, "sqrt(l_discount)"),
    "date_diff": ((Sql("DATE '1996-03-15'"), T), {"unit": "year"}, "year(l_shipdate) - 1996"), "date_add": ((T, 3), {"unit": "day"}, "strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m-%d')"), "epoch_day": ((T,), {}, "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"),
    "geomean_scalars": ((Q, D), {}, "CASE WHEN l_discount > 0 THEN sqrt(l_quantity * l_discount) END"), "weighted_avg_scalars": ((Q, D, X, Sql("2.0")), {}, "(l_quantity * l_discount + l_tax * 2) / (l_discount + 2)"), "harmonic_mean": ((Q, D), {}, "CASE WHEN l_discount > 0 THEN 2 / (1 / l_quantity + 1 / nullif(l_discount, 0)) END"),
    "min_max_spread": ((Q, D, X), {}, "greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax)"), "ratio_safe": ((Q, X), {}, "l_quantity / nullif(l_tax, 0)"), "bps_change": ((Q, Sql("20")), {}, "(l_quantity - 20) / 20 * 10000"), "log_change": ((Q, D), {}, "CASE WHEN l_discount > 0 THEN ln(l_quantity / l_discount) END"),
    "if_between": ((Q, Sql("10"), Sql("20")), {}, "CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 ELSE 0 END"), "all_null": ((NZ, NZ), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 1 ELSE 0 END"), "any_null": ((Q, NZ), {}, f"CASE WHEN {NZ_SQL} IS NULL THEN 1 ELSE 0 END"),
}
_functions("mfn", MEASURE_SQL, MEASURE_FUNCTIONS)

# -- sources ---------------------------------------------------------------


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """A physical join: orders by customer segment and month."""
    kpi = {"kpi_id": 1, "time": {"column": "o_orderdate", "grain": "month", "filter_code": "month"}, "dimensions": [{"name": "segment", "from": "c_mktsegment"}], "base_measures": {"total": {"sql": "o_totalprice", "agg": "sum"}}, "measures": {"cur": {"of": "total", "op": "point"}, "ytd": {"of": "total", "op": "window", "range": "ytd"}}}
    model = {"kind": "physical", "sources": {"orders": {}, "customer": {}}, "joins": [{"right": "customer", "on": ["o_custkey"], "right_on": ["c_custkey"], "type": "left"}]}
    return compute_df(context(d, ["cur", "ytd"], ("orders", "customer")), spark=spark, kpi=kpi, model=model).select("segment", F.round("cur", 2).alias("cur"), F.round("ytd", 2).alias("ytd"))


add("source_physical_join", _joined, "SELECT c_mktsegment AS segment, round(sum(CASE WHEN o_orderdate >= DATE '1998-06-01' THEN o_totalprice END), 2) AS cur, round(sum(o_totalprice), 2) AS ytd FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-07-01' GROUP BY 1")


def _sql_model(spark: SparkSession, d: str) -> DataFrame:
    kpi = {"kpi_id": 1, "dimensions": [{"name": "r_name"}], "base_measures": {"k": {"sql": "n_nationkey", "agg": "count"}}, "measures": {"nations": {"of": "k", "op": "point"}}}
    model = {"kind": "sql", "required_aliases": ["nation", "region"], "sql": "WITH n AS (SELECT * FROM read_parquet($nation_path)) SELECT n.n_nationkey, r.r_name FROM n JOIN $region_scan r ON n.n_regionkey = r.r_regionkey"}
    return compute_df(context(d, ["nations"], ("nation", "region"), None), spark=spark, kpi=kpi, model=model).select("r_name", "nations")


add("source_sql_model", _sql_model, "SELECT r_name, CAST(count(n_nationkey) AS DOUBLE) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantity by return flag: current, last year, window, growth."""
    measures = CURRENT | {"yoy": {"op": "pct_change", "of": "qty", "offset": {"years": 1}}, "share": {"op": "percent_of_total", "of": "cur"}}
    return metric(spark, sf_dir, measures, ["cur", "old", "three", "yoy", "share"]).select("l_returnflag", "cur", "old", "three", F.round("yoy", 6).alias("yoy"), F.round("share", 6).alias("share"))


add("flagship", flagship, f"{MONTHLY} SELECT g AS l_returnflag, {NOW} AS cur, {YEAR} AS old, {W('1998-04', '1998-06')} AS three, round(({NOW} - {YEAR}) / {YEAR}, 6) AS yoy, round({NOW} * 100 / sum({NOW}) OVER (), 6) AS share FROM m GROUP BY g")


def _load_requests() -> None:
    from . import request_queries

    QUERIES.update(request_queries.QUERIES)
    ORACLE.update(request_queries.ORACLE)


_load_requests()
