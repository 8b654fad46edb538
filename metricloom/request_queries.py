"""Queries of request and planning features, through ``compute_df``, with equal
DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .api import compute_df

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLE = {"kind": "physical", "sources": {"lineitem": {}}, "joins": []}
MONTH = {"column": "l_shipdate", "grain": "month", "filter_code": "month"}
SUM = {"qty": {"sql": "l_quantity", "agg": "sum"}}
NOW = {"value": {"of": "qty", "op": "point"}}
JUNE = "l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-07-01'"
FLAG, STATUS = {"name": "l_returnflag"}, {"name": "l_linestatus"}


def asked(columns: list[str], measures: dict | None = None, given: dict | None = None, month="1998-06", models=TABLE, tables=("lineitem",), keys: list[str] | None = None, parameters: dict | None = None, selected=None, **kpi) -> Query:
    """A request over lineitem, June 1998 by return flag unless told otherwise."""
    measures = measures or NOW
    spec = {"kpi_id": 1, "time": MONTH, "dimensions": [FLAG], "base_measures": SUM, "measures": measures} | kpi
    if isinstance(models, list):
        spec["model"] = models[0]["model_id"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        context = {
            "execution": {"kpi_id": 1, "view_details": [{"view_id": 1, "measures_required": [{"measure_key": k} for k in keys or ["value"]]}]},
            "filters": ({"month": {"value": [month]}} if month else {}) | {c: {"values": v} for c, v in (given or {}).items()},
            "datasets": {t: {"alias": t, "path": f"{d}/{t}.parquet"} for t in tables},
        }
        if parameters:
            context["parameters"] = parameters
        if selected is not None:
            context["selected_dimensions"] = selected
        return compute_df(context, spark=spark, kpi=spec, model=models).selectExpr(*columns)

    return run


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def rounded(name: str = "value", digits: int = 4) -> str:
    return f"round(cast({name} as double), {digits}) as {name}"


BY_FLAG = ["l_returnflag", rounded()]
TWO_CUTS = [{"name": "G", "exclude_from_grain": ["l_linestatus"], "also_emit": ["R"]}, {"name": "R"}]


def by_flag(value: str, where: str = JUNE) -> str:
    return f"SELECT l_returnflag, round(CAST({value} AS DOUBLE), 4) AS value FROM lineitem WHERE {where} GROUP BY 1"


# -- filters ----------------------------------------------------------------

SHARE = NOW | {"share": {"op": "percent_of_total", "of": "value"}}
for _stage, _whole in (("extract", f"{JUNE} AND l_linestatus = 'O'"), ("calc", f"{JUNE} AND l_linestatus = 'O'"), ("result", JUNE)):
    add(
        f"filter_stage_{_stage}",
        asked(["l_returnflag", "l_linestatus", rounded("share")], SHARE, {"status": ["O"]}, keys=["value", "share"], dimensions=[FLAG, STATUS], filters={"status": {"column": "l_linestatus", "op": "eq", "apply": _stage}}),
        f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity) * 100 / (SELECT sum(l_quantity) FROM lineitem WHERE {_whole}), 4) AS share FROM lineitem WHERE {JUNE} AND l_linestatus = 'O' GROUP BY 1, 2",
    )
add("filter_required", asked(BY_FLAG, given={"f": ["F"]}, filters={"f": {"column": "l_linestatus", "required": True}}), by_flag("sum(l_quantity)", f"{JUNE} AND l_linestatus = 'F'"))
add("filter_default", asked(BY_FLAG, filters={"f": {"column": "l_linestatus", "default": ["F"]}}), by_flag("sum(l_quantity)", f"{JUNE} AND l_linestatus = 'F'"))
add("filter_map", asked(BY_FLAG, given={"line state": ["O"]}, filter_map={"line state": "l_linestatus"}), by_flag("sum(l_quantity)", f"{JUNE} AND l_linestatus = 'O'"))
add("filter_compose", asked(BY_FLAG, given={"tens": [1], "ones": [5]}, filters={"size": {"column": "l_quantity", "op": "gte", "compose": {"template": "{tens}{ones:01}"}}}), by_flag("sum(l_quantity)", f"{JUNE} AND l_quantity >= 15"))
add("time_compose", asked(BY_FLAG, given={"year": [1998], "mon": [6]}, month=None, time=MONTH | {"compose": {"template": "{year}{mon:02}"}, "format": "yyyymm"}), by_flag("sum(l_quantity)"))
#: Request filters by operator: (spelling, column, values, SQL)
REQUESTED = {
    "in": ("IN", "l_linenumber", [1, 3], "IN (1, 3)"),
    "eq": ("==", "l_linestatus", ["O"], "= 'O'"),
    "ne": ("<>", "l_linestatus", ["O"], "<> 'O'"),
    "lt": ("<", "l_quantity", [20], "< 20"),
    "lte": ("le", "l_quantity", [20], "<= 20"),
    "gt": (">", "l_quantity", [20], "> 20"),
    "gte": ("GE", "l_quantity", [20], ">= 20"),
    "like": ("LIKE", "l_linestatus", ["O%"], "LIKE 'O%'"),
    "ilike": ("ILIKE", "l_linestatus", ["o%"], "ILIKE 'o%'"),
    "between": ("Between", "l_quantity", [10, 20], "BETWEEN 10 AND 20"),
    "is_not_null": ("NOTNULL", "l_linestatus", [], "IS NOT NULL"),
    "regexp": ("regex", "l_returnflag", ["[AN]"], "SIMILAR TO '.*[AN].*'"),
    "alias_not_like": ("not like", "l_linestatus", ["O%"], "NOT LIKE 'O%'"),
    "alias_notlike": ("notlike", "l_linestatus", ["O%"], "NOT LIKE 'O%'"),
    "alias_not_between": ("NOT BETWEEN", "l_quantity", [10, 20], "NOT BETWEEN 10 AND 20"),
    "alias_is_not_null": ("is not null", "l_linestatus", [], "IS NOT NULL"),
    "alias_regex_insensitive": ("regex_insensitive", "l_returnflag", ["[an]"], "SIMILAR TO '.*[AN].*'"),
}
for _name, (_op, _column, _values, _sql) in REQUESTED.items():
    add(f"filter_request_{_name}" if not _name.startswith("alias_") else f"filter_{_name}", asked(BY_FLAG, given={"f": _values}, filters={"f": {"column": _column, "op": _op}}), by_flag("sum(l_quantity)", f"{JUNE} AND {_column} {_sql}"))
#: Nations whose key is no region's: a column that is null in most rows.
PAIRED = {"kind": "physical", "sources": {"nation": {}, "region": {}}, "joins": [{"right": "region", "on": ["n_nationkey"], "right_on": ["r_regionkey"], "type": "left"}]}
for _name, _op in (("request_is_null", "is_null"), ("alias_is_null", "IS NULL"), ("alias_isnull", "isnull")):
    add(
        f"filter_{_name}",
        asked(["n_regionkey", rounded()], given={"f": []}, month=None, models=PAIRED, tables=("nation", "region"), time=None, dimensions=[{"name": "n_regionkey"}], base_measures={"qty": {"sql": "n_nationkey", "agg": "count"}}, filters={"f": {"column": "r_name", "op": _op}}),
        "SELECT n_regionkey, CAST(count(n_nationkey) AS DOUBLE) AS value FROM nation LEFT JOIN region ON n_nationkey = r_regionkey WHERE r_name IS NULL GROUP BY 1",
    )
for _kind in ("left", "inner", "right"):
    add(
        f"source_join_{_kind}",
        asked(["r_name", rounded()], month=None, models=PAIRED | {"joins": [PAIRED["joins"][0] | {"type": _kind}]}, tables=("nation", "region"), time=None, dimensions=[{"name": "r_name"}], base_measures={"qty": {"sql": "n_name", "agg": "count"}}),
        f"SELECT r_name, CAST(count(n_name) AS DOUBLE) AS value FROM nation {_kind.upper()} JOIN region ON n_nationkey = r_regionkey GROUP BY 1",
    )
add(
    "measure_ignore_filters",
    asked(["l_returnflag", rounded(), rounded("whole")], NOW | {"whole": {"of": "qty", "op": "point", "ignore_filters": ["l_linestatus"]}}, {"l_linestatus": ["O"]}, keys=["value", "whole"]),
    f"SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS value, sum(l_quantity) AS whole FROM lineitem WHERE {JUNE} GROUP BY 1",
)
add(
    "measure_having",
    asked(BY_FLAG, {"value": {"of": "qty", "op": "point", "having": {"predicates": [{"of": "old", "cmp": ">", "vs": "now"}]}}, "now": NOW["value"], "old": {"of": "qty", "op": "point", "offset": {"years": 1}}}),
    "SELECT l_returnflag, CASE WHEN sum(CASE WHEN l_shipdate < DATE '1998-01-01' THEN l_quantity END) > sum(CASE WHEN l_shipdate >= DATE '1998-01-01' THEN l_quantity END) THEN sum(CASE WHEN l_shipdate >= DATE '1998-01-01' THEN l_quantity END) END AS value"
    f" FROM lineitem WHERE {JUNE} OR l_shipdate >= DATE '1997-06-01' AND l_shipdate < DATE '1997-07-01' GROUP BY 1",
)
add(
    "measure_having_any",
    asked(BY_FLAG, NOW | {"value": NOW["value"] | {"having": {"match": "any", "predicates": [{"of": "rank", "cmp": "eq", "value": 1}, {"of": "qty", "cmp": "between", "low": 0, "high": 10}]}}, "rank": {"op": "rank", "of": "plain"}, "plain": NOW["value"]}),
    f"SELECT l_returnflag, CASE WHEN rank() OVER (ORDER BY v DESC) = 1 OR v BETWEEN 0 AND 10 THEN v END AS value FROM (SELECT l_returnflag, sum(l_quantity) AS v FROM lineitem WHERE {JUNE} GROUP BY 1)",
)
_BIG = f"SELECT l_returnflag, l_linenumber FROM lineitem WHERE {JUNE} GROUP BY 1, 2 HAVING avg(l_quantity) > 25.5"
add(
    "having_then_group_by",
    asked(BY_FLAG, base_measures={"qty": {"sql": "l_quantity", "agg": "avg"}}, dimensions=[FLAG, {"name": "l_linenumber"}], having={"predicates": [{"of": "value", "cmp": ">", "value": 25.5}], "then_group_by": ["l_returnflag"]}),
    f"SELECT l_returnflag, round(avg(l_quantity), 4) AS value FROM lineitem SEMI JOIN ({_BIG}) AS b USING (l_returnflag, l_linenumber) WHERE {JUNE} GROUP BY 1",
)

# -- cuts -------------------------------------------------------------------

_G = f"SELECT 'G' AS output_cut, l_returnflag, NULL AS l_linestatus, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 2"
_R = f"SELECT 'R' AS output_cut, l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 2, 3"
CUT_COLUMNS = ["output_cut", "l_returnflag", "l_linestatus", rounded()]
BOTH = {"dimensions": [FLAG, STATUS], "cuts": TWO_CUTS, "default_cut": "G"}
add("cuts_also_emit", asked(CUT_COLUMNS, **BOTH), f"{_G} UNION ALL {_R}")
add("cuts_output_cut", asked(CUT_COLUMNS, parameters={"output_cut": "R"}, **BOTH), _R)
add("cuts_only_cut", asked(["output_cut", "l_returnflag", rounded()], parameters={"only_cut": "G"}, **BOTH), f"SELECT output_cut, l_returnflag, value FROM ({_G})")
add("cuts_emit_cuts", asked(CUT_COLUMNS, parameters={"output_cut": "G", "emit_cuts": ["R"]}, **BOTH), f"{_G} UNION ALL {_R}")
add(
    "cuts_rollup_from",
    asked(CUT_COLUMNS, given={"l_linestatus": ["F"]}, **BOTH | {"cuts": [TWO_CUTS[0] | {"rollup_from": "R", "ignore_filters": ["l_linestatus"]}, TWO_CUTS[1]]}),
    f"SELECT * FROM ({_G} UNION ALL {_R})".replace(JUNE, f"{JUNE} AND l_linestatus = 'F'"),
)
add(
    "cuts_default_measures",
    asked([*CUT_COLUMNS, rounded("lines")], NOW | {"lines": {"of": "n", "op": "point"}}, keys=["value", "lines"], **BOTH, default_measures_by_cut={"G": ["value"], "R": ["lines"]}, base_measures=SUM | {"n": {"sql": "l_quantity", "agg": "count"}}),
    f"SELECT output_cut, l_returnflag, l_linestatus, value, CAST(NULL AS DOUBLE) AS lines FROM ({_G}) UNION ALL SELECT 'R', l_returnflag, l_linestatus, NULL, CAST(count(*) AS DOUBLE) FROM lineitem WHERE {JUNE} GROUP BY 2, 3",
)
add("cuts_dropped", asked(["output_cut", "l_returnflag", rounded()], **BOTH | {"cuts": [{"name": "G", "exclude_from_grain": ["l_linestatus"], "also_emit": ["X"]}, {"name": "X", "group_by": ["no_such_column"]}]}), f"SELECT output_cut, l_returnflag, value FROM ({_G})")
add("selected_dimensions", asked(["l_linestatus", rounded()], dimensions=[FLAG, STATUS], selected={"l_linestatus": True, "l_returnflag": False}), f"SELECT l_linestatus, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 1")
add("row_set_anchor_only", asked(["l_linenumber", "l_suppkey", rounded()], {"value": {"of": "qty", "op": "window", "trailing": {"months": 3}}}, dimensions=[{"name": "l_linenumber"}, {"name": "l_suppkey"}], row_set="anchor_only"), f"SELECT l_linenumber, l_suppkey, sum(l_quantity) AS value FROM lineitem SEMI JOIN (SELECT l_linenumber, l_suppkey FROM lineitem WHERE {JUNE}) AS a USING (l_linenumber, l_suppkey) WHERE l_shipdate >= DATE '1998-04-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1, 2")
add("omit_null_rows", asked(["l_suppkey", rounded()], NOW | {"old": {"of": "qty", "op": "point", "offset": {"months": 1}}}, keys=["value"], dimensions=[{"name": "l_suppkey"}], omit_null_rows=True), f"SELECT l_suppkey, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 1")
add("green_when", asked([*BY_FLAG, "green"], green_when={"of": "value", "above": 1000}), f"SELECT *, value >= 1000 AS green FROM ({by_flag('sum(l_quantity)')})")
add(
    "identity_grain",
    asked(["l_orderkey", "l_linenumber", "l_partkey", rounded()], {"value": {"of": "net", "op": "point"}}, dimensions=[{"name": n} for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], identity_grain=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], base_measures={"net": {"expr": "l_extendedprice * (1 - l_discount)"}}),
    f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS value FROM lineitem WHERE {JUNE}",
)

# -- several models -----------------------------------------------------------

SHIPPED = {"model_id": "shipped", "kind": "sql", "required_aliases": ["lineitem"], "sql": "SELECT l_shipdate AS day, l_suppkey % 7 AS bucket, l_quantity FROM $lineitem_scan"}
BOOKED = {"model_id": "booked", "kind": "sql", "required_aliases": ["orders"], "sql": "SELECT o_orderdate AS day, o_custkey % 9 + 2 AS bucket, o_totalprice FROM $orders_scan"}
RATIO = {
    "time": MONTH | {"column": "day"},
    "dimensions": [{"name": "bucket"}],
    "base_measures": SUM | {"total": {"sql": "o_totalprice", "agg": "sum", "model": "booked"}, "mean": {"sql": "o_totalprice", "agg": "avg", "model": "booked"}},
    "measures": {"shipped": {"of": "qty", "op": "point"}, "booked": {"of": "total", "op": "window", "trailing": {"months": 2}}, "mean": {"of": "mean", "op": "point"}, "value": {"op": "arithmetic", "fn": "divide", "left": "booked", "right": "shipped"}},
}
_SIDES = f"""WITH s AS (SELECT date_trunc('month', l_shipdate) AS p, l_suppkey % 7 AS bucket, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= DATE '1998-05-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1, 2),
 b AS (SELECT date_trunc('month', o_orderdate) AS p, o_custkey % 9 + 2 AS bucket, sum(o_totalprice) AS t, count(o_totalprice) AS n FROM orders WHERE o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-07-01' GROUP BY 1, 2)"""
for _how in ("outer", "inner", "left", "right"):
    add(
        f"relation_{_how}",
        asked(["bucket", rounded("value", 6), rounded("mean", 6)], RATIO["measures"], models=[SHIPPED, BOOKED], tables=("lineitem", "orders"), keys=["value", "mean"], model_relations=[{"left": "qty", "right": "total", "on": ["day", "bucket"], "how": _how}], **{k: v for k, v in RATIO.items() if k != "measures"}),
        f"{_SIDES} SELECT bucket, round(coalesce(sum(t), 0) / nullif(sum(CASE WHEN p = DATE '1998-06-01' THEN coalesce(q, 0) END), 0), 6) AS value, round(sum(CASE WHEN p = DATE '1998-06-01' THEN t END) / sum(CASE WHEN p = DATE '1998-06-01' THEN n END), 6) AS mean FROM s {'FULL' if _how == 'outer' else _how.upper()} JOIN b USING (p, bucket) GROUP BY 1",
    )
add(
    "pipelines_isolated",
    asked(["model", "bucket", rounded("shipped", 2), rounded("booked", 2)], RATIO["measures"], models=[SHIPPED, BOOKED], tables=("lineitem", "orders"), keys=["shipped", "booked"], **{k: v for k, v in RATIO.items() if k != "measures"}),
    f"SELECT 'shipped' AS model, l_suppkey % 7 AS bucket, round(sum(l_quantity), 2) AS shipped, CAST(NULL AS DOUBLE) AS booked FROM lineitem WHERE {JUNE} GROUP BY 2 UNION ALL SELECT 'booked', o_custkey % 9 + 2, NULL, round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-07-01' GROUP BY 2",
)

# -- bases and dimensions -----------------------------------------------------

POINT = {"value": {"of": "x", "op": "point"}}


def based(bases: dict, sql: str, **kpi) -> tuple[Query, str]:
    return asked(BY_FLAG, POINT, base_measures=bases, **kpi), by_flag(sql)


add("base_columns_op", *based({"x": {"columns": {"a": "l_extendedprice", "b": "l_discount"}, "op": "multiply", "agg": "sum"}}, "sum(l_extendedprice * l_discount)"))
add("base_expr", *based({"x": {"expr": "case when l_discount > 0.05 then l_quantity * 2 else l_quantity end", "agg": "sum"}}, "sum(CASE WHEN l_discount > 0.05 THEN l_quantity * 2 ELSE l_quantity END)"))
add("base_formula_in_sql", *based({"x": {"sql": "l_extendedprice * (1 - l_discount)", "agg": "sum"}}, "sum(l_extendedprice * (1 - l_discount))"))
add("base_helpers", *based({"net": {"expr": "l_extendedprice * (1 - l_discount)"}, "taxed": {"expr": "net * (1 + l_tax)"}, "x": {"columns": ["taxed", "net"], "op": "subtract", "agg": "sum"}}, "sum(l_extendedprice * (1 - l_discount) * l_tax)"))
add("base_lookup", *based({"w": {"lookup": {"column": "l_linestatus", "map": {"O": 2}, "default": 1}}, "x": {"expr": "l_quantity * w", "agg": "sum"}}, "sum(l_quantity * CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END)"))
add("base_lookup_keys", *based({"w": {"lookup": {"keys": ["l_linestatus", "l_linenumber"], "map": {"O|1": 5, "F|2": 7}, "default": 1}}, "x": {"expr": "l_quantity * w", "agg": "sum"}}, "sum(l_quantity * CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 5 WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 7 ELSE 1 END)"))
add("base_lookup_dated", *based({"w": {"lookup": {"column": "l_linestatus", "map": [{"key": "O", "value": 3, "valid_to": "1998-05-31"}, {"key": "O", "value": 4, "valid_from": "1998-06-01"}], "default": 0}}, "x": {"expr": "l_quantity * w", "agg": "sum"}}, "sum(CASE l_linestatus WHEN 'O' THEN l_quantity * 4 ELSE 0 END)"))
add(
    "base_over",
    asked(BY_FLAG, POINT, base_measures={"place": {"over": {"fn": "row_number", "partition_by": ["l_suppkey"], "order_by": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]}}, "x": {"expr": "case when place = 1 then l_quantity else 0 end", "agg": "sum"}}),
    f"SELECT l_returnflag, sum(CASE WHEN k = 1 THEN l_quantity ELSE 0 END) AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE {JUNE}) GROUP BY 1",
)
add("dimension_map", asked(["kind", rounded()], dimensions=[{"name": "kind", "from": "l_returnflag", "map": {"A": "accepted", "R": "returned"}, "default": "other"}]), f"SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END AS kind, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 1")
add("dimension_grain", asked(["date_format(week, 'yyyy-MM-dd') as week", rounded()], dimensions=[{"name": "week", "from": "l_shipdate", "grain": "week"}]), f"SELECT strftime(date_trunc('week', l_shipdate), '%Y-%m-%d') AS week, sum(l_quantity) AS value FROM lineitem WHERE {JUNE} GROUP BY 1")

# -- time -------------------------------------------------------------------


def ranged(window: dict, first: str, end: str, **more) -> tuple[Query, str]:
    return asked(BY_FLAG, {"value": {"of": "qty", "op": "window", **window}}, **more), by_flag("sum(l_quantity)", f"l_shipdate >= DATE '{first}' AND l_shipdate < DATE '{end}'")


FISCAL = MONTH | {"calendar": "fiscal", "fiscal_start_month": 4}
DAY = MONTH | {"grain": "day"}
PARTS = {"column": "l_shipdate", "grain": "month", "periods": {"year": "y", "quarter": "q", "month": "m"}}
add("range_wtd", *ranged({"range": "wtd"}, "1998-06-15", "1998-06-19", month="1998-06-18", time=DAY))
add("range_mtd_day", *ranged({"range": "mtd"}, "1998-06-01", "1998-06-19", month="1998-06-18", time=DAY))
add("range_fiscal_ytd", *ranged({"range": "ytd"}, "1997-04-01", "1998-03-01", month="1998-02", time=FISCAL))
add("range_fiscal_full_quarter", *ranged({"range": "full_quarter"}, "1998-04-01", "1998-07-01", month="1998-05", time=FISCAL | {"fiscal_start_month": 1}))
add("range_align_periods", *ranged({"trailing": {"months": 2}, "align": "periods"}, "1998-06-17", "1998-06-19", month="1998-06-18", time=DAY))
add("range_data_points", *ranged({"trailing": {"from": "data_points"}}, "1998-03-01", "1998-07-01", data_points={"month": 4}))
add("time_grain_quarter", *ranged({"trailing": 2}, "1998-01-01", "1998-07-01", parameters={"time_grain": "quarter"}, time=MONTH | {"grains": ["month", "quarter"]}))
add("time_fiscal_year", *ranged({"trailing": 1}, "1997-04-01", "1998-04-01", time=FISCAL | {"grain": "year"}, month="1998-02"))
add("time_parts", asked(BY_FLAG, given={"y": [1997, 1998], "m": ["March", "04"]}, month=None, time=PARTS), by_flag("sum(l_quantity)", "year(l_shipdate) IN (1997, 1998) AND month(l_shipdate) IN (3, 4)"))
add("time_parts_week", asked(BY_FLAG, given={"y": [1998], "w": [1, 53]}, month=None, time={"column": "l_shipdate", "grain": "week", "periods": {"year": "y", "week": "w"}}), by_flag("sum(l_quantity)", "isoyear(l_shipdate) = 1998 AND weekofyear(l_shipdate) IN (1, 53)"))
add("time_parts_day", asked(BY_FLAG, given={"y": [1998], "d": [3, "04"]}, month=None, time={"column": "l_shipdate", "grain": "day", "periods": {"year": "y", "day": "d"}}), by_flag("sum(l_quantity)", "year(l_shipdate) = 1998 AND day(l_shipdate) IN (3, 4)"))
add("time_parts_unbounded", asked(BY_FLAG, given={"m": [6]}, month=None, time=PARTS), by_flag("sum(l_quantity)", "month(l_shipdate) = 6"))
add("time_year_basis", asked(BY_FLAG, {"value": {"of": "qty", "op": "window", "range": "ytd"}}, given={"y": [1998], "m": [6]}, month=None, time=PARTS | {"calendar": "fiscal", "fiscal_start_month": 4}), by_flag("sum(l_quantity)", "l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-07-01'"))
add("time_fiscal_quarter_part", asked(BY_FLAG, given={"y": [1998], "q": [1]}, month=None, time=PARTS | {"calendar": "fiscal", "fiscal_start_month": 4}), by_flag("sum(l_quantity)", "l_shipdate >= DATE '1998-04-01' AND l_shipdate < DATE '1998-07-01'"))
add("time_last_observed", asked(BY_FLAG, month=None, time={"column": "l_shipdate", "grain": "month", "anchor": "last_observed"}), by_flag("sum(l_quantity)", "date_trunc('month', l_shipdate) = (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem)"))
add("time_unbounded", asked(BY_FLAG, month=None), by_flag("sum(l_quantity)", "TRUE"))
add(
    "op_expanding_window_mixed",
    asked(["l_returnflag", rounded(), rounded("old")], {"value": {"of": "qty", "op": "expanding_window"}, "old": {"of": "qty", "op": "point", "offset": {"years": 1}}}, keys=["value", "old"]),
    "SELECT l_returnflag, sum(l_quantity) AS value, sum(CASE WHEN l_shipdate < DATE '1997-07-01' THEN l_quantity END) AS old FROM lineitem WHERE l_shipdate >= DATE '1997-06-01' AND l_shipdate < DATE '1998-07-01' GROUP BY 1",
)
