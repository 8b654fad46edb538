"""The engine on the sparse monthly fixture, whose values are known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricloom import api
from metricloom.errors import BindError, ContextError, FilterError, TimePlanError
from metricloom.functions.column import COLUMN_FUNCTIONS
from metricloom.functions.measure import MEASURE_FUNCTIONS
from metricloom.operators import expressions
from metricloom.operators.filters import mask, predicate
from metricloom.plans import calendar as cal

MODEL = {"kind": "physical", "sources": {"fact": {"alias": "fact"}}, "joins": []}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rows = []
    for region, reason, base in (("NA", "LATE", 10), ("EU", "LATE", 5), ("NA", "OTHER", 2)):
        for k in range(15):
            year, month = 2025 + k // 12, k % 12 + 1
            if (region, reason, year, month) != ("NA", "LATE", 2025, 3):
                rows.append((dt.date(year, month, 1), region, reason, base * month))
    to = str(tmp_path_factory.mktemp("fact") / "f.parquet")
    spark.createDataFrame(rows, "event_month date, region string, reason_code string, amount int").write.parquet(to)
    return to


def kpi(**more):
    spec = {
        "kpi_id": 1,
        "time": {"column": "event_month", "grain": "month", "filter_code": "month"},
        "dimensions": [{"name": "reason_code"}, {"name": "region"}],
        "default_dimensions": ["reason_code"],
        "base_measures": {"value": {"sql": "amount", "agg": "sum"}},
        "cuts": [{"name": "G", "exclude_from_grain": ["region"], "ignore_filters": ["region"], "also_emit": ["R"]}, {"name": "R", "group_by": ["region"]}],
        "default_cut": "G",
        "measures": {
            "current": {"of": "value", "op": "point"},
            "previous": {"of": "value", "op": "point", "offset": {"years": 1}},
            "three": {"of": "value", "op": "window", "trailing": {"months": 3}},
            "yoy": {"op": "arithmetic", "fn": "growth_pct", "left": "current", "right": "previous"},
            "trend": {"of": "value", "op": "trend", "trailing": {"months": 12}, "cuts": ["G"]},
            "rank": {"op": "rank", "of": "current"},
        },
    }
    return spec | more


def context(path, measures, month="2026-03", filters=None, **more):
    return {
        "execution": {"kpi_id": 1, "request_id": "r", "view_details": [{"view_id": 1, "measures_required": [{"measure_key": m} for m in measures]}]},
        "filters": {"month": {"value": [month]}} | (filters or {}),
        "datasets": {"Fact": {"alias": "fact", "path": path}},
        **more,
    }


def plain(cell):
    """The number of a cell that has its period beside it."""
    return cell["value"] if isinstance(cell, dict) and "value" in cell else cell


def rows(spark, path, measures, spec=None, **more):
    out = api.compute(context(path, measures, **more), spark=spark, kpi=spec or kpi(), model=MODEL)
    return {(r["output_cut"], r["reason_code"], r.get("region")): {k: plain(v) for k, v in r.items()} for r in out["rows"]}, out


def test_worked_example(spark, path):
    got, out = rows(spark, path, ["current", "previous", "three", "yoy"])
    values = {k: [r[c] for c in ("current", "previous", "three", "yoy")] for k, r in got.items()}
    assert values == {
        ("G", "LATE", None): [45.0, 15.0, 90.0, 2.0],
        ("R", "LATE", "NA"): [30.0, None, 60.0, None],
        ("R", "LATE", "EU"): [15.0, 15.0, 30.0, 0.0],
        ("G", "OTHER", None): [6.0, 6.0, 12.0, 0.0],
        ("R", "OTHER", "NA"): [6.0, 6.0, 12.0, 0.0],
    }
    assert len(out) == 21 and [c["name"] for c in out["applied_cuts"]] == ["G", "R"]


def test_trend_and_labels(spark, path):
    got, out = rows(spark, path, ["trend", "rank"])
    assert [x["value"] for x in got["G", "OTHER", None]["trend"]] == [8, 10, 12, 14, 16, 18, 20, 22, 24, 2, 4, 6]
    assert out["trend_labels"]["trend"][0] == "Apr 2025" and got["G", "LATE", None]["rank"] == 1


def test_filters_and_pages(spark, path):
    got, _ = rows(spark, path, ["current"], filters={"region": {"values": ["EU"]}})
    assert got["G", "LATE", None]["current"] == 45 and ("R", "LATE", "NA") not in got
    _, out = rows(spark, path, ["current"], output={"page": 2, "page_size": 2})
    assert out["pagination"] == {"page": 2, "page_size": 2, "total_count": 5, "has_more": True} and len(out["rows"]) == 2


def test_zero_and_null_rules(spark, path):
    got, _ = rows(spark, path, ["current", "three"], month="2026-05")
    assert got["G", "OTHER", None]["current"] is None  # unobserved
    got, _ = rows(spark, path, ["three", "w"], kpi(measures=kpi()["measures"] | {"w": {"of": "low", "op": "window", "trailing": {"months": 2}}}, base_measures=kpi()["base_measures"] | {"low": {"sql": "amount", "agg": "min"}}), month="2026-05")
    assert got["G", "OTHER", None]["three"] == 6.0 and got["G", "OTHER", None]["w"] is None


def test_parameters_choose(spark, path):
    spec = kpi(parameters={"which": {"default": "a"}})
    spec["measures"]["picked"] = {"when": [{"if": {"param": "which", "eq": "b"}, "then": {"of": "value", "op": "point", "offset": {"years": 1}}}], "else": {"of": "value", "op": "point"}}
    assert rows(spark, path, ["picked"], spec)[0]["G", "LATE", None]["picked"] == 45
    assert rows(spark, path, ["picked"], spec, parameters={"which": "b"})[0]["G", "LATE", None]["picked"] == 15


def test_values_of_other_cuts(spark, path):
    spec = kpi(default_cut="R")
    spec["measures"] |= {"share": {"op": "percent_of_total", "of": "current", "versus_cut": "G"}, "wide": {"of": "value", "op": "point", "from_cut": "G", "cuts": ["R"]}, "fine": {"of": "value", "op": "point", "from_cut": "R", "cuts": ["G"]}}
    got, _ = rows(spark, path, ["share", "wide"], spec, filters={"region": {"values": ["EU"]}})
    assert got["R", "LATE", "EU"]["wide"] == 45 and got["R", "LATE", "EU"]["share"] == pytest.approx(15 * 100 / 51)
    with pytest.raises(BindError):
        rows(spark, path, ["fine"], spec | {"default_cut": "G"})


def test_pushdown(spark, path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = api.compute_df(context(path, ["current", "previous"]), spark=spark, kpi=kpi(), model=MODEL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(event_month,2025-03-01)" in pushed and "LessThan(event_month,2026-04-01)" in pushed


def test_errors(spark, path):
    with pytest.raises(BindError):
        rows(spark, path, ["nothing"])
    with pytest.raises(ContextError):
        api.compute({}, spark=spark, kpi=kpi(), model=MODEL)
    with pytest.raises(FilterError):
        rows(spark, path, ["current"], filters={"color": {"value": "red"}})
    with pytest.raises(BindError):
        expressions.parse("a +")
    with pytest.raises(TimePlanError):
        cal.Offset.of({"months": 1, "periods": 1})


def test_calendar():
    d = dt.date
    assert cal.add_months(d(2024, 3, 31), -1) == d(2024, 2, 29)
    assert cal.truncate(d(2026, 2, 10), "year", 4) == d(2025, 4, 1)
    assert cal.window_bounds(d(2026, 3, 1), "month", {"trailing": {"months": 3}, "inclusive": False}) == (d(2025, 12, 1), d(2026, 2, 1))
    assert cal.window_bounds(d(2026, 2, 1), "month", {"range": "full_quarter"}) == (d(2026, 1, 1), d(2026, 3, 1))
    assert cal.selection({"year": 2026, "month": ["March", "04"]}, "month") == (d(2026, 3, 1), d(2026, 4, 1))
    assert cal.label(d(2026, 7, 20), "week") == "2026-W30" and cal.label(d(2026, 1, 1), "quarter") == "2026-Q1"


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, None, "A"), (0.0, 2.0, "B")], "x double, y double, s string")
    value = lambda text: [r[0] for r in df.select(expressions.compile_(text, F.col, COLUMN_FUNCTIONS)).collect()]
    assert value("x / 0") == [None, None] and value("x + 2 * 3") == [7, 6] and value("-x - 1") == [-2, -1]
    assert value("case when s in ('A',) then 1 else 2 end") == [1, 2] and value("y is null") == [1, 0]
    assert value("x = 1 or y = 1") == [1, 0] and value("not (y = 2)") == [None, 0] and value("max(x, y)") == [1, 2]


def test_masks_and_functions(spark):
    df = spark.createDataFrame([("a\\b", 1.0), (None, 2.0), ("ab", 3.0)], "s string, v double")
    keep = lambda c: [r.v for r in df.filter(c).collect()]
    assert keep(predicate(F.col("s"), "like", "a\\%")) == [1.0] and keep(predicate(F.col("s"), "ne", "ab")) == [1.0]
    assert keep(mask({"not": {"column": "s", "op": "eq", "value": "ab"}}, F.col)) == [1.0] and keep(predicate(F.col("s"), "in", [])) == []
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(COLUMN_FUNCTIONS["right"](F.lit("abc"), 0)) == "abc" and one(COLUMN_FUNCTIONS["left"](F.lit("abc"), -1)) == "ab"
    assert one(COLUMN_FUNCTIONS["round"](F.lit(2.5))) == 2 and one(MEASURE_FUNCTIONS["date_add"](F.lit("2024-01-31"), 1, "month")) == "2024-02-29"
