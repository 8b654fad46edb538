"""Request and planning features, on a small shop of which every number is known."""

import datetime as dt
import json

import pytest

from metricloom import api, plugins
from metricloom.errors import BindError, CatalogError, FilterError, TimePlanError
from metricloom.plans import calendar as cal
from metricloom.plans import definition

MODEL = {"model_id": "shop", "kind": "physical", "sources": {"sales": {"alias": "sales"}}, "joins": []}
ADS = {"model_id": "ads", "kind": "physical", "sources": {"ads": {"alias": "ads"}}, "joins": []}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Sales of two shops and two goods by month, with a null good; ads by shop."""
    at = tmp_path_factory.mktemp("shop")
    rows = [(dt.date(2025 + k // 12, k % 12 + 1, 5), shop, good, unit * (k + 1), f"{shop}{good}{k}") for k in range(18) for shop, good, unit in (("north", "tea", 2.0), ("south", "tea", 1.0), ("north", "rice", 4.0))]
    rows += [(dt.date(2026, 3, 9), "south", None, 7.0, "x")]
    spark.createDataFrame(rows, "day date, shop string, good string, amount double, id string").write.parquet(f"{at}/sales.parquet")
    ads = [(dt.date(2026, 3, 1), "north", 10.0), (dt.date(2026, 2, 1), "north", 5.0), (dt.date(2026, 2, 1), "south", 4.0), (dt.date(2026, 3, 1), "west", 3.0)]
    spark.createDataFrame(ads, "day date, shop string, spend double").write.parquet(f"{at}/ads.parquet")
    return at


def kpi(**more):
    return {
        "kpi_id": 7,
        "model": "shop",
        "time": {"column": "day", "grain": "month", "filter_code": "month"},
        "dimensions": [{"name": "shop"}, {"name": "good"}],
        "default_dimensions": ["good"],
        "base_measures": {"sales": {"sql": "amount", "agg": "sum"}},
        "cuts": [{"name": "all", "exclude_from_grain": ["shop"], "ignore_filters": ["shop"], "also_emit": ["shops"]}, {"name": "shops", "group_by": ["shop"]}],
        "default_cut": "all",
        "measures": {"now": {"of": "sales", "op": "point"}, "quarter": {"of": "sales", "op": "window", "trailing": {"months": 3}}, "share": {"op": "percent_of_total", "of": "now", "cuts": ["all"]}},
    } | more


def ask(spark, files, measures, spec, filters=None, month="2026-03", models=None, **more):
    context = {
        "execution": {"kpi_id": 7, "request_id": "q", "view_details": [{"view_id": 1, "measures_required": [{"measure_key": m} for m in measures]}]},
        "filters": ({"month": {"value": [month]}} if month else {}) | (filters or {}),
        "datasets": {n: {"alias": n, "path": f"{files}/{n}.parquet", "filter_column_mappings": [{"filter_code": "Shop Name", "column_name": "shop", "operator": "in"}]} for n in ("sales", "ads")},
        **more,
    }
    return api.compute(context, spark=spark, kpi=spec, model=models or [MODEL, ADS])


def by_key(out, measure, *keys):
    cell = lambda v: v["value"] if isinstance(v, dict) and "value" in v else v
    return {tuple(r.get(k) for k in keys): cell(r[measure]) for r in out["rows"]}


def test_stages(spark, files):
    for stage, share in (("extract", 100.0), ("calc", 100.0), ("result", 45 / (45 + 60 + 7) * 100)):
        out = ask(spark, files, ["now", "share"], kpi(filters={"goods": {"column": "good", "op": "IN", "apply": stage}}), {"goods": {"values": ["tea"]}})
        assert by_key(out, "share", "output_cut", "good")["all", "tea"] == pytest.approx(share)
        assert {r["good"] for r in out["rows"]} == {"tea"} and out["applied_filters"][0]["stage"] == stage
    out = ask(spark, files, ["now"], kpi(filters={"s": {"column": "shop", "apply": "result"}}), {"s": {"values": ["north"]}})
    assert {"filter_code": "s", "reason": "not_in_grain"} in out["skipped_filters"] and {r["shop"] for r in out["rows"] if r["output_cut"] == "shops"} == {"north"}


def test_spellings_and_arity(spark, files):
    for op, values, good in (("NOT  LIKE", ["r%"], {"tea"}), ("notnull", [], {"tea", "rice"}), ("Is Null", [], {None}), ("not between", [30, 70], {"tea", None}), ("Regex", ["^t"], {"tea"}), ("==", ["rice"], {"rice"})):
        column = "amount" if "between" in op else "good"
        out = ask(spark, files, ["now"], kpi(filters={"f": {"column": column, "op": op}}, cuts=[{"name": "all"}]), {"f": {"values": values}})
        assert {r["good"] for r in out["rows"] if r["now"] is not None} == good, op
    with pytest.raises(FilterError):
        ask(spark, files, ["now"], kpi(filters={"f": {"column": "amount", "op": "between"}}), {"f": {"values": [1]}})
    with pytest.raises(BindError):
        definition.filter_specs({"filters": {"f": {"op": "near"}}})


def test_required_default_map_and_compose(spark, files):
    with pytest.raises(BindError, match="required"):
        ask(spark, files, ["now"], kpi(filters={"shop": {"column": "shop", "required": True}}))
    with pytest.raises(BindError, match="required: true and default"):
        ask(spark, files, ["now"], kpi(filters={"shop": {"column": "shop", "required": True, "default": ["north"]}}))
    spec = kpi(filters={"shop": {"column": "shop", "default": ["north"]}})
    assert {r["shop"] for r in ask(spark, files, ["now"], spec)["rows"]} == {None, "north"}
    assert {r["shop"] for r in ask(spark, files, ["now"], spec, {"shop": {"values": []}})["rows"]} == {None, "north", "south"}
    assert {r["shop"] for r in ask(spark, files, ["now"], kpi(filter_map={"place": "shop"}), {"place": {"values": ["south"]}})["rows"] if r["output_cut"] == "shops"} == {"south"}
    assert {r["shop"] for r in ask(spark, files, ["now"], kpi(), {"Shop Name": {"value": ["south"]}})["rows"] if r["output_cut"] == "shops"} == {"south"}
    out = ask(spark, files, ["now"], kpi(filters={"id": {"column": "id", "op": "eq", "compose": {"template": "{a}{b}{n:02}"}}}, cuts=[{"name": "all"}]), {"a": {"values": ["north"]}, "b": {"values": ["tea"]}, "n": {"values": [14]}})
    assert by_key(out, "now", "good") == {("tea",): 30.0}
    spec = kpi(time={"column": "day", "grain": "month", "compose": {"template": "{year}{month:02}"}, "format": "yyyymm"})
    out = ask(spark, files, ["now"], spec, {"year": {"value": [2026]}, "month": {"value": [3]}}, month=None)
    assert out["parameters"]["anchor"] == "2026-03-01" and by_key(out, "now", "output_cut", "good")["all", "tea"] == 45
    with pytest.raises(TimePlanError):
        ask(spark, files, ["now"], spec, {"year": {"value": [2026]}}, month=None)
    with pytest.raises(BindError):
        definition.template_names("{year}")
    with pytest.raises(BindError):
        definition.template_names("{year}{month")


def test_measure_filters_and_having(spark, files):
    spec = kpi(cuts=[{"name": "all"}])
    spec["measures"] |= {"whole": {"of": "sales", "op": "point", "ignore_filters": ["shop"]}, "big": {"of": "sales", "op": "point", "having": {"match": "any", "predicates": [{"of": "quarter", "cmp": "gt", "value": 100}, {"of": "now", "cmp": "between", "low": 6, "high": 8}]}}, "above": {"of": "sales", "op": "point", "having": {"predicates": [{"of": "whole", "cmp": "gt", "vs": "now"}]}}}
    out = ask(spark, files, ["now", "whole"], spec, {"shop": {"values": ["north"]}})
    assert by_key(out, "now", "good") == {("tea",): 30.0, ("rice",): 60.0, (None,): None} and by_key(out, "whole", "good") == {("tea",): 45.0, ("rice",): 60.0, (None,): 7.0}
    assert out["applied_filters"][0]["stage"] == "calc"
    assert by_key(ask(spark, files, ["big"], spec), "big", "good") == {("tea",): 45.0, ("rice",): 60.0, (None,): 7.0}
    assert by_key(ask(spark, files, ["above"], spec, {"shop": {"values": ["north"]}}), "above", "good") == {("tea",): 30.0, ("rice",): None, (None,): None}


def test_having_drops_and_regroups(spark, files):
    spec = kpi(default_dimensions=["good", "shop"], cuts=[{"name": "all"}], base_measures={"sales": {"sql": "amount", "agg": "avg"}}, having={"predicates": [{"of": "now", "cmp": "gt", "value": 20}]})
    out = ask(spark, files, ["now"], spec)
    assert by_key(out, "now", "good", "shop") == {("tea", "north"): 30.0, ("rice", "north"): 60.0} and out["quality_flags"] == {"having_dropped": True}
    assert sorted((d["key"]["good"] or "", d["key"]["shop"]) for d in out["dropped_groups"]) == [("", "south"), ("tea", "south")]
    spec["having"]["then_group_by"] = ["shop"]
    out = ask(spark, files, ["now"], spec)
    assert by_key(out, "now", "shop", "good") == {("north", None): 45.0} and out["rows"][0]["grouped_dimensions"] == ["shop"]
    with pytest.raises(BindError):
        ask(spark, files, ["now"], spec | {"having": spec["having"] | {"then_group_by": ["color"]}})


def test_cuts(spark, files):
    rolled = kpi(cuts=[{"name": "all", "exclude_from_grain": ["shop"], "rollup_from": "shops", "ignore_filters": ["shop"], "also_emit": ["shops"]}, {"name": "shops", "group_by": ["shop"]}])
    out = ask(spark, files, ["now"], rolled, {"shop": {"values": ["south"]}})
    assert by_key(out, "now", "output_cut", "good")["all", "tea"] == 15.0  # the child cut's rows
    for bad in ({"rollup_from": "none"}, {"inherit_filters": ["shop"], "ignore_filters": ["shop"]}, {"rollup_from": "all"}):
        with pytest.raises(BindError):
            ask(spark, files, ["now"], kpi(cuts=[{"name": "all"} | bad]))
    chosen = kpi(default_measures_by_cut={"all": ["now"], "shops": ["quarter"]})
    out = ask(spark, files, ["now", "quarter"], chosen)
    assert all((r["now"] is not None or r["good"] is None) == (r["output_cut"] == "all") for r in out["rows"] if r["good"]) and all(r["quarter"] is None for r in out["rows"] if r["output_cut"] == "all")
    wide = kpi(cuts=[{"name": "all", "exclude_from_grain": ["shop"], "also_emit": ["colors"]}, {"name": "colors", "group_by": ["color"]}])
    assert ask(spark, files, ["now"], wide)["dropped_cuts"] == [{"name": "colors", "reason": "missing_dimensions", "dimensions": ["color"]}]
    with pytest.raises(BindError):
        ask(spark, files, ["now"], wide | {"default_cut": "colors"})
    assert {r["output_cut"] for r in ask(spark, files, ["now"], kpi(), parameters={"only_cut": "shops"})["rows"]} == {"shops"}
    assert {r["output_cut"] for r in ask(spark, files, ["now"], kpi(), parameters={"output_cut": "all", "emit_cuts": ["shops"]})["rows"]} == {"all", "shops"}
    with pytest.raises(BindError):
        ask(spark, files, ["now"], kpi(measures={"now": {"of": "sales", "op": "point", "versus_cut": "all"}}))


def ratio(how):
    return kpi(
        dimensions=[{"name": "shop"}], default_dimensions=["shop"], cuts=[{"name": "shops"}], default_cut="shops",
        base_measures={"sales": {"sql": "amount", "agg": "sum"}, "each": {"sql": "amount", "agg": "avg"}, "spend": {"sql": "spend", "agg": "sum", "model": "ads"}},
        model_relations=[{"left": "sales", "right": "spend", "on": ["day", "shop"], "how": how}],
        measures={"now": {"of": "sales", "op": "point"}, "cost": {"of": "spend", "op": "point"}, "mean": {"of": "each", "op": "point"}, "per": {"op": "arithmetic", "fn": "divide", "left": "now", "right": "cost"}},
    )


def test_relations(spark, files):
    want = {"outer": {"north": 9.0, "south": None, "west": 0.0}, "inner": {"north": 9.0}, "left": {"north": 9.0, "south": None}, "right": {"north": 9.0, "west": 0.0}}
    for how, values in want.items():
        out = ask(spark, files, ["now", "cost", "per"], ratio(how), {"Shop Name": {"value": ["north", "south", "west"]}})
        assert {r["shop"]: r["per"] and r["per"]["value"] for r in out["rows"]} == values, how
    assert {r["shop"]: r["mean"] and r["mean"]["value"] for r in ask(spark, files, ["per", "mean"], ratio("left"))["rows"]} == {"north": 45.0, "south": 11.0}
    # apart where no measure needs both
    out = ask(spark, files, ["now", "cost"], ratio("outer"))
    assert {(r["model"], r["shop"]): (r["now"] and r["now"]["value"], r["cost"] and r["cost"]["value"]) for r in out["rows"]} == {("shop", "north"): (90.0, None), ("shop", "south"): (22.0, None), ("ads", "north"): (None, 10.0), ("ads", "west"): (None, 3.0)}
    assert len(out["sqls"]) == 2
    lone = ratio("outer")
    del lone["model_relations"]
    with pytest.raises(BindError, match="spans models"):
        ask(spark, files, ["per"], lone)
    assert {r["model"] for r in ask(spark, files, ["now"], lone)["rows"]} == {"shop"}
    median = ratio("outer")
    median["base_measures"]["spend"]["agg"] = "median"
    with pytest.raises(BindError):
        ask(spark, files, ["per"], median)


def test_time(spark, files):
    parts = {"column": "day", "grain": "month", "periods": {"year": "year", "month": "month part"}}
    out = ask(spark, files, ["now"], kpi(time=parts), {"year": {"value": [2026]}, "month part": {"value": ["Mar", "01"]}}, month=None)
    assert by_key(out, "now", "output_cut", "good")["all", "tea"] == 39 + 45 and out["rows"][0]["now"]["period_start"] == "2026-01-01"
    out = ask(spark, files, ["now"], kpi(time=parts), {"month part": {"value": [3]}}, month=None)  # March of all years
    assert by_key(out, "now", "output_cut", "good")["all", "tea"] == 9 + 45
    out = ask(spark, files, ["now"], kpi(time=parts), {"year": {"value": [2026]}, "month part": {"value": [13]}}, month=None)
    assert out["rows"] == [] and out["notes"][0]["code"] == "empty_time_selection" and out["quality_flags"]["empty_result"]
    newest = kpi(time=parts | {"anchor": "last_observed"})
    assert ask(spark, files, ["now"], newest, month=None)["parameters"]["anchor"] == "2026-06-01"
    # fiscal quarters, calendar years once the request names a year
    fiscal = kpi(time=parts | {"calendar": "fiscal", "fiscal_start_month": 4, "periods": {"year": "year", "quarter": "q", "month": "month part"}})
    fiscal["measures"] |= {"ytd": {"of": "sales", "op": "window", "range": "ytd"}, "qtd": {"of": "sales", "op": "window", "range": "qtd"}}
    out = ask(spark, files, ["ytd"], fiscal, {"year": {"value": [2026]}, "month part": {"value": [3]}}, month=None)
    assert by_key(out, "ytd", "output_cut", "good")["all", "tea"] == 39 + 42 + 45
    assert ask(spark, files, ["now"], fiscal, {"year": {"value": [2025]}, "q": {"value": [2]}}, month=None)["parameters"]["anchor"] == "2025-09-01"
    plain = kpi(time={"column": "day", "grain": "month", "filter_code": "month", "calendar": "fiscal", "fiscal_start_month": 4})
    plain["measures"] = fiscal["measures"]
    assert by_key(ask(spark, files, ["ytd"], plain), "ytd", "output_cut", "good")["all", "tea"] == sum(3 * k for k in range(4, 16))
    assert by_key(ask(spark, files, ["qtd"], plain, month="2025-05"), "qtd", "output_cut", "good")["all", "tea"] == 12 + 15
    # weeks and days; guards
    assert cal.selection({"year": 2026, "week": [1]}, "week") == (dt.date(2025, 12, 29),)
    assert cal.selection({"year": 2026, "month": "sept", "day": [3, "04"]}, "day") == (dt.date(2026, 9, 3), dt.date(2026, 9, 4))
    for bad in ({"year": 2026, "day": 3}, {"year": 2026, "month": "Mars"}, {"year": 2026.0}):
        with pytest.raises(TimePlanError):
            cal.selection(bad, "month")
    with pytest.raises(BindError):
        ask(spark, files, ["now"], kpi(time={"column": "day", "grain": "month", "filter_code": "month", "grains": ["month", "year"]}), parameters={"time_grain": "day"})
    with pytest.raises(BindError):
        ask(spark, files, ["now"], kpi(time={"column": "day", "grain": "month", "source_grain": "month", "filter_code": "month"}), parameters={"time_grain": "day"})
    assert [cal.label(dt.date(2026, 3, 3), g) for g in ("day", "month", "year")] == ["3 Mar", "Mar 2026", "2026"]
    assert cal.parsed("2026/07", "yyyy/mm") == dt.date(2026, 7, 1) and cal.parsed(202607) == dt.date(2026, 7, 1) and cal.parsed("31/12/2025", "dd/mm/yyyy") == dt.date(2025, 12, 31)


def test_expanding_window_has_the_request_span(spark, files):
    spec = kpi(cuts=[{"name": "all"}])
    spec["measures"] |= {"grown": {"of": "sales", "op": "expanding_window"}, "old": {"of": "sales", "op": "point", "offset": {"years": 1}}}
    alone = by_key(ask(spark, files, ["grown"], spec), "grown", "good")["tea",]
    first, last = (by_key(ask(spark, files, keys, spec), "grown", "good")["tea",] for keys in (["grown", "old"], ["old", "grown"]))
    assert alone == 39 + 42 + 45 and first == last == sum(3 * k for k in range(3, 16))


def test_identity_status_and_pages(spark, files):
    one = kpi(default_dimensions=["good", "shop"], identity_grain=["good", "shop"], cuts=[{"name": "all"}], base_measures={"twice": {"expr": "amount * 2"}}, measures={"now": {"of": "twice", "op": "point"}})
    assert by_key(ask(spark, files, ["now"], one), "now", "good", "shop")["tea", "north"] == 60.0
    with pytest.raises(BindError, match="identity_grain"):
        ask(spark, files, ["now"], one | {"cuts": [{"name": "all", "exclude_from_grain": ["shop"]}]})
    with pytest.raises(Exception, match="not unique"):
        ask(spark, files, ["now"], one | {"identity_grain": ["good"], "default_dimensions": ["good"]})
    out = ask(spark, files, ["quarter"], kpi(cuts=[{"name": "all"}], green_when={"of": "now", "above": 45}))
    assert {r["good"]: r["green"] for r in out["rows"]} == {"tea": True, "rice": True, None: False} and out["meta"] == {"of": "now", "above": 45.0}
    spec = kpi(cuts=[{"name": "all"}])
    spec["measures"]["path"] = {"of": "sales", "op": "trend", "trailing": {"months": 6}}
    out = ask(spark, files, ["path"], spec, output={"trend_page": 2, "trend_page_size": 4})
    assert [x["period"] for x in out["rows"][0]["path"]] == ["2026-02-01", "2026-03-01"] and len(out["trend_axes"]["path"]) == 6
    out = ask(spark, files, ["now"], spec, output={"page": 2, "page_size": 2})
    assert out["pagination"] == {"page": 2, "page_size": 2, "total_count": 3, "has_more": False} and len(out["rows"]) == 1
    assert [n["code"] for n in ask(spark, files, ["now"], spec, month="2027-01")["notes"]] == ["unobserved_anchor"]
    must = kpi(cuts=[{"name": "all"}])
    must["measures"]["now"]["required"] = True
    assert {n["code"] for n in ask(spark, files, ["now"], must, month="2025-02")["notes"]} <= {"required_measure_null"}


def test_bases_through_requests(spark, files):
    bases = {
        "gross": {"columns": ["amount", "amount"], "op": "sum"},
        "net": {"columns": ["gross"], "op": "abs", "agg": "sum"},
        "rate": {"lookup": {"column": "good", "map": {"tea": 2, "rice": 3}, "default": 1}},
        "dated": {"lookup": {"column": "good", "map": [{"key": "tea", "value": 5, "valid_to": "2026-01-31"}, {"key": "tea", "value": 9, "valid_from": "2026-02-01"}], "default": 0}},
        "paid": {"expr": "amount * rate", "agg": "sum"},
        "valued": {"expr": "amount * dated", "agg": "sum"},
        "place": {"over": {"fn": "row_number", "partition_by": ["shop", "good"], "order_by": ["day"]}},
        "last_place": {"expr": "place", "agg": "max"},
    }
    spec = kpi(cuts=[{"name": "all"}], base_measures=bases, dimensions=[{"name": "kind", "from": "good", "map": {"tea": "drink", "rice": "food"}, "default": "none"}, {"name": "year", "from": "day", "grain": "year"}], default_dimensions=["kind"])
    spec["measures"] = {k: {"of": k, "op": "point"} for k in ("net", "paid", "valued", "last_place")}
    out = ask(spark, files, list(spec["measures"]), spec)
    got = {r["kind"]: [r[k]["value"] for k in spec["measures"]] for r in out["rows"]}
    assert got == {"drink": [90.0, 90.0, 405.0, 1.0], "food": [120.0, 180.0, 0.0, 1.0], "none": [14.0, 7.0, 0.0, 1.0]}
    assert {r["year"] for r in ask(spark, files, ["net"], spec, selected_dimensions={"names": ["year"]})["rows"]} == {"2026-01-01"}
    with pytest.raises(BindError, match="replace"):
        ask(spark, files, ["net"], kpi(base_measures={"amount": {"expr": "amount * 2"}, "sales": {"sql": "amount", "agg": "sum"}}, measures={"net": {"of": "sales", "op": "point"}}))


def test_plugins_cli_and_views(spark, files, tmp_path, monkeypatch, capsys):
    from pyspark.sql import functions as F

    plugins.register("column_functions", "thrice", lambda c: c * 3, module="metricloom_plugins.demo")
    plugins.register("measure_functions", "half", lambda c: c / 2, module="metricloom_plugins.demo")
    plugins.register("ops", "doubled", lambda plan, spec, shifts: plan.value(spec["of"], shifts) * 2, module="metricloom_plugins.demo")
    plugins.register("hooks", "peak", lambda series, ctx: F.array_max(F.transform(series, lambda x: x["v"])), module="metricloom_plugins.demo")
    with pytest.raises(BindError):
        plugins.register("ops", "evil", print, module="os.path")
    with pytest.raises(BindError):
        plugins.register("ops", "rank", print, module="metricloom_plugins.demo")
    spec = kpi(cuts=[{"name": "all"}], base_measures={"sales": {"sql": "amount", "agg": "sum"}, "more": {"columns": ["amount"], "op": "thrice", "agg": "sum"}})
    spec["measures"] |= {"more": {"of": "more", "op": "point"}, "less": {"op": "fn", "fn": "half", "inputs": ["now"]}, "two": {"op": "doubled", "of": "sales"}, "top": {"op": "hook", "hook": "peak", "of": "sales", "trailing": {"months": 4}}}
    out = ask(spark, files, ["more", "less", "two", "top"], spec)
    tea = next(r for r in out["rows"] if r["good"] == "tea")
    assert [tea[k]["value"] for k in ("more", "less", "two", "top")] == [135.0, 22.5, 90.0, 45.0]
    assert "doubled" in api.list_capabilities()["ops"]
    for kind, name in (("column_functions", "thrice"), ("measure_functions", "half"), ("ops", "doubled"), ("hooks", "peak")):
        plugins.unregister(kind, name)

    import yaml

    from metricloom.__main__ import main

    for folder, name, body in (("kpis/shop", "7", kpi()), ("models", "shop", MODEL)):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"{name}.yaml").write_text(yaml.safe_dump(body))
    context = {"execution": {"kpi_id": 7, "request_id": "q", "multi_view": True, "view_details": [{"view_id": 1, "measures_required": [{"measure_key": "now"}]}, {"view_id": 2, "measures_required": [{"measure_key": "nope"}]}]}, "filters": {"month": {"value": ["2026-03"]}}, "datasets": {"sales": {"alias": "sales", "path": f"{files}/sales.parquet"}}}
    (tmp_path / "c.json").write_text(json.dumps(context))
    assert main([str(tmp_path / "c.json"), "--config-dir", str(tmp_path), "--log-dir", str(tmp_path)]) == 0
    printed = json.loads(capsys.readouterr().out)
    assert printed["views"][0]["ok"] and not printed["views"][1]["ok"] and "nope" in printed["views"][1]["error"]
    assert list(tmp_path.glob("metric-compute-7-*.log"))
    context["execution"]["fail_fast"] = True
    with pytest.raises(BindError):
        api.compute(context, spark=spark, config_dir=str(tmp_path))
    del context["execution"]["multi_view"]
    planned = api.validate(context, spark=spark, config_dir=str(tmp_path))
    assert planned["ok"] and planned["anchor"] == "2026-03-01" and planned["sqls"]
    assert api.impact("now", kpi()) == ["share"]


def test_one_scan_for_leaves_and_series(spark, files):
    spec = kpi(cuts=[{"name": "all"}])
    spec["measures"] |= {"path": {"of": "sales", "op": "trend", "trailing": {"months": 6}}, "tilt": {"of": "sales", "op": "hook", "hook": "slope", "trailing": {"months": 6}}}
    context = {"execution": {"kpi_id": 7, "view_details": [{"measures_required": [{"measure_key": m} for m in ("now", "path", "tilt", "share")]}]}, "filters": {"month": {"value": ["2026-03"]}}, "datasets": {"sales": {"alias": "sales", "path": f"{files}/sales.parquet"}}}
    df = api.compute_df(context, spark=spark, kpi=spec | {"measures": {k: v for k, v in spec["measures"].items() if k != "share"} | {"share": spec["measures"]["now"]}}, model=MODEL)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    shares = api.compute_df(context, spark=spark, kpi=spec, model=MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shares


def test_limits(spark, files, monkeypatch):
    monkeypatch.setattr(api, "MOST_ROWS", 2)
    with pytest.raises(Exception, match="pages"):
        ask(spark, files, ["now"], kpi())
    monkeypatch.setattr(api, "MOST_DROPPED", 1)
    with pytest.raises(CatalogError):
        ask(spark, files, ["now"], kpi(having={"predicates": [{"of": "now", "cmp": "gt", "value": 1e9}]}))
