"""compute, compute_df, validate, list_capabilities."""

from __future__ import annotations

import json
import logging
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BindError, CatalogError, ContextError, MetricError, TimePlanError
from .functions import aggregates, hooks
from .functions.column import COLUMN_FUNCTIONS
from .functions.measure import MEASURE_FUNCTIONS
from .operators import filters
from .operators.cut_phase import CUT_OPS
from .operators.windows import ENTITY_WINDOWS
from .plans import calendar as cal
from .plans import definition, relations
from .plans.engine import COMBO_OPS, PERIOD_OPS, PLUGIN_OPS, TREND_OPS, Engine, order

log = logging.getLogger("metricloom")

def list_capabilities() -> dict[str, list[str]]:
    """Every operator and function by kind."""
    return {"ops": sorted({*COMBO_OPS, *PERIOD_OPS, *CUT_OPS, *PLUGIN_OPS}), "column_functions": sorted(COLUMN_FUNCTIONS), "measure_functions": sorted(MEASURE_FUNCTIONS), "hooks": sorted([*hooks.HOOKS, *hooks.COHORT_HOOKS]), "aggregations": list(aggregates.AGGREGATIONS), "filters": sorted(filters.OPERATORS), "entity_windows": list(ENTITY_WINDOWS)}


def load_config(config_dir: str, kind: str, name) -> dict:
    """A YAML definition, flat or in one group folder; two are an error."""
    import yaml

    if config_dir is None:
        raise BindError(f"no definition {kind}/{name}: give it, or config_dir")
    found = [*Path(config_dir, kind).glob(f"{name}.yaml"), *Path(config_dir, kind).glob(f"*/{name}.yaml")]
    if len(found) != 1:
        raise BindError(f"{kind}/{name}.yaml: {len(found)} files")
    return yaml.safe_load(found[0].read_text())


def _selection(kpi: dict, given: dict):
    """The time value of a request: the filter code's, else time parts, else a
    composed code, else None (all that the source has)."""
    time = kpi["time"]
    code = definition.folded(time.get("filter_code") or "")
    found = [v for c, v in given.items() if code and definition.folded(c) == code]
    value = found[0] if found else None
    if isinstance(value, dict) and ("value" in value or "values" in value):
        value = value.get("values", value.get("value"))
    if value not in (None, "", []):
        if isinstance(value, dict):
            return value
        return [cal.parsed(v, time.get("format")) for v in definition.listed(value)]
    if time.get("periods"):
        by_name = {definition.folded(c): v for c, v in given.items()}
        parts = {}
        for part, name in time["periods"].items():
            v = by_name.get(definition.folded(name))
            v = v.get("values", v.get("value")) if isinstance(v, dict) else v
            if v not in (None, "", []):
                parts[part] = definition.listed(v)
        if finer := [p for p in time["periods"] if cal.GRAINS.index(p) < cal.GRAINS.index(time.get("grain", "month"))]:
            raise BindError(f"time.periods.{finer[0]} is finer than time.grain")
        return parts
    if time.get("compose"):
        try:
            text = definition.expanded(time["compose"]["template"], given)
        except BindError as e:
            raise TimePlanError(str(e)) from e
        return [cal.parsed(text, time.get("format"))]
    return None


def _engines(context: dict, spark: SparkSession | None, config_dir: str | None, kpi: dict | None, model: dict | None) -> list[Engine]:
    """An engine for each pipeline of models that the requested measures read."""
    try:
        execution, view = context["execution"], context["execution"]["view_details"][0]
        required = view.get("measures_required")
        measures = None if required is None else [m["measure_key"] for m in required]
    except (KeyError, IndexError, TypeError) as e:
        raise ContextError(f"the context lacks {e}") from e
    kpi = kpi or load_config(config_dir, "kpis", execution["kpi_id"])
    if measures is None:
        measures = list((kpi.get("meta") or {}).get("SelectedMetrics") or [])
    models = {m["model_id"]: m for m in (model if isinstance(model, list) else [model] if model else []) if m.get("model_id")}
    spark = spark or SparkSession.getActiveSession()
    given = context.get("filters", {})
    mappings = {m["filter_code"]: m for d in context.get("datasets", {}).values() for m in d.get("filter_column_mappings", [])}
    dims = context.get("selected_dimensions")
    if isinstance(dims, dict):
        dims = dims["names"] if "names" in dims else [d for d, on in dims.items() if on]
    parameters = {k: p.get("default") for k, p in (kpi.get("parameters") or {}).items()} | (context.get("parameters") or {})
    selection = _selection(kpi, given) if kpi.get("time") else None

    def engine(model_id: str, keys: list[str]) -> Engine:
        own = models.get(model_id) or (model if isinstance(model, dict) and model_id == str(kpi.get("model") or "") else None) or load_config(config_dir, "models", model_id)
        out = Engine(spark, kpi, own, context.get("datasets", {}), keys, selection, given, parameters, dims, mappings)
        out.model_id = model_id
        return out

    default = str(kpi.get("model") or "")
    whole = Engine(spark, kpi, {}, {}, measures, selection, given, parameters, dims, mappings)
    out = []
    for part in relations.pipelines(whole):
        if len(part.models) == 1:
            one = engine(part.models[0], part.measures)
        else:
            one = engine(part.models[0], part.measures)
            one.related = [engine(m, part.measures) for m in part.models]
            for x in one.related:
                x.lenient = True
        one.model_id = "+".join(part.models) or default
        one.lenient = len({relations.model_of(kpi, b) for b in kpi.get("base_measures") or {}}) > 1
        if kpi.get("time") and one.selection is None:
            _probe(one)
        out.append(one)
    return out


def _probe(engine: Engine) -> None:
    """Without a bounded selection: the buckets that the filtered source has,
    those that fit the request's time parts; the newest alone where the anchor
    is the last observed one."""
    low = high = None
    for e in engine.related or [engine]:
        df = e.source()
        for f in e.bound_filters():
            if f["stage"] == "extract":
                df = df.filter(filters.predicate(e.physical(f["column"]), f["op"], f["operand"]))
        a, b = df.agg(F.min(e.bucket()), F.max(e.bucket())).first()
        low, high = min(filter(None, (low, a)), default=None), max(filter(None, (high, b)), default=None)
    found = [d for d in cal.spine(low, high, engine.grain) if cal.matches(d, engine.parts, engine.fiscal)] if high else []
    found = found[-1:] if engine.time.get("anchor") == "last_observed" else found
    for e in (engine, *engine.related):
        e.selection = tuple(found)


def compute_df(context: dict, *, spark: SparkSession | None = None, config_dir: str | None = None, kpi: dict | None = None, model: dict | list | None = None) -> DataFrame:
    """The lazy result of all emitted cuts; ``model``: one definition, or several
    with their model_id."""
    engines = _engines(context, spark, config_dir, kpi, model)
    out = None
    for e in engines:
        if e.time and not e.selection:
            raise TimePlanError("the time selection is empty")
        part = e.frame() if len(engines) == 1 else e.frame().withColumn("model", F.lit(e.model_id))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def validate(context: dict, *, spark: SparkSession | None = None, config_dir: str | None = None, kpi: dict | None = None, model: dict | list | None = None) -> dict:
    """Binds and plans without running; sqls holds the plans' texts."""
    engines = _engines(context, spark, config_dir, kpi, model)
    frames = [e.frame() for e in engines if not e.time or e.selection]
    texts = [f._jdf.queryExecution().toString() for f in frames]
    spans = [min(p.span) for e in engines for p in e.plans.values() if p.span]
    anchor = max((max(e.selection) for e in engines if e.selection), default=None)
    return {"ok": True, "columns": list(dict.fromkeys(c for f in frames for c in f.columns)), "sql": texts[0] if texts else "", "sqls": texts, "anchor": anchor and anchor.isoformat(), "span_start": min(spans).isoformat() if spans else None, "notes": _time_notes(engines)}


def _time_notes(engines: list[Engine]) -> list[dict]:
    notes = []
    for e in engines:
        if e.time and not e.selection:
            notes.append({"code": "empty_time_selection", "detail": f"no {e.grain} fits {dict(e.parts)}" if e.parts else "the source has no time"})
        spans = [d for p in e.plans.values() for d in p.span]
        if spans and e.selection and (max(e.selection) - min(spans)).days > cal.WIDE_DAYS:
            notes.append({"code": "wide_time_span", "detail": f"{min(spans)} to {max(e.selection)} is over ten years"})
    return notes


def _plain(v):
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


#: Rows that a response without a page may have, and dropped groups that it lists.
MOST_ROWS, MOST_DROPPED = 1_000_000, 50_000


def _cell(engine: Engine, key: str, value):
    """A number with its time: a period, or a window's first and last, and what
    it is compared with; other values as they are."""
    spec = engine.specs.get(key)
    if spec is None or engine.time is None or not engine.selection or isinstance(value, (bool, str, list, dict)) or value is None or spec["op"] in (*CUT_OPS, "dimension", "constant", "predicate"):
        return value
    plan = engine.plans[next(iter(engine.plans))]
    op = spec["op"]
    offset = (cal.Offset.of(spec["offset"]),) if spec.get("offset") and op in ("point", "lag") else ()
    if op in ("window", "cumulative_point", "expanding_window", "vs_prior_window", "n_period_avg", "weighted_window"):
        wide = {"range": "cumulative", **spec} if op in ("cumulative_point", "expanding_window") else spec
        low, high = plan.bounds(plan._window(wide), ())
        if op == "expanding_window":
            low = min(low, engine.span_start() or low)
        return {"value": value, "period_start": low.isoformat(), "period_end": high.isoformat()}
    at = plan.at(offset)
    out = {"value": value} | ({"period": at[0].isoformat()} if len(at) == 1 else {"period_start": at[0].isoformat(), "period_end": at[-1].isoformat()})
    if op in ("diff", "pct_change", "index", "delta_contribution"):
        out["baseline_period"] = max(plan.at((cal.Offset.of(spec.get("offset") or {"years": 1}),))).isoformat()
    return out


def _page(engine: Engine, context: dict, keep: int | None) -> tuple[list[dict], int, list[dict]]:
    """(rows, their number in all, dropped groups) of one pipeline; with ``keep``
    only so many rows are collected.  The groups are computed once."""
    df = order(engine.frame(), engine.kpi.get("sort"), [*engine.request_grain, *[d for d in engine.dims if d not in engine.request_grain]])
    if engine.kpi.get("max_rows"):
        df = df.limit(int(engine.kpi["max_rows"]))
    if keep is None:
        got = df.limit(MOST_ROWS + 1).collect()
        if len(got) > MOST_ROWS:
            raise MetricError(f"over {MOST_ROWS} rows: ask for pages, or use compute_df")
        total = len(got)
    else:
        held = df.persist()
        total = held.count()
        got = held.limit(keep).collect()
        held.unpersist()
    dropped = []
    if (gone := engine.dropped_groups()) is not None:
        dropped = [{"cut": r["cut"], "reason": "having", "key": {k: _plain(v) for k, v in r.asDict().items() if k != "cut"}} for r in gone.limit(MOST_DROPPED + 1).collect()]
        if len(dropped) > MOST_DROPPED:
            raise CatalogError(f"having dropped over {MOST_DROPPED} groups")
    rows = []
    for r in got:
        row = {k: _plain(v) for k, v in r.asDict().items()}
        grain = engine.plans[row["output_cut"]].dims
        then = (engine.kpi.get("having") or {}).get("then_group_by")
        rows.append(row | {"model": engine.model_id, "grouped_dimensions": list(then if then is not None else grain)})
    return rows, total, dropped


def _observed(engine: Engine) -> bool:
    """Whether the anchor's bucket has a row."""
    plan = next(iter(engine.plans.values()))
    at = max(engine.selection)
    return plan.facts().filter((F.col("_p") == F.lit(at)) & (F.col("_observed") == 1)).limit(1).count() > 0


def compute(context: dict, *, spark: SparkSession | None = None, config_dir: str | None = None, kpi: dict | None = None, model: dict | list | None = None, log_dir: str | None = None, result_log: bool = False, result_log_dir: str | None = None) -> dict:
    """The response of a request; only the asked page of groups is collected.

    ``log_dir``: a text log of the plan is written there; ``result_log_dir``:
    the response as a JSON file."""
    execution = context.get("execution", {})
    if execution.get("multi_view"):
        views = []
        for view in execution["view_details"]:
            one = {**context, "execution": {**{k: v for k, v in execution.items() if k != "multi_view"}, "view_details": [view]}}
            try:
                views.append({"view_id": view.get("view_id"), "ok": True, "result": compute(one, spark=spark, config_dir=config_dir, kpi=kpi, model=model, log_dir=log_dir, result_log=result_log, result_log_dir=result_log_dir)})
            except Exception as e:
                if execution.get("fail_fast"):
                    raise
                views.append({"view_id": view.get("view_id"), "ok": False, "error": f"{type(e).__name__}: {e}"})
        return {"multi_view": True, "views": views}
    engines = _engines(context, spark, config_dir, kpi, model)
    out = context.get("output") or {}
    size, page = out.get("page_size") or out.get("limit"), int(out.get("page") or 1)
    if page < 1 or (size is not None and int(size) < 1):
        raise ContextError("output.page and output.page_size start at 1")
    rows, total, dropped, notes = [], 0, [], []
    for engine in engines:
        if engine.time and not engine.selection:
            continue
        part, n, gone = _page(engine, context, page * int(size) if size else None)
        rows, total, dropped = rows + part, total + n, dropped + gone
        if engine.time and engine.time.get("anchor") != "last_observed" and not _observed(engine):
            notes.append({"code": "unobserved_anchor", "detail": f"anchor {max(engine.selection)} has no observed data"})
    if size:
        rows = rows[(page - 1) * int(size) : page * int(size)]
    first = engines[0]
    notes = _time_notes(engines) + notes
    requested = list(dict.fromkeys(k for e in engines for k in e.requested))
    for key in (k for k in requested if any(e.specs.get(k, {}).get("required") for e in engines)):
        for cut in dict.fromkeys(r["output_cut"] for r in rows if r.get(key) is None):
            notes.append({"code": "required_measure_null", "measure": key, "detail": cut})
    flags = ({"empty_result": True} if not rows else {}) | ({"required_measure_null": True} if any(n["code"] == "required_measure_null" for n in notes) else {}) | ({"having_dropped": True} if dropped else {})
    anchor = max(first.selection) if first.selection else None
    trends = [k for k in requested if any(e.specs.get(k, {}).get("op") in TREND_OPS for e in engines)]
    axes = {k: [x["period"] for x in next((r[k] for r in rows if r.get(k)), [])] for k in trends}
    by_model = {e.model_id: e for e in engines}
    dims = {d for e in engines for p in e.plans.values() for d in p.dims}
    for row in rows:
        for key in requested:
            row[key] = _cell(by_model[row["model"]], key, row.get(key)) if key not in first.dims else row.get(key)
        for d in dims:
            row.setdefault(d, None)
    trend_size, trend_page = out.get("trend_page_size"), int(out.get("trend_page") or 1)
    if trend_page < 1:
        raise ContextError("output.trend_page starts at 1")
    if trend_size:
        for row in rows:
            for key in trends:
                if row.get(key):
                    row[key] = row[key][(trend_page - 1) * int(trend_size) : trend_page * int(trend_size)]
    spans = [min(p.span) for e in engines for p in e.plans.values() if p.span]
    start, end = (min(first.selection).isoformat(), max(first.selection).isoformat()) if first.selection else (None, None)
    bound = {f["filter_code"]: f for e in engines for f in [g for x in (e.related or [e]) for g in x.bound_filters()]}
    skipped = [{"filter_code": c, "reason": "blank"} for c in first.blank_filters()]
    for f in bound.values():
        if f["stage"] == "result" and not all(any(definition.folded(d) in f["names"] for d in p.dims) for e in engines for p in e.plans.values()):
            skipped.append({"filter_code": f["filter_code"], "reason": "not_in_grain"})
    ignored = [{"filter_code": f["filter_code"], "reason": f"cut_{n}_ignore_filters"} for f in bound.values() for e in engines for n, p in e.plans.items() if f["names"] & p.ignored()]
    meta = dict(first.kpi.get("meta") or {})
    if rule := first.kpi.get("green_when"):
        meta |= {"of": rule["of"]} | {k: float(rule[k]) for k in ("above", "below") if k in rule}
    texts = [e.frame()._jdf.queryExecution().logical().toString() for e in engines if e.plans]
    result = {
        "kpi_id": first.kpi.get("kpi_id"), "request_id": execution.get("request_id"),
        "parameters": {"anchor": anchor and anchor.isoformat(), "time_grain": first.grain, "span_start": min(spans).isoformat() if spans else None, "lookback_months": (anchor.year - min(spans).year) * 12 + anchor.month - min(spans).month if spans and anchor else 0,
                       "time_selection": {"start": start, "end": end, "periods": [d.isoformat() for d in first.selection or ()]}},
        "request_parameters": dict(context.get("parameters") or {}),
        "applied_filters": [{k: f[k] for k in ("filter_code", "column", "op", "values", "stage", "apply")} for f in bound.values()],
        "ignored_filters": ignored, "skipped_filters": skipped, "selected_dimensions": first.request_grain,
        "applied_cuts": [{"name": n, "group_by": list(p.dims), "model": e.model_id} for e in engines for n, p in e.plans.items() if n in e.emitted],
        "dropped_cuts": [c for e in engines for c in e.dropped_cuts], "dropped_groups": dropped, "grain_warnings": [], "notes": notes, "quality_flags": flags,
        "trend_axes": axes, "trend_labels": {k: [cal.label(date.fromisoformat(p), first.grain, first.fiscal) for p in v] for k, v in axes.items()},
        "meta": meta, "pagination": {"page": page, "page_size": size, "total_count": total, "has_more": bool(size) and page * int(size) < total},
        "sql": texts[0] if texts else "", "sqls": texts, "rows": rows,
    }
    log.info("kpi %s: %d rows of %d, anchor %s, filters %s", result["kpi_id"], len(rows), total, anchor, sorted(bound))
    stamp = f"{datetime.now():%Y%m%dT%H%M%S%f}"
    if log_dir:
        Path(log_dir, f"metric-compute-{result['kpi_id']}-{stamp}.log").write_text("\n\n".join([f"kpi {result['kpi_id']} request {result['request_id']}", f"measures {requested}", json.dumps(result["parameters"]), json.dumps(result["applied_filters"], default=str), *texts]))
    if result_log or result_log_dir:
        try:
            Path(result_log_dir or log_dir or ".", f"metric-result-{stamp}.json").write_text(json.dumps(result, default=str))
        except OSError as e:
            notes.append({"code": "result_log_failed", "detail": str(e)})
    return result


def impact(name: str, kpi: dict) -> list[str]:
    """The measures that read a measure or base, directly or through others."""
    whole = Engine(None, kpi, {}, {}, [])
    plan = relations.CutPlan(whole, next(iter(whole.cuts.values())))
    direct = {k: set(plan.inputs(s)) for k, s in whole.specs.items()}
    found: set[str] = set()
    while more := {k for k, reads in direct.items() if k not in found and (name in reads or reads & found)}:
        found |= more
    return sorted(found)
