"""Metric definitions compiled to DataFrame plans.

Nothing is interpreted row by row: every value that a cut's measures read from
the facts (a base over a set of periods) becomes one aggregate Column of a
single ``groupBy(dims).agg(...)``; series become arrays from one further
``groupBy(dims, period)``; measures are projections over those columns and cut
operators are windows over the aggregated groups.  The scan is narrowed to the
periods that the requested measures read, by a comparison of the raw column."""

from __future__ import annotations

import functools
import itertools
import operator
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BindError, FilterError
from ..functions import aggregates, hooks
from ..functions.column import COLUMN_FUNCTIONS
from ..functions.measure import MEASURE_FUNCTIONS
from ..operators import expressions, filters
from ..operators.cut_phase import CUT_OPS, STATS, Cut
from ..operators.windows import entity_window
from ..sources import readers
from . import calendar as cal
from . import definition
from .definition import folded, listed

CALENDAR_UNITS = ("days", "weeks", "months", "quarters", "years")
PRESETS = {"yoy": {"years": 1}, "mom": {"months": 1}, "wow": {"weeks": 1}, "qoq": {"periods": 1}, "pop": {"periods": 1}}
COMPARISONS = {">": operator.gt, "gt": operator.gt, ">=": operator.ge, "gte": operator.ge, "<": operator.lt, "lt": operator.lt, "<=": operator.le, "lte": operator.le, "=": operator.eq, "==": operator.eq, "eq": operator.eq, "!=": operator.ne, "<>": operator.ne, "ne": operator.ne}
TREND_OPS = ("trend", "trend_arithmetic", "filtered_trend", "shifted_trend")
# fixed values: the operators' names
COMBO_OPS = ("point", "window", "trend", "trend_arithmetic", "arithmetic", "fn", "expr", "constant", "dimension", "predicate", "hook", "filtered_point", "filtered_window", "filtered_trend", "filtered_compare", "expanding_window", "shifted_trend", "rate", "cumulative_point", "n_period_avg", "weighted_window", "snapshot_compare", "band", "envelope")
PERIOD_OPS = ("lag", "lead", "index", "vs_target", "threshold", "diff", "pct_change", "compare", "annualize", "vs_prior_window", "delta_contribution", "baseline_index", "compound_growth", "seasonal_adjust")
#: The last of the columns that order rows in entity windows.
ROW = "_metricloom_row"
#: Operators of plugins: name -> builder of a Column from (plan, spec, shifts).
PLUGIN_OPS: dict = {}
#: Operators that may not be shifted in time.
FIXED = (*CUT_OPS, *TREND_OPS, "hook", "dimension")


def resolved(node, parameters: dict):
    """``when:`` and ``from_param:`` overlays replaced by what the parameters
    choose."""
    if isinstance(node, dict):
        if "from_param" in node:
            return parameters[node["from_param"]] if node["from_param"] in parameters else node.get("default")
        if "when" in node and "else" in node and isinstance(node["when"], list):
            for case in node["when"]:
                test = case["if"]
                value = parameters.get(test["param"])
                if value in test["in"] if "in" in test else value == test.get("eq", True):
                    return resolved(case["then"], parameters)
            return resolved(node["else"], parameters)
        return {k: resolved(v, parameters) for k, v in node.items()}
    return [resolved(x, parameters) for x in node] if isinstance(node, list) else node


def desugared(kpi: dict) -> dict:
    """compare, filtered_* and two-sided operators rewritten to plain ones."""
    kpi = {**kpi, "base_measures": dict(kpi.get("base_measures", {})), "measures": {}}
    for key, spec in kpi_measures(kpi).items():
        op = spec["op"]
        if op.startswith("filtered_"):
            base = f"__{key}__of"
            source = dict(kpi["base_measures"][spec["of"]]) if spec.get("of") else {"sql": spec["column"], "agg": spec.get("agg", "sum")}
            masks = [source["where"]] if source.get("where") else []
            kpi["base_measures"][base] = {**source, "where": {"and": [*masks, spec["where"]]}}
            op = op.removeprefix("filtered_")
            spec = {k: v for k, v in spec.items() if k not in ("where", "column", "agg")} | {"of": base, "op": op}
            if op == "compare":
                kpi["measures"][f"__{key}__src"] = {"of": base, "op": "point"}
                spec["of"] = f"__{key}__src"
        elif (spec.get("where") or spec.get("also_where") or spec.get("ignore_filters")) and spec.get("of") in kpi["base_measures"]:
            base = f"__{key}__of"
            source = dict(kpi["base_measures"][spec["of"]])
            masks = [m for m in (source.get("where"), spec.get("where"), spec.get("also_where")) if m]
            kpi["base_measures"][base] = source | ({"where": {"and": masks}} if masks else {}) | {"skip_filters": listed(spec.get("ignore_filters"))}
            spec = {k: v for k, v in spec.items() if k not in ("where", "also_where", "ignore_filters")} | {"of": base}
        if op == "compare":
            mode = spec.get("mode", "yoy")
            offset = PRESETS.get(mode) or PRESETS.get(spec.get("versus", "pop")) if not isinstance(spec.get("versus"), dict) else spec["versus"]
            spec = {**spec, "op": "diff" if mode == "diff" else "pct_change", "offset": offset}
        if op in ("band", "envelope") or (op == "hook" and spec.get("hook") == "forecast_confidence" and "side" not in spec):
            for side in ("low", "high"):
                kpi["measures"][f"{key}_{side}"] = {**spec, "side": side}
        else:
            kpi["measures"][key] = spec
    return kpi


def kpi_measures(kpi: dict) -> dict[str, dict]:
    return {k: {**s, "op": s.get("op") or s.get("kind")} for k, s in (kpi.get("_measures") or kpi.get("measures") or {}).items()}


class Engine:
    """One request over one model.  ``frame`` gives the result of all cuts."""

    def __init__(self, spark: SparkSession, kpi: dict, model: dict, datasets: dict, measures: list[str], selection=None, request_filters: dict | None = None, parameters: dict | None = None, dimensions: list[str] | None = None, mappings: dict | None = None):
        self.parameters = {k: p.get("default") for k, p in (kpi.get("parameters") or {}).items()} | (parameters or {})
        kpi = definition.checked(resolved(kpi, self.parameters), (*COMBO_OPS, *PERIOD_OPS, *CUT_OPS, *PLUGIN_OPS))
        kpi["_measures"] = kpi["measures"]
        self.filters = definition.filter_specs(kpi)
        self.kpi = desugared(kpi)
        self.spark, self.model, self.datasets = spark, model, datasets
        self.bases, self.specs = self.kpi["base_measures"], kpi_measures({"measures": self.kpi["measures"]})
        self.requested = [n for m in measures for n in ([m] if m in self.specs or m in [d["name"] for d in self.kpi.get("dimensions", [])] else [k for k in (f"{m}_low", f"{m}_high") if k in self.specs] or self._missing(m))]
        self.time = kpi.get("time")
        if rule := kpi.get("green_when"):
            self.requested += [rule["of"]] if rule["of"] not in self.requested else []
        self.grain = self._grain()
        self.fiscal = cal.Fiscal((self.time or {}).get("fiscal_start_month", 4) if (self.time or {}).get("calendar") == "fiscal" else 1)
        self.parts = {p: cal.part_values(p, v) for p, v in selection.items() if v not in (None, [], "")} if isinstance(selection, dict) and "from" not in selection else {}
        if "year" in self.parts or (self.time or {}).get("year_basis") == "calendar":
            self.fiscal = cal.Fiscal(self.fiscal, 1)  # quarters stay fiscal
        self.dims = {d["name"]: d for d in self.kpi.get("dimensions", [])}
        self.request_grain = list(dimensions if dimensions is not None else self.kpi.get("default_dimensions", list(self.dims)))
        self.cuts = {c["name"]: c for c in self.kpi.get("cuts") or [{"name": "all"}]}
        self.request_filters, self.mappings = request_filters or {}, mappings or {}
        bounded = selection is not None and (not self.parts or "year" in self.parts) and selection != {}
        self.selection = cal.selection(selection, self.grain, self.fiscal) if self.time and bounded else None
        self.related: list[Engine] = []
        self.lenient = False
        self.emitted = self._emitted()
        self.cut_frames: dict[str, DataFrame] = {}
        self.plans: dict[str, CutPlan] = {}
        self.dropped_cuts: list[dict] = []

    def _grain(self) -> str:
        time = self.time or {}
        grain = self.parameters.get("time_grain") or time.get("grain", "month")
        if time and grain not in (time.get("grains") or [time.get("grain", "month"), grain]):
            raise BindError(f"parameters.time_grain {grain!r} is not one of time.grains {time['grains']}")
        if grain not in cal.GRAINS:
            raise BindError(f"no grain {grain!r}")
        finest = time.get("source_grain")
        if finest and cal.GRAINS.index(grain) < cal.GRAINS.index(finest):
            raise BindError(f"parameters.time_grain {grain!r} is finer than time.source_grain {finest!r}")
        return grain

    def _missing(self, name: str):
        raise BindError(f"no measure {name!r}")

    # -- planning -------------------------------------------------------

    def _emitted(self) -> list[str]:
        """only_cut alone, else output_cut, else the requested measures' cuts
        (the default cut for one without), with what they also emit; emit_cuts
        leaves of these its own and the first ones."""
        chosen = self.parameters.get("only_cut") or self.parameters.get("output_cut")
        default = self.kpi.get("default_cut") or next(iter(self.cuts))
        roots = [chosen] if chosen else [c for k in self.requested for c in listed(self.specs.get(k, {}).get("cuts")) or [default]]
        roots = list(dict.fromkeys(roots or [default]))
        out: list[str] = []

        def walk(name: str) -> None:
            if name not in self.cuts:
                raise BindError(f"no cut {name!r}; declared: {sorted(self.cuts)}")
            if name not in out:
                out.append(name)
                if not self.parameters.get("only_cut") and self.cuts[name].get("pack_also_emit", True):
                    for extra in listed(self.cuts[name].get("also_emit")):
                        walk(extra)

        for root in roots:
            walk(root)
        wanted = listed(self.parameters.get("emit_cuts"))
        return [c for c in out if c in wanted or c in roots] if wanted else out

    def compatible(self) -> list[str]:
        """The emitted cuts whose dimensions the source has; the first may not
        be missing."""
        out = []
        for name in self.emitted:
            missing = [d for d in self.cut_dims(self.cuts[name]) if not self.has_dimension(d)]
            named = [k for k in self.requested if name in listed(self.specs.get(k, {}).get("cuts"))]
            if not missing:
                out.append(name)
            elif named:
                raise BindError(f"measures.{named[0]} cuts {name!r} is not on this extract: it lacks {missing}")
            elif name == self.emitted[0]:
                raise BindError(f"cut {name!r} is not on this extract: it lacks {missing}")
            else:
                self.dropped_cuts.append({"name": name, "reason": "missing_dimensions", "dimensions": missing})
        return out

    def has_dimension(self, name: str) -> bool:
        if self.related:
            return any(e.has_dimension(name) for e in self.related)
        self.source()
        return folded(self.dims.get(name, {}).get("from", name)) in self.names

    def cut_dims(self, cut: dict) -> list[str]:
        grain = [d for d in self.request_grain if d not in cut.get("exclude_from_grain", [])]
        return grain + [d for d in cut.get("group_by", []) if d not in grain]

    def source(self) -> DataFrame:
        if not hasattr(self, "_source"):
            self._source = readers.load(self.spark, self.model, self.datasets)
            self.names = {folded(c): c for c in self._source.columns}
            for name, b in self.bases.items():
                if "agg" not in b and folded(name) in self.names and not b.get("replace") and (b.get("expr") or b.get("op") or b.get("over") or b.get("lookup")):
                    raise BindError(f"base_measures.{name} has a column's name; say replace: true")
            if any(b.get("over") for b in self.bases.values()):
                self._source = self._source.withColumn(ROW, F.monotonically_increasing_id())
        return self._source

    def physical(self, name: str) -> Column:
        self.source()
        if folded(name) not in self.names:
            raise BindError(f"no column {name!r}")
        return F.col(f"`{self.names[folded(name)]}`")

    def dimension(self, name: str) -> Column:
        d = self.dims.get(name) or {"name": name}
        c = self.physical(d.get("from", name))
        if d.get("map"):
            pairs = list(itertools.chain.from_iterable((F.lit(str(k)), F.lit(v)) for k, v in d["map"].items()))
            c = F.coalesce(F.create_map(*pairs)[c.cast("string")], F.lit(d["default"]) if "default" in d else c.cast("string"))
        if d.get("grain"):
            c = F.to_date(F.date_trunc(d["grain"], c))
        return c

    def bucket(self) -> Column:
        c = self.time_column()
        if self.grain in ("quarter", "year") and self.fiscal != 1:
            return F.add_months(F.date_trunc(self.grain, F.add_months(c, 1 - self.fiscal)).cast("date"), self.fiscal - 1)
        return F.date_trunc(self.grain, c).cast("date")

    def time_column(self) -> Column:
        c = self.physical(self.time["column"])
        fmt = self.time.get("format")
        kind = dict(self.source().dtypes)[self.names[folded(self.time["column"])]]
        if fmt and not kind.startswith(("date", "timestamp")):
            pattern = fmt.lower().replace("m", "M")
            return F.to_date(F.lpad(c.cast("string"), len(pattern), "0"), pattern)
        return F.to_date(c) if kind == "string" else c

    # -- facts ----------------------------------------------------------

    def base_column(self, name: str, seen: tuple = ()) -> Column:
        """The row-level value of a base measure or physical column."""
        if name in seen:
            raise BindError(f"cycle: {' -> '.join((*seen, name))}")
        b = self.bases.get(name)
        if b is None:
            return self.physical(name)
        return F.col(f"`b__{name}`")

    def _base_value(self, name: str) -> Column:
        b = self.bases[name]
        read = lambda n: self.base_column(n, (name,)) if n in self.bases and n != name else self.physical(n)
        if b.get("lookup"):
            return self._lookup(b["lookup"], read)
        if b.get("over"):
            o = b["over"]
            as_list = lambda v: [v] if isinstance(v, str) else list(v or [])
            of = o.get("of") or b.get("of")
            # rows that the named order leaves equal: by time, dimensions, place in the source
            ties = [*([self.time_column()] if self.time else []), *[self.dimension(d) for d in self.dims if self.has_dimension(d)], F.col(ROW)]
            return entity_window(o["fn"], expressions.number(read(of)) if of else None, [read(c) for c in as_list(o.get("partition_by"))], [*[read(c) for c in as_list(o.get("order_by"))], *ties], int(o.get("n", 1)))
        if b.get("op"):
            columns = b.get("columns", [])
            named = isinstance(columns, dict)
            args = [read(c) if isinstance(c, str) else F.lit(c) for c in (columns.values() if named else columns)]
            fn = COLUMN_FUNCTIONS.get(b["op"])
            if fn is None:
                raise BindError(f"no column function {b['op']!r}")
            value = fn(*args, **b.get("params", {}))
        elif b.get("expr") or (b.get("sql") and not str(b["sql"]).replace("_", "").isalnum()):
            value = expressions.compile_(b.get("expr") or b["sql"], read, COLUMN_FUNCTIONS, self.parameters)
        else:
            value = read(b.get("sql") or b["columns"][0])
        return F.when(filters.mask(b["where"], read), value) if b.get("where") else value

    def _lookup(self, spec: dict, read) -> Column:
        keys = spec.get("keys") or [spec["column"]]
        key = F.concat_ws("|", *[read(k).cast("string") for k in keys])
        as_of = spec.get("as_of") or (max(self.selection).isoformat() if self.selection else None)
        found = F.lit(None).cast("double")
        rows = spec["map"]
        if isinstance(rows, dict):
            found = F.create_map(*itertools.chain.from_iterable((F.lit(str(k)), F.lit(v)) for k, v in rows.items()))[key]
        else:
            live = [r for r in rows if (not r.get("valid_from") or not as_of or str(r["valid_from"]) <= as_of) and (not r.get("valid_to") or not as_of or as_of <= str(r["valid_to"]))]
            if live:
                found = F.create_map(*itertools.chain.from_iterable((F.lit(str(r["key"])), F.lit(r["value"])) for r in live))[key]
        if spec.get("strict"):
            return F.coalesce(found, F.raise_error(F.concat(F.lit("no lookup value for "), key)))
        return F.coalesce(found, F.lit(spec["default"])) if "default" in spec else found

    def _ordered_bases(self, wanted: set[str]) -> list[str]:
        out: list[str] = []

        def visit(name: str, path: tuple) -> None:
            if name in path:
                raise BindError(f"cycle: {' -> '.join((*path, name))}")
            if name in out or name not in self.bases:
                return
            b = self.bases[name]
            over = b.get("over") or {}
            inputs = [*(b.get("columns", {}).values() if isinstance(b.get("columns"), dict) else b.get("columns", [])), over.get("of"), b.get("of"), b.get("sql"), b.get("weight_column"), *(b.get("lookup", {}).get("keys") or [b.get("lookup", {}).get("column")])]
            for text in (b.get("expr"), b.get("sql")):
                if text:
                    inputs += expressions.names(expressions.parse(str(text)))
            for n in inputs:
                if isinstance(n, str) and n in self.bases and n != name:
                    visit(n, (*path, name))
            out.append(name)

        for name in wanted:
            visit(name, ())
        return out

    # -- filters --------------------------------------------------------

    def _given(self) -> dict[str, list]:
        """code -> values of the request's filters, with defaults and composed
        codes; time filters left out."""
        time = self.time or {}
        out = {}
        for code, given in self.request_filters.items():
            value = given.get("values", given.get("value")) if isinstance(given, dict) else given
            out[code] = listed(value)
        by_name = {folded(c): c for c in out}
        used = set()
        if time.get("compose"):
            used |= {folded(n) for n in definition.template_names(time["compose"]["template"])}
        for code, spec in self.filters.items():
            if spec["compose"]:
                names = definition.template_names(spec["compose"])
                if any(folded(n) in by_name for n in names):
                    out[code] = [definition.expanded(spec["compose"], self.request_filters)]
                    used |= {folded(n) for n in names} - {folded(code)}
            present = by_name.get(folded(code))
            if spec["required"] and not [v for v in (out.get(present) or []) if v is not None]:
                raise BindError(f"filters.{code} is required: it can't be left out or blank")
            if present is None and spec["default"] is not None and code not in out:
                out[code] = spec["default"]
        used |= {folded(time.get("filter_code") or "")} if time else set()
        used |= {folded(c) for c in (time.get("periods") or {}).values()}
        return {c: v for c, v in out.items() if folded(c) not in used}

    def bound_filters(self) -> list[dict]:
        """code, column, op, values and stage of each filter that has a value.
        Extract filters that an emitted cut or a measure ignores work per cut."""
        if hasattr(self, "_bound"):
            return self._bound
        ignored = {folded(c) for n in self.emitted for k in ("ignore_filters", "reset_filters") for c in listed(self.cuts[n].get(k))}
        ignored |= {folded(c) for b in self.bases.values() for c in b.get("skip_filters", [])}
        specs = {folded(c): s for c, s in self.filters.items()}
        mappings = {folded(c): m for c, m in self.mappings.items()}
        out = []
        for code, values in self._given().items():
            spec, mapped = specs.get(folded(code), {}), mappings.get(folded(code), {})
            op = spec.get("op") or filters.canonical(mapped.get("operator") or "in")
            if not [v for v in values if v is not None] and op not in ("is_null", "is_not_null"):
                continue
            column = spec.get("column") or mapped.get("column_name") or code
            physical = self.dims[column].get("from", column) if column in self.dims else column
            if spec.get("apply") != "result" and not self.related:
                self.source()
                if folded(physical) not in self.names:
                    if self.lenient:
                        continue
                    raise FilterError(f"filter {code!r} has no column")
            if op == "eq" and len(values) > 1 and not spec:
                op = "in"  # a mapping's single-value operator with several values
            stage = spec.get("apply") or "extract"
            if stage == "extract" and ({folded(code), folded(column), folded(physical)} & ignored):
                stage = "calc"
            out.append({"filter_code": code, "column": physical if stage != "result" else column, "op": op, "values": values, "stage": stage, "apply": stage, "operand": filters.operand(op, values, code), "names": {folded(code), folded(column), folded(physical)}})
        self._bound = out
        return out

    def masked(self, base: str) -> bool:
        """Whether a base reads some rows only: by its own mask, or because
        another measure ignores a filter that it doesn't."""
        b = self.bases[base]
        own = {folded(c) for c in b.get("skip_filters", [])}
        others = {folded(c) for x in self.bases.values() for c in x.get("skip_filters", [])} - own
        return bool(b.get("where")) or bool(others) and any(f["stage"] != "result" and f["names"] & others for f in self.bound_filters())

    def blank_filters(self) -> list[str]:
        have = {f["filter_code"] for f in self.bound_filters()}
        return [c for c, v in self._given().items() if c not in have and not [x for x in v if x is not None]]

    # -- measures -------------------------------------------------------

    def frame(self) -> DataFrame:
        """All emitted cuts: output_cut, dimensions, requested measures."""
        out = None
        self.emitted = self.compatible()
        for name in self.emitted:
            part = self.cut(name)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def cut(self, name: str) -> DataFrame:
        if name not in self.cut_frames:
            self.plans[name] = CutPlan(self, self.cuts[name])
            self.cut_frames[name] = self.plans[name].result()
        return self.cut_frames[name]

    def dropped_groups(self) -> DataFrame | None:
        """cut and dimensions of the groups that ``having`` dropped."""
        out = None
        for name in self.emitted:
            self.cut(name)
            part = self.plans[name].dropped
            if part is not None:
                part = part.select(F.lit(name).alias("cut"), *[F.col(f"`{d}`") for d in self.plans[name].dims])
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def span_start(self) -> date | None:
        """The first bucket that any requested measure reads, on any cut."""
        if not hasattr(self, "_span_start"):
            self._span_start = None  # while it is looked for, expanding windows start with their year
            spans = []
            for name in self.emitted:
                plan = CutPlan(self, self.cuts[name])
                for key in self.requested:
                    if key in self.specs and plan._on_this_cut(key):
                        plan.build(key)
                spans += plan.span
            self._span_start = min(spans) if spans else None
        return self._span_start


class CutPlan:
    def __init__(self, engine: Engine, cut: dict):
        self.e, self.spec = engine, cut
        self.dims = engine.cut_dims(cut)
        self.leaves: dict[str, Column] = {}
        self.folded: dict[str, tuple] = {}
        self.used: set[str] = set()
        self.series_of: dict[str, tuple[str, date, date, str | None]] = {}
        self.span: list[date] = list(engine.selection or [])
        self.pending: dict[str, Column] = {}
        self.done: list[str] = []
        self.cut_phase: list[str] = []
        self.row_dims: list[str] = []
        self.dropped: DataFrame | None = None
        self.survivors: DataFrame | None = None

    # leaves

    def _period_test(self, periods) -> Column | None:
        if not self.e.time:
            return None
        self.span += periods
        a, b = min(periods), max(periods)
        p = F.col("_p")
        if list(periods) == cal.spine(a, b, self.e.grain):
            return p.between(F.lit(a), F.lit(b)) if a != b else p == F.lit(a)
        return p.isin(list(periods))

    def _aggregate(self, base: str, test: Column | None) -> Column:
        b = self.e.bases[base]
        if "agg" not in b:
            return self._single(base, test)
        self.used.add(base)
        if self.e.related and b["agg"] in ("avg", "weighted_avg"):  # of joined models: sums and weights
            v, w = (F.when(test, c) if test is not None else c for c in (F.col(f"`b__{base}`"), F.col(f"`w__{base}`")))
            return F.try_divide(F.sum(v), F.sum(w))
        if self.e.related:
            return aggregates.aggregate("sum" if b["agg"] == "count" else b["agg"], F.col(f"`b__{base}`"), test)
        weight = self.e.base_column(b["weight_column"]) if b.get("weight_column") else None
        if weight is not None:
            weight = F.col(f"`w__{base}`")
        return aggregates.aggregate(b["agg"], F.col(f"`b__{base}`"), test, order=F.col("_t"), weight=weight, percentile=float(b.get("percentile", 0.5)))

    def _single(self, base: str, test: Column | None) -> Column:
        """A row helper's one value in its group."""
        identity = self.e.kpi.get("identity_grain")
        if not identity:
            raise BindError(f"{base!r} is a row helper: give it agg:, or declare identity_grain")
        if set(map(folded, identity)) != set(map(folded, self.dims)):
            raise BindError(f"row helper {base!r} needs cuts whose grain is identity_grain {identity}; {self.spec['name']!r} has {self.dims}")
        self.used.add(base)
        v, one = F.col(f"`b__{base}`"), F.lit(1)
        n = F.count(one if test is None else F.when(test, one))
        first = F.max(v if test is None else F.when(test, v))
        return F.when(n > 1, F.raise_error(F.lit(f"{base}: rows are not unique at identity_grain")).cast("double")).otherwise(first)

    def leaf(self, base: str, periods: tuple[date, ...], window: bool) -> Column:
        name = f"l{len(self.leaves)}"
        test = self._period_test(periods)
        value = self._aggregate(base, test)
        b = self.e.bases[base]
        zero = b.get("agg") in aggregates.ZERO_WHEN_EMPTY
        if b.get("agg") in self.FOLDED:
            self.folded[name] = (base, test, window)
        if window:
            value = F.coalesce(value, F.lit(0.0)) if zero else value
        elif zero:
            seen = F.max(F.col("_observed") if test is None else F.when(test, F.col("_observed")))
            value = F.when(seen.isNotNull(), value if self.e.masked(base) else F.coalesce(value, F.lit(0.0)))
        self.leaves[name] = value
        return F.col(name)

    def series(self, base: str, start: date, end: date, weight: str | None = None) -> Column:
        self.used |= {base, *([weight] if weight else [])}
        self.span += [start, end]
        name = f"s{len(self.series_of)}"
        self.series_of[name] = (base, start, end, weight)
        return F.col(name)

    # evaluation: a Column over leaves for a measure or base at shifts

    def at(self, shifts: tuple) -> tuple[date, ...]:
        out = self.e.selection
        if out is None:
            return ()
        for s in shifts:
            out = cal.shifted(out, s, self.e.grain, self.e.fiscal)
        return out

    def anchor(self, shifts: tuple) -> date:
        return max(self.at(shifts))

    def bounds(self, spec: dict, shifts: tuple) -> tuple[date, date]:
        """Window bounds; trailing {months: 3} and the like count calendar units."""
        return cal.window_bounds(self.anchor(shifts), self.e.grain, spec, self.e.fiscal)

    def periods(self, bounds: tuple[date, date]) -> tuple[date, ...]:
        return tuple(cal.spine(*bounds, self.e.grain))

    def value(self, name, shifts: tuple = ()) -> Column:
        """A measure or base by name, or a number."""
        if isinstance(name, (int, float)):
            return F.lit(float(name))
        if name in self.e.specs:
            spec = self.e.specs[name]
            if shifts and spec["op"] in FIXED:
                raise BindError(f"{name!r} ({spec['op']}) can't be shifted")
            if not shifts and self._late(name):
                self.build(name)
                return F.col(f"`m__{name}`")
            return self.measure(name, spec, shifts)
        if name in self.e.bases:
            return self.leaf(name, self.at(shifts), False)
        raise BindError(f"no measure {name!r}")

    def _late(self, name: str) -> bool:
        """Whether a measure needs the cut phase."""
        spec = self.e.specs.get(name)
        if spec is None:
            return False
        return spec["op"] in CUT_OPS or any(self._late(d) for d in self.inputs(spec) if d != name)

    def inputs(self, spec: dict) -> list[str]:
        as_list = lambda v: list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else [v]
        out = [x for k in ("of", "left", "right", "vs", "inputs", "weight", "low", "high") for x in as_list(spec.get(k))]
        out += [p[k] for p in spec.get("predicates", []) for k in ("of", "vs") if k in p]
        if spec["op"] == "expr":
            out += expressions.names(expressions.parse(spec["expr"]))
        return [x for x in out if isinstance(x, str)]

    def measure(self, key: str, spec: dict, shifts: tuple) -> Column:
        op = spec["op"]
        offset = cal.Offset.of(spec.get("offset")) if spec.get("offset") else None
        back = (*shifts, offset) if offset else shifts
        of = spec.get("of")
        if op == "point":
            return self.leaf(of, self.at(back), False)
        if op in ("window", "cumulative_point"):
            w = {"range": "cumulative", **spec} if op == "cumulative_point" else spec
            return self.leaf(of, self.periods(self.bounds(self._window(w), shifts)), True)
        if op == "expanding_window":
            start, end = cal.window_bounds(self.anchor(shifts), self.e.grain, {"range": "ytd"}, self.e.fiscal)
            return self.leaf(of, self.periods((min(start, self.e.span_start() or start), end)), True)
        if op in TREND_OPS:
            return self._trend(spec, shifts)
        if op == "arithmetic":
            names = of if isinstance(of, list) else [spec["left"], spec["right"]]
            return self._function(spec.get("fn", "divide"), [self.value(n, shifts) for n in names], spec)
        if op == "fn":
            given = spec["inputs"]
            named = isinstance(given, dict)
            return self._function(spec["fn"], [self.value(n, shifts) for n in (given.values() if named else given)], spec)
        if op == "expr":
            return expressions.compile_(spec["expr"], lambda n: self.value((spec.get("inputs") or {}).get(n, n) if isinstance(spec.get("inputs"), dict) else n, shifts), MEASURE_FUNCTIONS, self.e.parameters)
        if op == "constant":
            value = spec["value"]
            if isinstance(value, dict):
                pairs = itertools.chain.from_iterable((F.lit(str(k)), F.lit(float(v))) for k, v in value.items())
                return F.coalesce(F.create_map(*pairs)[F.col(f"`{spec['by']}`").cast("string")], F.lit(spec.get("default")).cast("double"))
            return F.lit(float(value))
        if op == "dimension":
            return F.col(f"`{key}`")
        if op == "predicate":
            tests = [self._predicate(p, shifts) for p in spec["predicates"]]
            met = functools.reduce(operator.or_ if spec.get("match") == "any" else operator.and_, tests)
            return F.when(met, 1.0).otherwise(0.0)
        if op == "hook":
            return self._hook(spec, shifts)
        if op == "rate":
            return F.try_divide(self.value(of, shifts), self.value(spec["vs"] if "vs" in spec else spec["n"], shifts))
        if op == "n_period_avg":
            return hooks.mean(hooks.values(self.series(of, *self.bounds(self._window(spec), shifts))))
        if op == "weighted_window":
            s = self.series(of, *self.bounds(self._window(spec), shifts), spec["weight"])
            ok = F.filter(s, lambda x: x["v"].isNotNull() & x["w"].isNotNull() & (x["w"] != 0))
            return F.try_divide(hooks.total(F.transform(ok, lambda x: x["v"] * x["w"])), hooks.total(F.transform(ok, lambda x: x["w"])))
        if op == "snapshot_compare":
            a, b = self.value(of, shifts), self.value(spec["vs"], shifts)
            return a - b if spec.get("mode", "pct") == "diff" else F.try_divide(a - b, b)
        if op in ("band", "envelope"):
            edge = self.value(spec[spec["side"]], shifts)
            return self.value(of, shifts) * edge if spec.get("method", "factor") == "factor" else self.value(of, shifts) + edge
        if op in ("lag", "lead", "index", "diff", "pct_change", "rank_pct_change", "delta_contribution", "baseline_index"):
            return self._shift(op, spec, shifts)
        if op == "vs_target":
            v, t = self.value(of, shifts), self.value(spec.get("vs", spec.get("value")), shifts)
            return v - t if spec.get("as", "gap") == "gap" else F.try_divide((v - t) * 100, t)
        if op == "threshold":
            v, t = self.value(of, shifts), self.value(spec.get("vs", spec.get("value")), shifts)
            return F.when(v.isNotNull() & t.isNotNull(), COMPARISONS[spec["cmp"]](v, t).cast("double"))
        if op == "annualize":
            return self.value(of, shifts) * (float(spec.get("periods_per_year") or cal.PER_YEAR[self.e.grain]) / float(spec.get("n", 1)))
        if op == "vs_prior_window":
            w = self._window({k: v for k, v in spec.items() if k != "offset"})
            cur = self.leaf(of, self.periods(self.bounds(w, shifts)), True)
            old = self.leaf(of, self.periods(self.bounds(w, back)), True)
            return F.try_divide(cur - old, old)
        if op == "compound_growth":
            n = int(spec.get("n", 1))
            end, start = self.value(of, shifts), self.value(of, (*shifts, cal.Offset(periods=n)))
            return F.when((start != 0) & (end / start >= 0), F.pow(end / start, F.lit(1 / n)) - 1)
        if op == "seasonal_adjust":
            s = self.series(of, *self.bounds(self._window(spec), shifts))
            ctx = hooks.Context(self.anchor(shifts), self.e.grain, self._length(spec))
            return F.try_divide(hooks.at_anchor(s, ctx) * hooks.mean(hooks.values(s)), hooks.same_month(s, ctx, False))
        if op in PLUGIN_OPS:
            return PLUGIN_OPS[op](self, spec, shifts)
        raise BindError(f"no operator {op!r}")

    def _window(self, spec: dict) -> dict:
        w = {k: spec[k] for k in ("range", "trailing", "inclusive", "offset", "align") if k in spec}
        t = w.get("trailing")
        if isinstance(t, dict) and "from" in t:
            w["trailing"] = self.e.kpi["data_points"][self.e.grain]
        return w

    def _length(self, spec: dict) -> int:
        t = spec.get("trailing", 1)
        return int(next(iter(t.values())) if isinstance(t, dict) else t)

    def _function(self, name: str, values: list[Column], spec: dict) -> Column:
        if name not in MEASURE_FUNCTIONS:
            raise BindError(f"no measure function {name!r}")
        return MEASURE_FUNCTIONS[name](*values, **spec.get("params", {}))

    def _predicate(self, p: dict, shifts: tuple) -> Column:
        return self._met(p, lambda n: self.value(n, shifts))

    @staticmethod
    def _met(p: dict, value) -> Column:
        """A predicate over ``value`` of names; null fails."""
        v = value(p["of"])
        if p["cmp"] in ("between", "not_between"):
            met = v.between(F.lit(p["low"]), F.lit(p["high"]))
            met = met if p["cmp"] == "between" else ~met
        elif p["cmp"] in ("is_null", "is_not_null"):
            met = v.isNull() if p["cmp"] == "is_null" else v.isNotNull()
        else:
            other = p["vs"] if "vs" in p else p["value"]
            met = COMPARISONS[p["cmp"]](v, value(other) if isinstance(other, str) else F.lit(float(other)))
        return F.coalesce(met, F.lit(False))

    def _shift(self, op: str, spec: dict, shifts: tuple) -> Column:
        of = spec["of"]
        offset = cal.Offset.of(spec.get("offset") or {"years": 1})
        if op == "lead":
            offset = cal.Offset(**{k: -getattr(offset, k) for k in cal.Offset.__dataclass_fields__})
        other = self.value(spec["vs"], shifts) if "vs" in spec and op in ("delta_contribution", "baseline_index") else self.value(of, (*shifts, offset))
        if op in ("lag", "lead"):
            return other
        cur = self.value(of, shifts)
        if op in ("diff", "delta_contribution"):
            return cur - other
        if op in ("index", "baseline_index"):
            return F.try_divide(cur * 100, other)
        return F.try_divide(cur - other, other)

    def _trend(self, spec: dict, shifts: tuple) -> Column:
        """Array of (period, value), one for each period of the axis."""
        start, end = self.bounds(self._window(spec), shifts)
        axis = [F.lit(p) for p in self.periods((start, end))]

        def slots(base: str) -> list[Column]:
            found = F.map_from_entries(self.series(base, start, end))
            zero = 0.0 if self.e.bases[base]["agg"] in aggregates.ZERO_WHEN_EMPTY else None
            return [F.coalesce(F.try_element_at(found, p), F.lit(zero).cast("double")) for p in axis]

        if spec["op"] == "trend_arithmetic":
            names = spec["of"] if isinstance(spec["of"], list) else [spec["of"]]
            rows = []
            for n in names:
                if n in self.e.bases:
                    rows.append(slots(n))
                else:
                    other = self.e.specs[n]
                    rows.append([x for x in slots(other["of"])])
            per = list(zip(*rows, strict=True))
            if spec.get("expr"):
                values = [expressions.compile_(spec["expr"], dict(zip(names, vs, strict=True)).__getitem__, MEASURE_FUNCTIONS, self.e.parameters) for vs in per]
            else:
                values = [self._function(spec.get("fn", "divide"), list(vs), spec) for vs in per]
        else:
            values = slots(spec["of"])
        return F.array(*[F.struct(p.alias("period"), v.alias("value")) for p, v in zip(axis, values, strict=True)])

    def _hook(self, spec: dict, shifts: tuple) -> Column:
        name = spec["hook"]
        if name in hooks.COHORT_HOOKS:
            return self._cohort(name, spec, shifts)
        if name not in hooks.HOOKS:
            raise BindError(f"no hook {name!r}")
        start, end = self.bounds(self._window(spec), shifts)
        s = self.series(spec["of"], start, end)
        ctx = hooks.Context(self.anchor(shifts), self.e.grain, self._length(spec), spec.get("value"), spec, self.periods((start, end)))
        return hooks.HOOKS[name](s, ctx)

    def _cohort(self, name: str, spec: dict, shifts: tuple) -> Column:
        """Share of the entities first seen at (retention) or up to (survival)
        the entry period that are seen at the anchor; entities are first folded
        to one row each."""
        entry = cal.truncate(str(spec["entry_period"]) + ("-01" if len(str(spec["entry_period"])) == 7 else ""), self.e.grain, self.e.fiscal)
        key = f"c{len(self.series_of)}"
        self.span += [entry, self.anchor(shifts)]
        self.cohorts = getattr(self, "cohorts", {}) | {key: (name, spec["cohort_column"], entry, self.anchor(shifts))}
        return F.col(key)

    # assembly

    def build(self, key: str) -> None:
        """Makes ``m__key`` available, in the right phase."""
        if key in self.done:
            return
        spec = self.e.specs[key]
        if spec["op"] in CUT_OPS:
            for n in self.inputs(spec):
                if n in self.e.specs and n not in self.done:
                    self.build(n)
                elif n in self.e.bases and f"@{n}" not in self.done:
                    self.pending[f"@{n}"] = self.leaf(n, self.at(()), False)
                    self.done.append(f"@{n}")
            if spec["op"] == "rank_pct_change":
                self.pending[f"@{key}"] = self._shift("pct_change", spec, ())
            self.cut_phase.append(key)
        elif self._late(key):
            for n in self.inputs(spec):
                if n in self.e.specs:
                    self.build(n)
            self.cut_phase.append(key)
        else:
            self.pending[key] = self.measure(key, spec, ())
        self.done.append(key)

    def ignored(self) -> set[str]:
        """Filters that this cut leaves out; a rolled up cut has its child's."""
        cut = self.spec
        while cut.get("rollup_from"):
            cut = self.e.cuts[cut["rollup_from"]]
        return {folded(c) for k in ("ignore_filters", "reset_filters") for c in listed(cut.get(k))}

    def facts(self) -> DataFrame:
        from . import relations

        df = relations.joined_facts(self) if self.e.related else self.own_facts()
        if self.survivors is not None:
            keys = [c for c in self.survivors.columns]
            on = functools.reduce(operator.and_, [F.col(f"`{k.removeprefix('k__')}`").eqNullSafe(F.col(f"`{k}`")) for k in keys])
            df = df.join(self.survivors, on, "left_semi")
        return df

    def own_facts(self) -> DataFrame:
        e = self.e
        df = e.source()
        if e.time and self.span:
            raw, first, last = e.time_column(), min(self.span), cal.add_periods(max(self.span), e.grain, 1)
            kind = "timestamp_ntz" if dict(df.dtypes)[e.names[folded(e.time["column"])]] == "timestamp_ntz" else "date"
            df = df.filter((raw >= F.lit(first.isoformat()).cast(kind)) & (raw < F.lit(last.isoformat()).cast(kind)))
        ignored = self.ignored()
        skipped = {folded(c) for b in self.used for c in e.bases[b].get("skip_filters", [])}
        masks = []
        for f in e.bound_filters():
            if f["stage"] == "result" or f["names"] & ignored:
                continue
            test = filters.predicate(e.physical(f["column"]), f["op"], f["operand"])
            if f["names"] & skipped:
                masks.append((f["names"], F.coalesce(test, F.lit(False))))  # some measures read all rows
            else:
                df = df.filter(test)
        for name in e._ordered_bases(self.used | {x for b in self.used for x in [e.bases[b].get("weight_column")] if x in e.bases}):
            value = e._base_value(name)
            for names, test in masks:
                if not names & {folded(c) for c in e.bases[name].get("skip_filters", [])}:
                    value = F.when(test, value)
            df = df.withColumn(f"b__{name}", value)
        bases = [b for b in self.used]
        seen = functools.reduce(operator.or_, [F.col(f"`b__{b}`").isNotNull() for b in bases], F.lit(False)) if bases else F.lit(True)
        columns = [(e.dimension(d) if not e.lenient or e.has_dimension(d) else F.lit(None).cast("string")).alias(d) for d in dict.fromkeys([*self.dims, *self.row_dims])]
        columns += [F.col(f"`b__{b}`") for b in bases]
        columns += [e.base_column(e.bases[b]["weight_column"]).alias(f"w__{b}") for b in bases if e.bases[b].get("weight_column")]
        columns += [e.physical(c[1]).alias(f"e__{c[1]}") for c in {c[1]: c for c in getattr(self, "cohorts", {}).values()}.values()]
        columns += [(e.bucket() if e.time else F.lit(None).cast("date")).alias("_p"), (e.time_column() if e.time else F.lit(None).cast("date")).alias("_t"), F.when(seen, 1).alias("_observed")]
        return df.select(*columns)

    #: Aggregations that one fold by dimensions and period serves for leaves and series.
    FOLDED = ("sum", "count", "min", "max", "avg")

    def _folded_leaf(self, name: str) -> Column:
        """A leaf from values by dimensions and period."""
        base, test, window = self.folded[name]
        b = self.e.bases[base]
        held = lambda c: F.col(c) if test is None else F.when(test, F.col(c))
        if b["agg"] == "avg":
            return F.try_divide(F.sum(held(f"`f__{base}`")), F.sum(held(f"`n__{base}`")))
        value = {"min": F.min, "max": F.max}.get(b["agg"], F.sum)(held(f"`f__{base}`"))
        if b["agg"] not in aggregates.ZERO_WHEN_EMPTY:
            return value
        value = value.cast("double") if b["agg"] == "count" else value
        if b["agg"] == "count":
            value = F.coalesce(value, F.lit(0.0))
        if window:
            return F.coalesce(value, F.lit(0.0))
        seen = F.max(held("_seen"))
        return F.when(seen.isNotNull(), value if self.e.masked(base) else F.coalesce(value, F.lit(0.0)))

    def grouped(self) -> DataFrame:
        facts = self.facts()
        dims = [F.col(f"`{d}`") for d in self.dims]
        bases = {b for b, _, _, w in self.series_of.values() for b in (b, w) if b}
        collected = []
        for name, (base, start, end, weight) in self.series_of.items():
            inside = F.col("_p").between(F.lit(start), F.lit(end))
            fields = [F.col("_p").alias("p"), F.col(f"v__{base}").alias("v")] + ([F.col(f"v__{weight}").alias("w")] if weight else [])
            collected.append(F.sort_array(F.collect_list(F.when(inside & F.col(f"v__{base}").isNotNull(), F.struct(*fields)))).alias(name))  # one entry a period
        parts = []
        if self.series_of and not self.e.related and set(self.folded) == set(self.leaves):
            # one scan: fold by dimensions and period, then leaves and series from the folds
            read = bases | {b for b, _, _ in self.folded.values()}
            by = [self._aggregate(b, None).alias(f"v__{b}") for b in bases]
            for b in read:
                agg, v = self.e.bases[b].get("agg"), F.col(f"`b__{b}`")
                if agg in self.FOLDED:
                    by.append((F.sum(v.try_cast("double")) if agg == "avg" else aggregates.aggregate(agg, v)).alias(f"f__{b}"))
                    by += [F.count(v.try_cast("double")).alias(f"n__{b}")] if agg == "avg" else []
            per = facts.groupBy(*dims, "_p").agg(*by, F.max("_observed").alias("_seen"))
            out = per.groupBy(*dims).agg(*[self._folded_leaf(n).alias(n) for n in self.leaves], *collected, F.lit(1).alias("_one"))
        else:
            out = facts.groupBy(*dims).agg(*[c.alias(n) for n, c in self.leaves.items()], F.lit(1).alias("_one"))
            if self.series_of:
                per = facts.filter(F.col("_p").isNotNull()).groupBy(*dims, "_p").agg(*[self._aggregate(b, None).alias(f"v__{b}") for b in bases], F.max("_observed").alias("_seen"))
                parts.append(per.groupBy(*dims).agg(*collected))
        for key, (name, column, entry, anchor) in getattr(self, "cohorts", {}).items():
            entity = facts.filter(F.col(f"`e__{column}`").isNotNull()).groupBy(*dims, F.col(f"`e__{column}`").alias("_entity")).agg(F.min("_p").alias("_first"), F.max(F.when(F.col("_p") == F.lit(anchor), 1)).alias("_there"))
            member = F.col("_first") == F.lit(entry) if name == "cohort_retention" else F.col("_first") <= F.lit(entry)
            parts.append(entity.groupBy(*dims).agg(F.try_divide(F.count(F.when(member & (F.col("_there") == 1), 1)).cast("double"), F.count(F.when(member, 1)).cast("double")).alias(key)))
        for part in parts:
            part = part.select(*[F.col(f"`{d}`").alias(f"k__{d}") for d in self.dims], *[c for c in part.columns if c not in self.dims])
            on = functools.reduce(operator.and_, [F.col(f"`{d}`").eqNullSafe(F.col(f"`k__{d}`")) for d in self.dims]) if self.dims else F.lit(True)
            out = out.join(part, on, "left").drop(*[f"k__{d}" for d in self.dims])
        return out

    def result(self) -> DataFrame:
        e = self.e
        wanted = [k for k in e.requested if k in e.specs and self._on_this_cut(k)]
        having = e.kpi.get("having") if self.survivors is None else None
        for key in [*wanted, *({p["of"] for p in having["predicates"]} if having else ())]:
            if key in e.specs:
                self.build(key)
        own_having = {k: e.specs[k]["having"] for k in wanted if e.specs[k].get("having")}
        for rule in own_having.values():
            for n in [p[f] for p in rule["predicates"] for f in ("of", "vs") if isinstance(p.get(f), str)]:
                self._hold(n)
        tests = [self._predicate(p, ()) for p in having["predicates"]] if having else []
        if not self.leaves and not self.series_of and self.e.bases:
            self.used.add(next(b for b, s in e.bases.items() if "agg" in s))
        df = self.grouped()
        if e.kpi.get("row_set") == "anchor_only" and e.time:
            df = self._at_anchor(df)
        df = df.select(*[F.col(f"`{d}`") for d in self.dims], *self._raw(df), *[c.alias(f"m__{k}") for k, c in self.pending.items()])
        if tests:
            met = functools.reduce(operator.or_ if having.get("match") == "any" else operator.and_, tests)
            self.dropped = df.filter(~met)
            df = df.filter(met)
            if having.get("then_group_by") is not None:
                return self._regrouped(df, having["then_group_by"])
        for key in wanted:
            if e.specs[key].get("from_cut", self.spec["name"]) != self.spec["name"]:
                df = self._from_cut(df, key)
        for key in self.cut_phase:
            if self._versus(e.specs[key]):
                df = df.crossJoin(F.broadcast(self._other(e.specs[key]["versus_cut"]).total(key)))  # one row
            df = self._with_cut_value(df, key, e.specs[key])
        for key, rule in own_having.items():
            met = [self._met(p, self._held) for p in rule["predicates"]]
            df = df.withColumn(f"m__{key}", F.when(functools.reduce(operator.or_ if rule.get("match") == "any" else operator.and_, met), F.col(f"`m__{key}`")))
        columns = [F.lit(self.spec["name"]).alias("output_cut"), *[F.col(f"`{d}`") for d in self.dims], *[F.col(f"`m__{k}`").alias(k) for k in wanted if k not in self.dims]]
        if rule := e.kpi.get("green_when"):
            v = F.col(f"`m__{rule['of']}`").try_cast("double") if rule["of"] in wanted else F.lit(None).cast("double")
            columns.append((v >= F.lit(float(rule["above"])) if "above" in rule else v <= F.lit(float(rule["below"]))).alias("green"))
        df = df.select(*columns)
        for f in e.bound_filters():
            if f["stage"] == "result" and (column := next((d for d in self.dims if folded(d) in f["names"]), None)):
                df = df.filter(filters.predicate(F.col(f"`{column}`"), f["op"], f["operand"]))
        if e.kpi.get("omit_null_rows"):
            df = df.dropna("all", subset=[k for k in wanted if k not in self.dims])
        return df

    def _regrouped(self, kept: DataFrame, target: list[str]) -> DataFrame:
        """The measures of the surviving groups' rows by coarser dimensions."""
        if missing := [d for d in target if d not in self.dims]:
            raise BindError(f"having.then_group_by {missing} is not on cut {self.spec['name']!r}")
        plan = CutPlan(self.e, self.spec)
        # the rows carry the cut's dimensions until the survivors are chosen
        plan.survivors = kept.select(*[F.col(f"`{d}`").alias(f"k__{d}") for d in self.dims])
        plan.row_dims, plan.dims = self.dims, list(target)
        out = plan.result()
        return out.select(*out.columns, *[F.lit(None).cast(kept.schema[d].dataType).alias(d) for d in self.dims if d not in target])

    def _hold(self, name: str) -> None:
        """Makes a measure or base available after the groups' columns are built."""
        if name in self.e.specs:
            self.build(name)
        elif f"@{name}" not in self.done:
            self.pending[f"@{name}"] = self.value(name)
            self.done.append(f"@{name}")

    def _held(self, name: str) -> Column:
        return F.col(f"`m__{name}`") if name in self.e.specs else F.col(f"`m__@{name}`")

    def _with_cut_value(self, df: DataFrame, key: str, spec: dict) -> DataFrame:
        """``df`` with a cut operator's value.  Sums and the like over the whole
        cut are one row, broadcast, so that the groups stay where they are."""
        stats = STATS.get(spec["op"])
        value = self._cut_source(key, spec) if stats else None
        if not stats or self._partition(spec) or (spec["op"] in ("percent_of_total", "contribution") and self._versus(spec)):
            return df.withColumn(f"m__{key}", self._cut_value(key, spec))
        whole = df.agg(*[build(value).alias(f"t__{key}_{n}") for n, build in stats.items()])
        df = df.crossJoin(F.broadcast(whole))  # one row
        cut = Cut(value, [], [], {**spec, "order_by": [], "stats": {n: F.col(f"`t__{key}_{n}`") for n in stats}})
        return df.withColumn(f"m__{key}", CUT_OPS[spec["op"]](cut)).drop(*[f"t__{key}_{n}" for n in stats])

    def _partition(self, spec: dict) -> list[Column]:
        part = [F.col(f"`{d}`") for d in spec.get("partition_by", []) if d in self.dims]
        return part if len(part) < len(self.dims) else []

    def _cut_source(self, key: str, spec: dict) -> Column:
        v = F.col(f"`m__@{key}`") if spec["op"] == "rank_pct_change" else self._held(spec["of"])
        return v - self._held(spec["vs"]) if spec["op"] == "contribution" else v

    @staticmethod
    def _versus(spec: dict) -> bool:
        """Other cut operators accept versus_cut without effect."""
        return bool(spec.get("versus_cut")) and spec["op"] in ("percent_of_total", "contribution")

    def _other(self, name: str) -> CutPlan:
        if name not in self.e.cuts:
            raise BindError(f"no cut {name!r}")
        return CutPlan(self.e, self.e.cuts[name])

    def _early(self, name) -> Column:
        if self._late(name):
            raise BindError(f"{name!r} is known only once its cut is finished")
        return self.value(name)

    def total(self, key: str) -> DataFrame:
        """One row: the sum of a cut operator's source over this cut's groups."""
        spec, having = self.e.specs[key], self.e.kpi.get("having")
        value = self._early(spec["of"]) - (self._early(spec["vs"]) if spec["op"] == "contribution" else F.lit(0.0))
        tests = [self._predicate(p, ()) for p in having["predicates"]] if having else []
        df = self.grouped()
        if tests:
            df = df.filter(functools.reduce(operator.or_ if having.get("match") == "any" else operator.and_, tests))
        return df.agg(F.sum(value).alias(f"t__{key}"))

    def _from_cut(self, df: DataFrame, key: str) -> DataFrame:
        """A measure's value replaced by that of a coarser cut's group."""
        if self.e.specs[key]["op"] in (*CUT_OPS, *TREND_OPS):
            raise BindError(f"{key!r}: from_cut needs a scalar measure")
        other = self._other(self.e.specs[key]["from_cut"])
        if not set(other.dims) <= set(self.dims):
            raise BindError(f"{key!r}: cut {other.spec['name']!r} is finer than {self.spec['name']!r}")
        value = other._early(key)
        coarse = other.grouped().select(*[F.col(f"`{d}`").alias(f"k__{d}") for d in other.dims], value.alias("_coarse"))
        on = functools.reduce(operator.and_, [F.col(f"`{d}`").eqNullSafe(F.col(f"`k__{d}`")) for d in other.dims], F.lit(True))
        return df.join(coarse, on, "left").withColumn(f"m__{key}", F.col("_coarse")).drop("_coarse", *[f"k__{d}" for d in other.dims])

    def _raw(self, df: DataFrame) -> list[Column]:
        return [F.col(c) for c in df.columns if c not in self.dims and c != "_one"]

    def _on_this_cut(self, key: str) -> bool:
        spec = self.e.specs[key]
        fixed = spec["op"] in CUT_OPS or spec["op"] in TREND_OPS
        cuts = spec.get("cuts") or ([self.e.kpi.get("default_cut") or next(iter(self.e.cuts))] if fixed else None)
        return cuts is None or self.spec["name"] in cuts

    def _at_anchor(self, df: DataFrame) -> DataFrame:
        if not self.dims:
            seen = self.facts().filter((F.col("_p") == F.lit(self.anchor(()))) & (F.col("_observed") == 1)).limit(1).select(F.lit(1).alias("_there"))
            return df.join(F.broadcast(seen), F.lit(True), "left_semi")  # one group
        there = self.facts().filter((F.col("_p") == F.lit(self.anchor(()))) & (F.col("_observed") == 1)).select(*[F.col(f"`{d}`").alias(f"k__{d}") for d in self.dims]).distinct()
        return df.join(there, functools.reduce(operator.and_, [F.col(f"`{d}`").eqNullSafe(F.col(f"`k__{d}`")) for d in self.dims]), "left_semi")

    def _cut_value(self, key: str, spec: dict) -> Column:
        held = self._held
        if spec["op"] not in CUT_OPS:
            return self._derived(spec, held)
        ties = [F.col(f"`{d}`").asc_nulls_last() for d in self.dims]
        extra = dict(spec)
        if self._versus(spec):
            extra["total"] = F.col(f"`t__{key}`")
        extra["order_by"] = [held(o["key"] if isinstance(o, dict) else o).desc_nulls_last() for o in spec.get("order_by", [])]
        return CUT_OPS[spec["op"]](Cut(self._cut_source(key, spec), self._partition(spec), ties, extra))

    def _derived(self, spec: dict, held) -> Column:
        if spec["op"] == "expr":
            return expressions.compile_(spec["expr"], held, MEASURE_FUNCTIONS, self.e.parameters)
        given = spec.get("inputs") or (spec["of"] if isinstance(spec.get("of"), list) else [spec["left"], spec["right"]])
        given = list(given.values()) if isinstance(given, dict) else given
        return self._function(spec.get("fn", "divide"), [held(n) if isinstance(n, str) else F.lit(float(n)) for n in given], spec)


def order(df: DataFrame, sort: list[dict] | None, dims: list[str]) -> DataFrame:
    """YAML sort keys, nulls last either way; by default the cut and the
    dimensions as text."""
    if sort:
        keys = [F.col(f"`{s['key']}`").desc_nulls_last() if s.get("order", "asc") == "desc" else F.col(f"`{s['key']}`").asc_nulls_last() for s in sort]
    else:
        keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ["output_cut", *dims] if c in df.columns]
    return df.orderBy(*keys)
