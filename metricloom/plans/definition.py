"""Checks and normal form of a metric definition, before any data is read."""

from __future__ import annotations

import re

from ..errors import BindError
from ..operators import filters
from ..operators.cut_phase import CUT_OPS

STAGES = ("extract", "calc", "result")
_PLACE = re.compile(r"\{([^{}:]+)(?::0?(\d+))?\}")


def folded(name) -> str:
    return str(name).strip().lower().replace(" ", "_")


def listed(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def template_names(template: str) -> list[str]:
    """The filter codes that a ``{year}{month:02}`` template joins."""
    names = [m.group(1).strip() for m in _PLACE.finditer(template)]
    rest = _PLACE.sub("", template)
    if "{" in rest or "}" in rest:
        raise BindError(f"{template!r}: a brace is unmatched or holds what is not a filter code")
    if len(names) < 2:
        raise BindError(f"{template!r} must join at least two context filters")
    return names


def expanded(template: str, given: dict) -> str:
    """The template with each code's one value; ``:02`` pads with zeros."""

    def value(match: re.Match) -> str:
        found = [v for code, v in given.items() if folded(code) == folded(match.group(1))]
        values = listed(found[0].get("values", found[0].get("value")) if isinstance(found[0], dict) else found[0]) if found else []
        if len(values) != 1:
            raise BindError(f"{template!r} needs one value of {match.group(1)!r}, not {len(values)}")
        return str(values[0]).zfill(int(match.group(2) or 0))

    template_names(template)
    return _PLACE.sub(value, template)


def filter_specs(kpi: dict) -> dict[str, dict]:
    """code -> column, op, apply, required, default, compose."""
    given = kpi.get("filters") or {}
    if isinstance(given, list):
        given = {f.get("code") or f["name"]: f for f in given}
    out = {}
    for code, spec in given.items():
        spec = dict(spec or {})
        stage = str(spec.get("apply") or "extract").lower()
        if stage not in STAGES:
            raise BindError(f"filters.{code}: apply must be one of {list(STAGES)}")
        if spec.get("required") and spec.get("default") is not None:
            raise BindError(f"filters.{code}: required: true and default exclude each other")
        template = (spec.get("compose") or {}).get("template")
        if template:
            template_names(template)
        default = spec.get("default")
        out[code] = {"column": spec.get("column"), "op": filters.canonical(spec.get("op") or spec.get("operator") or "in", BindError), "apply": stage, "required": bool(spec.get("required")), "default": None if default is None else listed(default), "compose": template}
    for code, column in (kpi.get("filter_map") or {}).items():
        out.setdefault(code, {"column": column, "op": "in", "apply": "extract", "required": False, "default": None, "compose": None})
    return out


def _cuts(kpi: dict) -> None:
    cuts = kpi.get("cuts") or []
    names = [c["name"] for c in cuts]
    if len(set(names)) < len(names):
        raise BindError("two cuts have one name")
    rollups = {}
    stages = {code: f["apply"] for code, f in filter_specs(kpi).items()}
    for cut in cuts:
        for other in [*listed(cut.get("also_emit")), *listed(cut.get("rollup_from"))]:
            if other not in names:
                raise BindError(f"cuts.{cut['name']} names {other!r}, which is not a declared cut")
        ignored = {folded(c) for k in ("ignore_filters", "reset_filters") for c in listed(cut.get(k))}
        if both := {folded(c) for c in listed(cut.get("inherit_filters"))} & ignored:
            raise BindError(f"cuts.{cut['name']}: inherit_filters and ignore_filters both name {sorted(both)}")
        if both := {code for code, stage in stages.items() if stage == "result" and folded(code) in ignored}:
            raise BindError(f"cuts.{cut['name']} ignores {sorted(both)}, which apply to results")
        if cut.get("rollup_from"):
            rollups[cut["name"]] = cut["rollup_from"]
    for name in rollups:
        path = [name]
        while path[-1] in rollups:
            path.append(rollups[path[-1]])
            if path[-1] == name:
                raise BindError(f"rollup_from cycle: {' -> '.join(path)}")
    if kpi.get("default_cut") and names and kpi["default_cut"] not in names:
        raise BindError(f"default_cut {kpi['default_cut']!r} is not a declared cut")


def checked(kpi: dict, ops: tuple[str, ...]) -> dict:
    """``kpi`` with default cuts of measures filled in; BindError where it
    contradicts itself.  ``ops``: the operators that exist."""
    _cuts(kpi)
    names = [c["name"] for c in kpi.get("cuts") or []]
    measures = {}
    bases = kpi.get("base_measures") or {}
    for key, spec in (kpi.get("measures") or {}).items():
        spec = dict(spec)
        op = spec.get("op") or spec.get("kind")
        if op not in ops:
            raise BindError(f"measures.{key}: no operator {op!r}")
        for field in ("versus_cut", "from_cut"):
            if spec.get(field) and spec[field] not in names:
                raise BindError(f"measures.{key} {field} {spec[field]!r} is not a declared cut")
        if spec.get("versus_cut") and op not in CUT_OPS:
            raise BindError(f"measures.{key}: versus_cut is for operators across a cut's groups, not {op}")
        if spec.get("ignore_filters") and spec.get("of") not in bases:
            raise BindError(f"measures.{key}: ignore_filters needs of: a base measure")
        if unknown := [c for c in listed(spec.get("cuts")) if c not in names]:
            raise BindError(f"measures.{key} cuts {unknown} are not declared")
        measures[key] = spec
    by_cut = kpi.get("default_measures_by_cut") or {}
    omitted = {k for k, s in measures.items() if not s.get("cuts")}
    for cut, keys in by_cut.items():
        if cut not in names:
            raise BindError(f"default_measures_by_cut names {cut!r}, which is not a declared cut")
        for key in keys:
            if key not in measures:
                raise BindError(f"default_measures_by_cut.{cut} names {key!r}, which is not a measure")
            if key in omitted:
                measures[key]["cuts"] = [*listed(measures[key].get("cuts")), cut]
    rule = kpi.get("green_when")
    if rule and (rule.get("of") not in measures or ("above" in rule) == ("below" in rule)):
        raise BindError("green_when needs of: a measure and one of above and below")
    if (kpi.get("time") or {}).get("compose"):
        template_names(kpi["time"]["compose"]["template"])
    return {**kpi, "measures": measures}
