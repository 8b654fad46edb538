"""Measures over several models: separate pipelines, or models joined after
each is folded by the relation's keys."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BindError
from ..functions import aggregates
from .definition import folded, listed
from .engine import CutPlan, Engine

JOINS = {"outer": "full_outer", "full": "full_outer", "left": "left", "right": "right", "inner": "inner"}
#: Aggregations whose folds can be folded again.
REFOLDED = (*aggregates.ADDITIVE, "avg", "weighted_avg")


@dataclass
class Pipeline:
    models: list[str]
    measures: list[str]


def model_of(kpi: dict, base: str) -> str:
    return str(kpi["base_measures"][base].get("model") or kpi.get("model") or "")


def models_read(engine: Engine, key: str, seen: tuple = ()) -> set[str]:
    """The models that a measure reads, directly or through others."""
    if key in engine.bases:
        return {model_of(engine.kpi, key)}
    spec = engine.specs.get(key)
    if spec is None or key in seen:
        return set()
    names = CutPlan(engine, next(iter(engine.cuts.values()))).inputs(spec)
    return functools.reduce(operator.or_, (models_read(engine, n, (*seen, key)) for n in names), set())


def pipelines(engine: Engine) -> list[Pipeline]:
    """The requested measures by the models that they read.  A measure that reads
    several joins them, which ``model_relations`` must allow; others on these
    models go with it."""
    alone: dict[str, list[str]] = {}
    joined: list[str] = []
    together: set[str] = set()
    for key in engine.requested:
        models = models_read(engine, key) or {str(engine.kpi.get("model") or "")}
        if len(models) > 1:
            if not engine.kpi.get("model_relations"):
                raise BindError(f"measures.{key} spans models {sorted(models)}: declare model_relations, or ask for one model at a time")
            joined.append(key)
            together |= models
        else:
            alone.setdefault(next(iter(models)), []).append(key)
    out = []
    if joined:
        extra = {k for m in together for k in alone.pop(m, [])}
        out.append(Pipeline(sorted(together), [k for k in engine.requested if k in joined or k in extra]))
    return out + [Pipeline([m], keys) for m, keys in alone.items()] or [Pipeline([str(engine.kpi.get("model") or "")], [])]


def _folded(plan: CutPlan, engine: Engine) -> DataFrame:
    """One model's facts by dimensions and period: sums, counts and the like of
    its bases, with the weights of averages."""
    own = CutPlan(engine, plan.spec)
    own.dims = [d for d in dict.fromkeys([*plan.dims, *plan.row_dims]) if engine.has_dimension(d)]
    own.span, own.used = list(plan.span), {b for b in plan.used if model_of(plan.e.kpi, b) == engine.model_id}
    for b in own.used:
        if engine.bases[b].get("agg") not in REFOLDED or engine.bases[b].get("over"):
            raise BindError(f"base {b!r} ({engine.bases[b].get('agg')}) can't be folded before models are joined")
    facts = own.own_facts()
    values = [F.max("_observed").alias("_observed")]
    for b in own.used:
        v, agg = F.col(f"`b__{b}`"), engine.bases[b]["agg"]
        if agg == "avg":
            values += [F.sum(v.try_cast("double")).alias(f"b__{b}"), F.count(v.try_cast("double")).alias(f"w__{b}")]
        elif agg == "weighted_avg":
            w = F.col(f"`w__{b}`").try_cast("double")
            ok = v.isNotNull() & w.isNotNull() & (w != 0)
            values += [F.sum(F.when(ok, v.try_cast("double") * w)).alias(f"b__{b}"), F.sum(F.when(ok, w)).alias(f"w__{b}")]
        else:
            values.append(aggregates.aggregate(agg, v).alias(f"b__{b}"))
    return facts.groupBy(*[F.col(f"`{d}`") for d in own.dims], "_p").agg(*values)


def joined_facts(plan: CutPlan) -> DataFrame:
    """The folds of the related models, joined one after the other on time and
    the dimensions that the relation names; null keys meet null keys.  A column
    that both sides have comes from the left."""
    e = plan.e
    frames = {x.model_id: _folded(plan, x) for x in e.related}
    time = folded((e.time or {}).get("column", ""))
    out, present = None, set()
    for rel in e.kpi["model_relations"]:
        left_id, right_id = model_of(e.kpi, rel["left"]), model_of(e.kpi, rel["right"])
        if not {left_id, right_id} <= set(frames):
            continue
        how = JOINS.get(str(rel.get("how", "outer")).lower())
        if how is None:
            raise BindError(f"model_relations: no join {rel['how']!r}")
        left = out if out is not None and left_id in present else frames[left_id]
        right = frames[right_id]
        keys = ["_p" if folded(k) == time else k for k in listed(rel["on"])]
        keys = [k for k in keys if k in left.columns and k in right.columns]
        if not keys:
            raise BindError(f"model_relations.on {rel['on']} isn't in both extracts")
        seen = F.coalesce(F.col("_observed"), F.col("r___observed")).alias("_observed")
        right = right.select(*[F.col(f"`{c}`").alias(f"r__{c}") for c in right.columns])
        on = functools.reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`r__{k}`")) for k in keys])
        both = left.join(right, on, how)
        columns = [F.coalesce(F.col(f"`{k}`"), F.col(f"`r__{k}`")).alias(k) for k in keys]
        columns += [F.col(f"`{c}`") for c in left.columns if c not in (*keys, "_observed")] + [seen]
        columns += [F.col(f"`{c}`").alias(c.removeprefix("r__")) for c in right.columns if c.removeprefix("r__") not in (*left.columns, *keys)]
        out = both.select(*columns)
        present |= {left_id, right_id}
    if out is None or not set(frames) <= present:
        raise BindError(f"model_relations don't join models {sorted(frames)}")
    missing = [d for d in dict.fromkeys([*plan.dims, *plan.row_dims]) if d not in out.columns]
    return out.select("*", *[F.lit(None).cast("string").alias(d) for d in missing], F.col("_p").alias("_t"))
