"""Model sources: Parquet and Delta scans, physical joins, SQL models."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import BindError

JOINS = {"left": "left", "inner": "inner", "right": "right"}


def scan(spark: SparkSession, path: str, table_type: str = "PARQUET") -> DataFrame:
    """A lazy scan; Delta needs its jar on the session's class path."""
    if table_type.upper() == "DELTA" and not path.endswith(".parquet"):
        try:
            return spark.read.format("delta").load(path)
        except Exception as e:
            raise BindError(f"can't read Delta table {path}: {e}") from e
    return spark.read.parquet(path)


def paths(model: dict, datasets: dict) -> dict[str, tuple[str, str]]:
    """alias -> (path, table type); a request's path comes before defaults."""
    given = {}
    for key, d in datasets.items():
        for name in {str(d.get("alias") or key).lower(), key.lower()}:
            given[name] = (d["path"], d.get("table_type") or "PARQUET")
    out = {}
    for alias in {*model.get("sources", {}), *model.get("required_aliases", [])}:
        default = model.get("sources", {}).get(alias, {}).get("default_path") or model.get("default_paths", {}).get(alias)
        if alias.lower() in given:
            out[alias] = given[alias.lower()]
        elif default:
            out[alias] = (default, "PARQUET")
        else:
            raise BindError(f"no dataset for alias {alias!r}")
    return out


def load(spark: SparkSession, model: dict, datasets: dict) -> DataFrame:
    """The model's rows: joined scans, or a SQL text whose $alias_scan,
    $alias_path and read_parquet($alias_path) become views.  The text is Spark
    SQL: functions of other dialects are not translated."""
    found = paths(model, datasets)
    if model.get("kind", "physical") == "sql":
        text, own = model["sql"], uuid.uuid4().hex[:12]  # requests of one session don't share views
        for alias, (path, kind) in found.items():
            view = f"metricloom_{alias}_{own}"
            scan(spark, path, kind).createOrReplaceTempView(view)
            text = re.sub(rf"(?:read_parquet|delta_scan)\(\s*\${alias}_path\s*\)|\${alias}_scan\b|\${alias}_path\b", view, text)
        return spark.sql(text)
    names = list(model["sources"])
    out = scan(spark, *found[names[0]])
    for join in model.get("joins", []):
        right = scan(spark, *found[join.get("right") or join["source"]])
        keys = join["on"] if isinstance(join["on"], list) else [join["on"]]
        kind = JOINS.get(join.get("type", "left").lower())
        if not kind:
            raise BindError(f"no join type {join['type']!r}")
        right_keys = join.get("right_on", keys)
        for a, b in zip(keys, right_keys, strict=True):
            right = right.withColumnRenamed(b, a)
        extra = [c for c in right.columns if c not in out.columns or c in keys]  # the left side's columns win
        out = out.join(right.select(*extra), keys, kind)
    return out
