"""The sixteen filter operators and mask expressions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError, FilterError

# fixed values: the query language's spellings
ALIASES = {
    "==": "eq", "=": "eq", "equals": "eq", "<>": "ne", "!=": "ne", "not_equals": "ne", "<": "lt", "<=": "lte", "le": "lte", ">": "gt", ">=": "gte", "ge": "gte",
    "not like": "not_like", "notlike": "not_like", "not between": "not_between", "is null": "is_null", "isnull": "is_null", "is not null": "is_not_null",
    "notnull": "is_not_null", "regex": "regexp", "iregexp": "regexp_insensitive", "regex_insensitive": "regexp_insensitive",
}
PATTERN_CHARS, MASK_DEPTH = 256, 3


def _like(value: str) -> str:
    return str(value).replace("\\", "\\\\")  # a backslash is a plain character


def _pattern(value: str) -> str:
    if len(str(value)) > PATTERN_CHARS:
        raise FilterError(f"pattern longer than {PATTERN_CHARS}")
    return str(value)


OPERATORS = {
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: c != F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "like": lambda c, v: c.like(_like(v)),
    "ilike": lambda c, v: c.ilike(_like(v)),
    "not_like": lambda c, v: ~c.like(_like(v)),
    "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "not_between": lambda c, v: ~c.between(F.lit(v[0]), F.lit(v[1])),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
    "regexp": lambda c, v: c.rlike(_pattern(v)),
    "regexp_insensitive": lambda c, v: c.rlike("(?i)" + _pattern(v)),
}


def canonical(op: str, error: type = FilterError) -> str:
    """An operator's name, from any spelling in any case."""
    name = " ".join(str(op).lower().split())
    name = ALIASES.get(name, name)
    if name not in OPERATORS:
        raise error(f"no filter operator {op!r}")
    return name


def operand(op: str, values, code: str = ""):
    """The value that an operator takes of a request's list of values."""
    values = list(values) if isinstance(values, (list, tuple)) else [] if values is None else [values]
    if op in ("is_null", "is_not_null"):
        return None
    if op == "in":
        return values
    wanted = 2 if op in ("between", "not_between") else 1
    if len(values) != wanted:
        raise FilterError(f"filter {code!r}: {op} takes {wanted} value(s), not {len(values)}")
    return values if wanted == 2 else values[0]


def predicate(column: Column, op: str, value=None) -> Column:
    """A test that a null value never passes (but ``is_null``)."""
    return OPERATORS[canonical(op)](column, value)


def mask(node: dict | list, column, depth: int = 1) -> Column:
    """A mask: {column, op, value}, {and: [...]}, {or: [...]}, {not: ...} or a
    list (all).  ``column``: name -> Column.  ``not`` needs its columns non-null."""
    if depth > MASK_DEPTH + 1:
        raise BindError(f"mask deeper than {MASK_DEPTH}")
    if isinstance(node, list):
        node = {"and": node}
    if "and" in node or "or" in node:
        key = "and" if "and" in node else "or"
        out = None
        for part in node[key]:
            here = F.coalesce(mask(part, column, depth + 1), F.lit(False))
            out = here if out is None else (out & here if key == "and" else out | here)
        return out
    if "not" in node:
        names = _names(node["not"])
        return ~F.coalesce(mask(node["not"], column, depth + 1), F.lit(False)) & F.forall(F.array(*[column(n).isNotNull() for n in names]), lambda x: x)
    return predicate(column(node["column"]), node.get("op", "eq"), node.get("value", node.get("values")))


def _names(node) -> list[str]:
    if isinstance(node, list):
        return [n for x in node for n in _names(x)]
    for key in ("and", "or", "not"):
        if key in node:
            return _names(node[key])
    return [node["column"]]
