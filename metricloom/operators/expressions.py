"""The formula language, compiled to Columns.

or > and > not > comparison (= <> != < > <= >=, IS [NOT] NULL, IN) > + - > * /
> unary, CASE WHEN ... THEN ... ELSE ... END, calls, names, numbers, 'text',
NULL.  Results are doubles; truth is 1.0, 0.0 or null."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|'((?:[^']|'')*)'|([A-Za-z_]\w*)|(<>|!=|<=|>=|[-+*/(),=<>]))")
WORDS = {"or", "and", "not", "is", "null", "in", "case", "when", "then", "else", "end"}


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple:
    """The formula as nested tuples."""
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise BindError(f"can't read {text[at:].strip()[:20]!r} in {text!r}")
        number, string, name, sign = m.groups()
        if number is not None:
            tokens.append(("number", float(number)))
        elif string is not None:
            tokens.append(("text", string.replace("''", "'")))
        elif name is not None:
            tokens.append(("word", name.lower()) if name.lower() in WORDS else ("name", name))
        else:
            tokens.append(("sign", sign))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek(*values) -> bool:
        return tokens[place][0] in ("word", "sign") and tokens[place][1] in values

    def take(*values):
        nonlocal place
        if values and not peek(*values):
            raise BindError(f"{' or '.join(values)} expected in {text!r}")
        place += 1
        return tokens[place - 1][1]

    def either() -> tuple:
        left = both()
        while peek("or"):
            take()
            left = ("or", left, both())
        return left

    def both() -> tuple:
        left = negated()
        while peek("and"):
            take()
            left = ("and", left, negated())
        return left

    def negated() -> tuple:
        if peek("not"):
            take()
            return ("not", negated())
        return compared()

    def compared() -> tuple:
        left = added()
        if peek("is"):
            take()
            no = peek("not") and bool(take())
            take("null")
            return ("notnull" if no else "isnull", left)
        no = peek("not") and bool(take())
        if peek("in"):
            take()
            take("(")
            items = [either()]
            while peek(","):
                take()
                if not peek(")"):
                    items.append(either())
            take(")")
            found = ("in", left, *items)
            return ("not", found) if no else found
        if peek("=", "<>", "!=", "<", ">", "<=", ">="):
            return (take(), left, added())
        return left

    def added() -> tuple:
        left = multiplied()
        while peek("+", "-"):
            left = (take(), left, multiplied())
        return left

    def multiplied() -> tuple:
        left = unary()
        while peek("*", "/"):
            left = (take(), left, unary())
        return left

    def unary() -> tuple:
        if peek("-", "+"):
            sign = take()
            return ("neg", unary()) if sign == "-" else unary()
        return atom()

    def atom() -> tuple:
        nonlocal place
        kind, value = tokens[place]
        if kind in ("number", "text"):
            place += 1
            return (kind, value)
        if peek("null"):
            take()
            return ("null",)
        if peek("("):
            take()
            inside = either()
            take(")")
            return inside
        if peek("case"):
            take()
            arms = []
            while peek("when"):
                take()
                test = either()
                take("then")
                arms.append((test, either()))
            other = ("null",)
            if peek("else"):
                take()
                other = either()
            take("end")
            if not arms:
                raise BindError(f"CASE without WHEN in {text!r}")
            return ("case", tuple(arms), other)
        if kind == "name":
            place += 1
            if peek("("):
                take()
                args = []
                while not peek(")"):
                    args.append(either())
                    if not peek(")"):
                        take(",")
                take(")")
                return ("call", value, *args)
            return ("name", value)
        raise BindError(f"unexpected {value!r} in {text!r}")

    out = either()
    if tokens[place][0] != "end":
        raise BindError(f"unexpected {tokens[place][1]!r} in {text!r}")
    return out


def names(node: tuple) -> set[str]:
    """The names that a formula reads."""
    if node[0] == "name":
        return {node[1]}
    return {n for part in node[1:] for n in (names(part) if isinstance(part, tuple) and part and isinstance(part[0], str) else {x for arm in part for a in arm for x in names(a)} if isinstance(part, tuple) else ())}


def number(c: Column) -> Column:
    return c.try_cast("double")


def compile_(text: str, column: Callable[[str], Column], functions: dict[str, Callable], parameters: dict | None = None) -> Column:
    """The formula's Column.  ``column`` gives a name's Column; parameters come
    before columns."""
    parameters = parameters or {}

    def is_text(node: tuple) -> bool:
        return node[0] == "text" or (node[0] == "name" and isinstance(parameters.get(node[1]), str))

    def raw(node: tuple) -> Column:
        if node[0] == "text":
            return F.lit(node[1])
        if node[0] == "name":
            return F.lit(parameters[node[1]]) if node[1] in parameters else column(node[1])
        return value(node)

    def test(node: tuple) -> Column:
        """The node as a truth value."""
        kind = node[0]
        if kind in ("and", "or"):
            a, b = test(node[1]), test(node[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~test(node[1])
        if kind in ("isnull", "notnull"):
            c = raw(node[1])
            return c.isNull() if kind == "isnull" else c.isNotNull()
        if kind == "in":
            items = node[2:]
            if len(items) == 1 and items[0][0] == "name" and isinstance(parameters.get(items[0][1]), (list, tuple)):
                listed = list(parameters[items[0][1]])
                return (raw(node[1]) if any(isinstance(x, str) for x in listed) else value(node[1])).isin(listed)
            as_text = any(map(is_text, items))
            return (raw(node[1]) if as_text else value(node[1])).isin([raw(i) if as_text else value(i) for i in items])
        if kind in ("=", "<>", "!=", "<", ">", "<=", ">="):
            as_text = is_text(node[1]) or is_text(node[2])
            a, b = (raw(n) if as_text else value(n) for n in node[1:])
            return {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[kind]
        return value(node) != 0

    def value(node: tuple) -> Column:
        kind = node[0]
        if kind == "number":
            return F.lit(node[1])
        if kind == "text":
            return F.lit(node[1])
        if kind == "null":
            return F.lit(None).cast("double")
        if kind == "name":
            return number(raw(node)) if not is_text(node) else raw(node)
        if kind == "neg":
            return -value(node[1])
        if kind in ("+", "-", "*", "/"):
            a, b = value(node[1]), value(node[2])
            return {"+": a + b, "-": a - b, "*": a * b}[kind] if kind != "/" else F.try_divide(a, b)
        if kind == "case":
            out = None
            for when, then in node[1]:
                out = F.when(test(when), value(then)) if out is None else out.when(test(when), value(then))
            return out.otherwise(value(node[2]))
        if kind == "call":
            if node[1].lower() not in functions:
                raise BindError(f"no function {node[1]!r}")
            return functions[node[1].lower()](*[raw(a) for a in node[2:]])
        return test(node).cast("double")

    return value(parse(text))
