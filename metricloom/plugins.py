"""Operators and functions of hosts.

Nothing is imported by name from a definition: a host registers what it wants
known, from modules that the allowlist names."""

from __future__ import annotations

from collections.abc import Callable

from .errors import BindError
from .functions import hooks
from .functions.column import COLUMN_FUNCTIONS
from .functions.measure import MEASURE_FUNCTIONS
from .operators.cut_phase import CUT_OPS
from .plans.engine import COMBO_OPS, PERIOD_OPS, PLUGIN_OPS

#: Packages whose functions may be registered; a host may add its own.
ALLOWED = ["metricloom.", "metricloom_plugins."]
KINDS: dict[str, dict] = {"column_functions": COLUMN_FUNCTIONS, "measure_functions": MEASURE_FUNCTIONS, "hooks": hooks.HOOKS, "ops": PLUGIN_OPS}
_OWN: set[tuple[str, str]] = set()


def register(kind: str, name: str, build: Callable, module: str | None = None) -> None:
    """Adds a builder of Columns under ``name``.

    column_functions and measure_functions: of Columns; hooks: of a series
    (array of p, v) and its Context; ops: of (plan, spec, shifts).  ``module``:
    where the builder comes from, by default its own module."""
    module = module or build.__module__
    if kind not in KINDS:
        raise BindError(f"no kind {kind!r}: one of {sorted(KINDS)}")
    if not any(f"{module}.".startswith(a) for a in ALLOWED):
        raise BindError(f"module {module!r} is not allowed")
    taken = {*KINDS[kind], *(CUT_OPS if kind == "ops" else ()), *((*COMBO_OPS, *PERIOD_OPS) if kind == "ops" else ())}
    if name in taken:
        raise BindError(f"{kind} {name!r} exists")
    if not name.isidentifier():
        raise BindError(f"{name!r} is no name")
    KINDS[kind][name] = build
    _OWN.add((kind, name))


def unregister(kind: str, name: str) -> None:
    """Takes out what ``register`` added."""
    if (kind, name) not in _OWN:
        raise BindError(f"{kind} {name!r} was not registered")
    _OWN.discard((kind, name))
    del KINDS[kind][name]
