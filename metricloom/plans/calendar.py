"""Calendar arithmetic on the driver: buckets, offsets, selections, windows."""

from __future__ import annotations

import calendar as _cal
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from ..errors import TimePlanError

GRAINS = ("day", "week", "month", "quarter", "year")
PER_YEAR = {"day": 365, "week": 52, "month": 12, "quarter": 4, "year": 1}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
# fixed values: English names, whatever the locale
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PARTS = ("year", "quarter", "month", "week", "day")
WIDE_DAYS = 3650


class Fiscal(int):
    """The month in which fiscal quarters start; years start in ``year``: there
    too, or in January where a request chose calendar years."""

    year: int

    def __new__(cls, start: int, year: int | None = None) -> Fiscal:
        out = super().__new__(cls, start)
        out.year = year or start
        return out


def add_months(d: date, n: int) -> date:
    """The day of month is kept, or clamped to the month's end."""
    m = d.year * 12 + d.month - 1 + n
    return date(m // 12, m % 12 + 1, min(d.day, _cal.monthrange(m // 12, m % 12 + 1)[1]))


def truncate(d: date | datetime | str, grain: str, fiscal_start: int = 1) -> date:
    """Start of the bucket; weeks start on Monday, fiscal quarters and years at
    ``fiscal_start``."""
    if isinstance(d, str):
        d = date.fromisoformat(d[:10])
    d = date(d.year, d.month, d.day)
    if grain == "day":
        return d
    if grain == "week":
        return d - timedelta(d.weekday())
    if grain == "month":
        return d.replace(day=1)
    shift = (getattr(fiscal_start, "year", fiscal_start) if grain == "year" else fiscal_start) - 1
    base = add_months(d.replace(day=1), -shift)
    month = (base.month - 1) // 3 * 3 + 1 if grain == "quarter" else 1
    if grain not in ("quarter", "year"):
        raise TimePlanError(f"no grain {grain!r}")
    return add_months(date(base.year, month, 1), shift)


def add_periods(d: date, grain: str, n: int) -> date:
    if grain in ("day", "week"):
        return d + timedelta(n * (7 if grain == "week" else 1))
    return add_months(d, n * MONTHS[grain])


def steps(a: date, b: date, grain: str) -> int:
    """Grain steps from bucket a to bucket b."""
    if grain in ("day", "week"):
        return (b - a).days // (7 if grain == "week" else 1)
    return ((b.year - a.year) * 12 + b.month - a.month) // MONTHS[grain]


@dataclass(frozen=True)
class Offset:
    """A shift into the past: calendar units, or grain steps (``periods``)."""

    days: int = 0
    weeks: int = 0
    months: int = 0
    quarters: int = 0
    years: int = 0
    periods: int = 0

    @classmethod
    def of(cls, value) -> Offset:
        if isinstance(value, Offset):
            return value
        value = dict(value or {})
        if unknown := set(value) - set(cls.__dataclass_fields__):
            raise TimePlanError(f"offset: unknown {sorted(unknown)}")
        if value.get("periods") and len([v for v in value.values() if v]) > 1:
            raise TimePlanError("offset: periods exclude calendar units")
        return cls(**value)

    def __bool__(self) -> bool:
        return any((self.days, self.weeks, self.months, self.quarters, self.years, self.periods))

    def shift(self, d: date, grain: str, fiscal_start: int = 1) -> date:
        if self.periods:
            return add_periods(d, grain, -self.periods)
        d = add_months(d, -(self.months + 3 * self.quarters + 12 * self.years))
        return truncate(d - timedelta(self.days + 7 * self.weeks), grain, fiscal_start)


def shifted(selection: tuple[date, ...], offset: Offset, grain: str, fiscal_start: int = 1) -> tuple[date, ...]:
    return tuple(sorted({offset.shift(d, grain, fiscal_start) for d in selection})) if offset else selection


def spine(start: date, end: date, grain: str) -> list[date]:
    """Buckets from start to end, both included."""
    out = []
    while start <= end:
        out.append(start)
        start = add_periods(start, grain, 1)
    return out


def window_bounds(ref: date, grain: str, spec: dict, fiscal_start: int = 1) -> tuple[date, date]:
    """First and last bucket of a window around ``ref``.  spec: range, trailing
    (a number of grain steps or {unit: n}), inclusive, offset."""
    ref = Offset.of(spec.get("offset")).shift(ref, grain, fiscal_start) if spec.get("offset") else ref
    kind = spec.get("range", "trailing")
    to_date = {"ytd": "year", "cumulative": "year", "qtd": "quarter", "mtd": "month", "wtd": "week"}
    if kind in to_date:
        return truncate(truncate(ref, to_date[kind], fiscal_start), grain, fiscal_start), ref
    full = {"full_month": "month", "full_quarter": "quarter", "full_year": "year"}
    if kind in full:
        start = truncate(ref, full[kind], fiscal_start)
        return start, truncate(add_periods(start, full[kind], 1) - timedelta(1), grain, fiscal_start)
    n = spec.get("trailing", 1)
    if isinstance(n, dict):
        (unit, n), = n.items()
        unit = unit.rstrip("s")
        unit = grain if unit == "period" or spec.get("align") == "periods" else unit
    else:
        unit = grain
    if kind == "leading":
        end = truncate(add_periods(ref, unit, n), grain, fiscal_start)
        return (ref, add_periods(end, grain, -1)) if spec.get("inclusive", True) else (add_periods(ref, grain, 1), end)
    if kind != "trailing":
        raise TimePlanError(f"no window range {kind!r}")
    start = truncate(add_periods(ref, unit, -n), grain, fiscal_start)
    return (add_periods(start, grain, 1), ref) if spec.get("inclusive", True) else (start, add_periods(ref, grain, -1))


def label(d: date, grain: str, fiscal_start: int = 1) -> str:
    """A period's label in trends."""
    if grain == "week":
        year, week, _ = d.isocalendar()
        return f"{year}-W{week:02d}"
    if grain == "quarter":
        base = add_months(d, 1 - fiscal_start)
        return f"{base.year}-Q{(base.month - 1) // 3 + 1}"
    if grain == "year":
        return str(add_months(d, 1 - getattr(fiscal_start, "year", fiscal_start)).year)
    month = MONTH_NAMES[d.month - 1][:3]
    return f"{month} {d.year}" if grain == "month" else f"{d.day} {month}"


def parsed(value, fmt: str | None = None) -> date:
    """A request's date: ISO, a year and month, or as ``fmt`` (yyyymm, dd/mm/yyyy
    and the like) has it."""
    if isinstance(value, date):
        return value
    text = str(value).strip()
    try:
        if re.fullmatch(r"\d{4}-\d{2}(-\d{2}.*)?", text):
            return date.fromisoformat(f"{text}-01"[:10])
        fmt = (fmt or "yyyymm").lower()
        digits = re.sub(r"\D", "", text).zfill(len(re.sub(r"[^ymd]", "", fmt)))
        fields = {c: "".join(d for d, f in zip(digits, re.sub(r"[^ymd]", "", fmt), strict=True) if f == c) for c in "ymd"}
        return date(int(fields["y"]), int(fields["m"] or 1), int(fields["d"] or 1))
    except ValueError as e:
        raise TimePlanError(f"can't read the date {value!r}" + (f" as {fmt}" if fmt else "")) from e


def part_values(part: str, values) -> tuple[int, ...]:
    """Whole numbers of a time part; months by name, number or padded number."""
    names = {n: i + 1 for i, m in enumerate(MONTH_NAMES) for n in (m.lower(), m[:3].lower())} | {"sept": 9}
    out = []
    for v in values if isinstance(values, (list, tuple)) else [values]:
        text = str(v).strip()
        if part == "month" and text.lower() in names:
            out.append(names[text.lower()])
        elif isinstance(v, (bool, float)) or not text.lstrip("-").isdigit():
            raise TimePlanError(f"can't read {part} {v!r}: a whole number" + (" or a month's name" if part == "month" else ""))
        else:
            out.append(int(text))
    return tuple(out)


def matches(bucket: date, parts: dict[str, tuple[int, ...]], fiscal_start: int = 1) -> bool:
    """Whether a bucket has one of the values of each part; with weeks, years are
    those of ISO weeks."""
    year = bucket.isocalendar().year if "week" in parts else bucket.year if getattr(fiscal_start, "year", fiscal_start) == 1 else add_months(bucket, 1 - fiscal_start).year
    quarter = (add_months(bucket.replace(day=1), 1 - fiscal_start).month - 1) // 3 + 1
    have = {"year": year, "quarter": quarter, "month": bucket.month, "week": bucket.isocalendar().week, "day": bucket.day}
    return all(have[p] in v for p, v in parts.items())


def selection(spec, grain: str, fiscal_start: int = 1) -> tuple[date, ...]:
    """Buckets of a request's time value: a date, a list of dates, {from, to}, or
    parts {year, quarter, month, week, day} that conjoin; years are calendar
    years, and none may fit.  Parts without a year are ``matches`` of the
    source's buckets."""
    if isinstance(spec, (str, date)):
        return (truncate(spec, grain, fiscal_start),)
    if isinstance(spec, (list, tuple)):
        return tuple(sorted({truncate(x, grain, fiscal_start) for x in spec}))
    if "from" in spec:
        return tuple(spine(truncate(spec["from"], grain, fiscal_start), truncate(spec["to"], grain, fiscal_start), grain))
    parts = {p: part_values(p, v) for p, v in spec.items() if v not in (None, [], "")}
    if finer := [p for p in parts if GRAINS.index(p) < GRAINS.index(grain)]:
        raise TimePlanError(f"time part {finer[0]} is finer than the grain {grain}")
    if "year" not in parts:
        raise TimePlanError("without a year the source's buckets decide")
    fiscal_start = Fiscal(fiscal_start, 1)
    first, last = truncate(date(min(parts["year"]), 1, 1), grain, fiscal_start), date(max(parts["year"]), 12, 31)
    return tuple(d for d in spine(first, last, grain) if matches(d, parts, fiscal_start))
