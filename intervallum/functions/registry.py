"""Named scalar functions that definitions may call: builders from columns to a column, resolved when a plan is made."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a duration text.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "M": 2_592_000, "y": 31_536_000}


def parse_duration(text: str) -> float:
    """Seconds of a text like 90s, 15m, 24h, 3d, 2w, 6M (of 30 days) or 1y (of 365 days); parts may follow each other."""
    clean = (text or "").strip()
    parts = re.findall(r"(\d+)\s*([smhdwMy])", clean)
    if not parts or re.sub(r"\d+\s*[smhdwMy]\s*", "", clean):
        raise ValueError(f"not a duration: {text!r}")
    return float(sum(int(n) * SECONDS[u] for n, u in parts))


def duration(text: Column) -> Column:
    """The same of a column; null for other texts."""
    t, part = F.trim(text), F.lit(r"(\d+)\s*([smhdwMy])")
    of = F.create_map(*[F.lit(x) for u, n in SECONDS.items() for x in (u, float(n))])
    each = F.zip_with(F.regexp_extract_all(t, part, F.lit(1)), F.regexp_extract_all(t, part, F.lit(2)), lambda n, u: n.cast("double") * of[u])
    return F.when(t.rlike(r"^(?:\d+\s*[smhdwMy]\s*)+$"), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


@dataclass(frozen=True)
class Scalar:
    name: str
    build: Callable[..., Column]
    least: int
    most: int
    raw_only: bool


FUNCTIONS: dict[str, Scalar] = {}


def register(name: str, least: int = 1, most: int | None = None, raw_only: bool = False) -> Callable:
    """Register a builder under `name`. raw_only: not allowed inside trapezoids."""

    def keep(build: Callable[..., Column]) -> Callable[..., Column]:
        if name in FUNCTIONS:
            raise ValueError(f"function {name} is registered already")
        FUNCTIONS[name] = Scalar(name, build, least, least if most is None else most, raw_only)
        return build

    return keep


def call(name: str, *args: Column, trapezoid: bool = False) -> Column:
    """The column of a registered function; unknown names, wrong arity and raw-only functions in trapezoids are errors."""
    f = FUNCTIONS.get(name)
    if f is None:
        raise ValueError(f"unknown function {name}")
    if trapezoid and f.raw_only:
        raise ValueError(f"function {name} can't transform a trapezoid")
    if not f.least <= len(args) <= f.most:
        raise ValueError(f"function {name} takes {f.least} to {f.most} arguments, not {len(args)}")
    return f.build(*args)


@register("id", 1, 9)
def _same(x: Column, *_: Column) -> Column:
    return x


@register("mul", 2)
def _mul(x: Column, y: Column) -> Column:
    return x * y


@register("div", 2)
def _div(x: Column, y: Column) -> Column:
    """Null where y is 0, so the row is skipped."""
    return F.try_divide(x, y)


@register("add", 2)
def _add(x: Column, y: Column) -> Column:
    return x + y


@register("subtract", 2)
def _subtract(x: Column, y: Column) -> Column:
    return x - y


@register("id_if_thresh_met", 2, 4, raw_only=True)
def _gate(x: Column, previous: Column, threshold: Column | None = None, how: Column | None = None) -> Column:
    """x if the previous value is at or over (how `ge`, the default) or at or under (`le`) the threshold (180), else null."""
    limit = F.lit(180.0) if threshold is None else threshold.cast("double")
    return F.when(previous >= limit if how is None else F.when(how == "le", previous <= limit).otherwise(previous >= limit), x)
