"""Columns for rules, times and fuzzy scores. A frame of intervals has the columns of `FRAME`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from intervallum.functions.registry import call
from intervallum.plans.model import Bound, Compliance, Condition, Rule, Trapezoid

#: Columns of an interval frame. value: elements as text (a label is one element); ord: breaks ties of time.
FRAME = ("patient_id", "concept", "start", "end", "value", "kind", "ord")
FRAME_SCHEMA = "patient_id long, concept string, start timestamp_ntz, end timestamp_ntz, value array<string>, kind string, ord long"


def micros(c: Column | str) -> Column:
    """A timestamp_ntz as microseconds since 1970."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def instant(c: Column) -> Column:
    """Microseconds as timestamp_ntz (null for times out of range are not expected: 0001 to 9999)."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def plus(c: Column | str, seconds: float) -> Column:
    """A time moved by a constant."""
    return instant(micros(c) + F.lit(round(seconds * 1_000_000)))


def element(idx: int, value: str = "value") -> Column:
    """Element idx of the value, null beyond its end."""
    return F.get(F.col(value), F.lit(idx))


def number(c: Column) -> Column:
    """A text as a finite double, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals share at least one instant."""
    return (a_start <= b_end) & (b_start <= a_end)


def holds(allowed: Sequence[Bound], c: Column, upper_open: bool) -> Column:
    """Does `c` meet any of the allowed values? Null never does. upper_open: ranges are [min, max) (states), else [min, max]."""
    x = number(c)
    tests = []
    for b in allowed:
        if b.equal is not None:
            tests.append(c == F.lit(b.equal))
        else:
            test = x.isNotNull()
            if b.min is not None:
                test &= x >= F.lit(float(b.min))
            if b.max is not None:
                test &= x < F.lit(float(b.max)) if upper_open else x <= F.lit(float(b.max))
            tests.append(test)
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _joined(tests: list[Column], how: str) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t if how == "and" else out | t
    return out


def state_label(rules: Sequence[Rule]) -> Column:
    """Label of the first state rule that holds; without rules the first element itself."""
    if not rules:
        return element(0)
    out = None
    for r in rules:
        test = _joined([holds(c.allowed, element(c.idx), True) for c in r.conditions], r.operator)
        out = F.when(test, r.value) if out is None else out.when(test, r.value)
    return out


def source_test(c: Condition, sources: dict[str, tuple[str, int]]) -> Column:
    """Is the row one of the source `c.ref` with an allowed value?"""
    name, idx = sources[c.ref]
    return (F.col("concept") == name) & holds(c.allowed, element(idx), False)


def event_label(rules: Sequence[Rule], sources: dict[str, tuple[str, int]]) -> Column:
    """Label of the first event-style rule that holds for the row."""
    out = None
    for r in rules:
        test = _joined([source_test(c, sources) for c in r.conditions], r.operator)
        out = F.when(test, r.value) if out is None else out.when(test, r.value)
    return out


def candidate(conditions: Sequence[Condition], sources: dict[str, tuple[str, int]]) -> Column:
    """Is the row a candidate for any of the conditions?"""
    return _joined([source_test(c, sources) for c in conditions], "or") if conditions else F.lit(False)


def trapezoid_score(t: Trapezoid, x: Column, missing: Column | float | None = None) -> Column:
    """Fuzzy score of x: missing_score outside [a, d], 1 on [b, c], linear between. Null for null."""
    return trapezoid_columns(x, F.lit(t.a), F.lit(t.b), F.lit(t.c), F.lit(t.d), F.lit(t.missing_score) if missing is None else missing)


def trapezoid_columns(x: Column, a: Column, b: Column, c: Column, d: Column, missing: Column | float) -> Column:
    missing = F.lit(missing) if not isinstance(missing, Column) else missing
    score = F.when((x < a) | (x > d), missing).when((x >= b) & (x <= c), F.lit(1.0)).when(x < b, F.try_divide(x - a, b - a)).otherwise(F.try_divide(d - x, d - c))
    return F.when(x.isNotNull(), score.cast("double"))


def compliance_score(c: Compliance, x: Column, parameters: dict[str, Column]) -> Column:
    """Score of x against a trapezoid whose corners went through the function; 0 if they lose their order or are null."""
    t = c.trapezoid
    if c.function == "id" and not c.parameters:
        return trapezoid_score(t, x)
    args = [parameters[p] for p in c.parameters]
    a, b, cc, d = (call(c.function, F.lit(float(v)), *args, trapezoid=True) for v in (t.a, t.b, t.c, t.d))
    ordered = F.coalesce((a <= b) & (b <= cc) & (cc <= d), F.lit(False))
    # what a value outside scores is decided again from the moved corners
    missing = F.when((a < b) & (cc == d), 1.0).otherwise(0.0) if t.time else F.when((a == b) & (cc < d), 1.0).otherwise(0.0)
    return F.when(x.isNotNull(), F.when(ordered, trapezoid_columns(x, a, b, cc, d, missing)).otherwise(0.0))


def combined_score(*scores: Column) -> Column:
    """Mean of the scores that are not null; 1 if none is."""
    known = F.filter(F.array(*[s.cast("double") for s in scores]), lambda s: s.isNotNull())
    return F.when(F.size(known) == 0, 1.0).otherwise(F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known))


def fulfilment(score: Column) -> Column:
    """True for a full score, Partial for some, else False."""
    return F.when(score >= 1.0, "True").when(score > 0, "Partial").otherwise("False")
