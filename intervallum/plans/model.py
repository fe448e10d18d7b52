"""Definitions of a knowledge base as frozen dataclasses. They live on the driver and are never data."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Order of the families when definitions are loaded, and for ties in the order of execution.
FAMILIES = ("raw-concept", "parameterized-raw-concept", "event", "state", "trend", "context", "local-pattern", "global-pattern")


@dataclass(frozen=True)
class Bound:
    """One allowed value: equal to a text, or between min and max (each optional)."""

    equal: str | None = None
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Attribute:
    """An attribute of a raw concept. kind: numeric, nominal or boolean."""

    name: str
    kind: str
    bound: Bound = Bound()
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    """A definition that another one is derived from: its name, family, element of its value, and the name used in rules."""

    name: str
    tak: str
    idx: int = 0
    ref: str = ""


@dataclass(frozen=True)
class Condition:
    """Allowed values of one source (by ref) or of one element (by idx)."""

    ref: str
    allowed: tuple[Bound, ...]
    idx: int = 0


@dataclass(frozen=True)
class Rule:
    """A label and the conditions under which it holds."""

    value: str
    conditions: tuple[Condition, ...]
    operator: str = "or"


@dataclass(frozen=True)
class Trapezoid:
    """Score 0 outside [a, d], rising on [a, b], 1 on [b, c], falling on [c, d]. Times are in seconds."""

    a: float
    b: float
    c: float
    d: float
    time: bool = False

    def __post_init__(self) -> None:
        if not self.a <= self.b <= self.c <= self.d:
            raise ValueError(f"trapezoid is not ordered: {self.a}, {self.b}, {self.c}, {self.d}")

    @property
    def missing_score(self) -> float:
        """What a value outside the trapezoid scores: 1 where the trapezoid is open on that side by definition."""
        if not self.time and self.a == self.b and self.c < self.d:
            return 1.0
        if self.time and self.a < self.b and self.c == self.d:
            return 1.0
        return 0.0


@dataclass(frozen=True)
class Parameter:
    """A value looked up in another stream."""

    name: str
    tak: str
    ref: str
    idx: int = 0
    default: str | None = None
    how: str = "all"
    dynamic: bool = False
    good_before: float | None = None
    good_after: float | None = None


@dataclass(frozen=True)
class Call:
    """A function applied to an element of the value, with parameters and literals."""

    function: str
    idx: int = 0
    parameters: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()


@dataclass(frozen=True)
class Compliance:
    """A trapezoid, its transforming function and, for values, the targets (refs)."""

    trapezoid: Trapezoid
    function: str = "id"
    parameters: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class Window:
    before: float
    after: float


@dataclass(frozen=True)
class Clipper:
    name: str
    tak: str
    before: float | None = None
    after: float | None = None


@dataclass(frozen=True)
class Definition:
    """What all families share."""

    name: str
    categories: str = ""
    description: str = ""

    @property
    def family(self) -> str:
        raise NotImplementedError

    def sources(self) -> tuple[Source, ...]:
        return ()

    def needs(self) -> tuple[str, ...]:
        """Names of the definitions that must be computed before this one."""
        return tuple(dict.fromkeys(s.name for s in self.sources()))


@dataclass(frozen=True)
class RawConcept(Definition):
    concept_type: str = "raw-numeric"
    attributes: tuple[Attribute, ...] = ()
    order: tuple[str, ...] = ()
    require_all: bool = False
    family = "raw-concept"


@dataclass(frozen=True)
class ParameterizedConcept(Definition):
    parent: Source = Source("", "raw-concept")
    parameters: tuple[Parameter, ...] = ()
    calls: tuple[Call, ...] = ()
    family = "parameterized-raw-concept"

    def sources(self) -> tuple[Source, ...]:
        return (self.parent, *(Source(p.name, p.tak, p.idx, p.ref) for p in self.parameters))


@dataclass(frozen=True)
class Event(Definition):
    derived: tuple[Source, ...] = ()
    rules: tuple[Rule, ...] = ()
    family = "event"

    def sources(self) -> tuple[Source, ...]:
        return self.derived


@dataclass(frozen=True)
class State(Definition):
    parent: Source = Source("", "raw-concept")
    good_after: float = 0.0
    interpolate: bool = False
    max_skip: int = 0
    rules: tuple[Rule, ...] = ()
    family = "state"

    def sources(self) -> tuple[Source, ...]:
        return (self.parent,)


@dataclass(frozen=True)
class Trend(Definition):
    parent: Source = Source("", "raw-concept")
    significant: float = 0.0
    time_steady: float = 0.0
    good_after: float = 0.0
    family = "trend"

    def sources(self) -> tuple[Source, ...]:
        return (self.parent,)


@dataclass(frozen=True)
class Context(Definition):
    derived: tuple[Source, ...] = ()
    clippers: tuple[Clipper, ...] = ()
    rules: tuple[Rule, ...] = ()
    windows: dict[str | None, Window] = field(default_factory=dict)
    family = "context"

    def sources(self) -> tuple[Source, ...]:
        return (*self.derived, *(Source(c.name, c.tak) for c in self.clippers))


@dataclass(frozen=True)
class Gate:
    """Contexts that an anchor or a window must lie in; how: and / or."""

    conditions: tuple[Condition, ...]
    how: str = "or"


@dataclass(frozen=True)
class LocalRule:
    how: str
    anchor: tuple[Condition, ...]
    event: tuple[Condition, ...]
    anchor_select: str | None = None
    event_select: str | None = None
    min_distance: float = 0.0
    max_distance: float | None = None
    existence: bool = False
    gate: Gate | None = None
    time: Compliance | None = None
    value: Compliance | None = None


@dataclass(frozen=True)
class CyclicRule:
    start: float
    end: float
    window: float
    least: int
    most: int
    event: tuple[Condition, ...]
    initiator: tuple[Condition, ...] = ()
    clipper: tuple[Condition, ...] = ()
    gate: Gate | None = None
    cyclic: Compliance | None = None
    value: Compliance | None = None


@dataclass(frozen=True)
class Pattern(Definition):
    derived: tuple[Source, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    ignore_unfulfilled: bool = False

    def sources(self) -> tuple[Source, ...]:
        return (*self.derived, *(Source(p.name, p.tak, p.idx, p.ref) for p in self.parameters))

    def source(self, ref: str) -> Source:
        return next(s for s in self.derived if s.ref == ref)


@dataclass(frozen=True)
class LocalPattern(Pattern):
    rules: tuple[LocalRule, ...] = ()
    family = "local-pattern"


@dataclass(frozen=True)
class GlobalPattern(Pattern):
    rules: tuple[CyclicRule, ...] = ()
    family = "global-pattern"


@dataclass(frozen=True)
class GlobalClipper:
    """START clippers bound a patient's intervals from below, END clippers from above."""

    name: str
    how: str
