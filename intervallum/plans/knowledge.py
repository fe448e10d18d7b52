"""Reading, checking and ordering definitions: XML or JSON on one side, a validated dependency graph on the other."""

from __future__ import annotations

import dataclasses
import json
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from intervallum.functions.registry import FUNCTIONS, parse_duration
from intervallum.plans import model as M

#: Child elements of each root in their order; those in brackets may be missing.
CHILDREN = {
    "raw-concept": ("categories", "description", "attributes", "[tuple-order]", "[merge]"),
    "parameterized-raw-concept": ("categories", "description", "derived-from", "[parameters]", "functions"),
    "event": ("categories", "description", "derived-from", "abstraction-rules"),
    "state": ("categories", "description", "derived-from", "persistence", "[abstraction-rules]"),
    "trend": ("categories", "description", "derived-from", "time-steady", "persistence"),
    "context": ("categories", "description", "derived-from", "[clippers]", "abstraction-rules", "context-windows"),
    "pattern": ("categories", "description", "derived-from", "[parameters]", "abstraction-rules"),
}


class DefinitionError(ValueError):
    """A definition that breaks the grammar or a rule of its family."""


def _need(e: ET.Element, name: str) -> str:
    if e.get(name) is None:
        raise DefinitionError(f"<{e.tag}> needs the attribute {name}")
    return e.get(name)


def _float(text: str | None) -> float | None:
    return None if text is None else float(text)


def _truth(text: str | None) -> bool:
    return (text or "").strip().lower() in ("true", "1")


def check_structure(root: ET.Element) -> None:
    """Root, name, children and their order."""
    if root.tag not in CHILDREN:
        raise DefinitionError(f"unknown definition <{root.tag}>")
    _need(root, "name")
    expected = list(CHILDREN[root.tag])
    for child in root:
        while expected and expected[0].strip("[]") != child.tag:
            if not expected[0].startswith("["):
                raise DefinitionError(f"{root.get('name')}: <{child.tag}> where <{expected[0]}> belongs")
            expected.pop(0)
        if not expected:
            raise DefinitionError(f"{root.get('name')}: <{child.tag}> is not expected")
        expected.pop(0)
    if missing := [x for x in expected if not x.startswith("[")]:
        raise DefinitionError(f"{root.get('name')}: <{missing[0]}> is missing")


def _sources(e: ET.Element | None) -> tuple[M.Source, ...]:
    out = []
    for k, a in enumerate(e if e is not None else ()):
        out.append(M.Source(_need(a, "name"), _need(a, "tak"), int(a.get("idx") or 0), a.get("ref") or f"_{k}"))
    return tuple(out)


def _allowed(e: ET.Element) -> tuple[M.Bound, ...]:
    return tuple(M.Bound(v.get("equal"), _float(v.get("min")), _float(v.get("max"))) for v in e.findall("allowed-value"))


def _conditions(e: ET.Element | None, by: str = "ref") -> tuple[M.Condition, ...]:
    if e is None:
        return ()
    return tuple(M.Condition(a.get("ref") or "", _allowed(a), int(a.get("idx") or 0)) for a in e.findall("attribute") if a.get(by) is not None or by != "ref")


def _rules(e: ET.Element | None, by: str = "ref") -> tuple[M.Rule, ...]:
    # the operator is `or` where it is not written, for all families
    return tuple(M.Rule(_need(r, "value"), _conditions(r, by), r.get("operator") or "or") for r in (e.findall("rule") if e is not None else ()))


def _span(e: ET.Element, name: str, default: str | None = None) -> float | None:
    text = e.get(name, default)
    return None if text is None else parse_duration(text)


def _parameters(e: ET.Element | None) -> tuple[M.Parameter, ...]:
    return tuple(
        M.Parameter(
            _need(p, "name"), _need(p, "tak"), _need(p, "ref"), int(p.get("idx") or 0), p.get("default"), p.get("how") or "all", _truth(p.get("dynamic")), _span(p, "good-before"), _span(p, "good-after")
        )
        for p in (e if e is not None else ())
    )


def _compliance(e: ET.Element | None, time: bool) -> M.Compliance | None:
    if e is None:
        return None
    f = e.find("function")
    if f is None or f.find("trapez") is None:
        raise DefinitionError(f"<{e.tag}> needs a function with a trapez")
    t = f.find("trapez")
    corners = [parse_duration(_need(t, f"trapez{k}")) if time else float(_need(t, f"trapez{k}")) for k in "ABCD"]
    # parameters stand in the function, alone or wrapped
    refs = tuple(_need(p, "ref") for p in [*f.findall("parameter"), *f.findall("parameters/parameter")])
    targets = tuple(_need(a, "ref") for a in e.findall("target/attribute"))
    return M.Compliance(M.Trapezoid(*corners, time=time), _need(f, "name"), refs, targets)


def _gate(e: ET.Element | None) -> M.Gate | None:
    if e is None:
        return None
    conditions = _conditions(e)
    if len(conditions) > 1 and e.get("how") is None:
        raise DefinitionError("a context of several attributes needs how")
    return M.Gate(conditions, e.get("how") or "or")


def parse(text: str) -> M.Definition:
    """One definition from XML, checked by itself (not against others)."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise DefinitionError(f"not well-formed: {e}") from e
    check_structure(root)
    about = {"name": root.get("name"), "categories": (root.findtext("categories") or "").strip(), "description": (root.findtext("description") or "").strip()}
    d = _PARSERS[root.tag](root, about)
    check_alone(d)
    return d


def _raw(root: ET.Element, about: dict) -> M.RawConcept:
    attributes = []
    for a in root.find("attributes"):
        bound = a.find("numeric-allowed-values/allowed-value")
        values = tuple(_need(v, "value") for v in a.findall("nominal-allowed-values/allowed-value"))
        attributes.append(M.Attribute(_need(a, "name"), _need(a, "type"), M.Bound(None, _float(bound.get("min")), _float(bound.get("max"))) if bound is not None else M.Bound(), values))
    order = tuple(_need(a, "name") for a in (root.find("tuple-order") if root.find("tuple-order") is not None else ()))
    merge = root.find("merge")
    return M.RawConcept(**about, concept_type=_need(root, "concept-type"), attributes=tuple(attributes), order=order, require_all=merge is not None and _truth(_need(merge, "require-all")))


def _parameterized(root: ET.Element, about: dict) -> M.ParameterizedConcept:
    p = root.find("derived-from")
    calls = []
    for f in root.find("functions"):
        value = f.find("value")
        calls.append(M.Call(_need(f, "name"), int(_need(value, "idx")) if value is not None else 0, tuple(_need(x, "ref") for x in f.findall("parameter")), tuple(_need(x, "value") for x in f.findall("literal"))))
    return M.ParameterizedConcept(**about, parent=M.Source(_need(p, "name"), _need(p, "tak"), int(p.get("idx") or 0)), parameters=_parameters(root.find("parameters")), calls=tuple(calls))


def _event(root: ET.Element, about: dict) -> M.Event:
    return M.Event(**about, derived=_sources(root.find("derived-from")), rules=_rules(root.find("abstraction-rules")))


def _state(root: ET.Element, about: dict) -> M.State:
    p, keep = root.find("derived-from"), root.find("persistence")
    return M.State(
        **about,
        parent=M.Source(_need(p, "name"), _need(p, "tak"), int(p.get("idx") or 0)),
        good_after=parse_duration(_need(keep, "good-after")),
        interpolate=_truth(keep.get("interpolate")),
        max_skip=int(keep.get("max-skip") or 0),
        rules=_rules(root.find("abstraction-rules"), "idx"),
    )


def _trend(root: ET.Element, about: dict) -> M.Trend:
    p = root.find("derived-from")
    return M.Trend(
        **about,
        parent=M.Source(_need(p, "name"), p.get("tak") or "raw-concept", int(p.get("idx") or 0)),
        significant=float(_need(p, "significant-variation")),
        time_steady=parse_duration(_need(root.find("time-steady"), "value")),
        good_after=parse_duration(_need(root.find("persistence"), "good-after")),
    )


def _context(root: ET.Element, about: dict) -> M.Context:
    clippers = tuple(M.Clipper(_need(c, "name"), _need(c, "tak"), _span(c, "clip-before"), _span(c, "clip-after")) for c in (root.find("clippers") if root.find("clippers") is not None else ()))
    windows = {w.get("value"): M.Window(_span(w, "good-before", "0h"), _span(w, "good-after", "0h")) for w in root.find("context-windows")}
    return M.Context(**about, derived=_sources(root.find("derived-from")), clippers=clippers, rules=_rules(root.find("abstraction-rules")), windows=windows)


def _pattern(root: ET.Element, about: dict) -> M.Pattern:
    kind = _need(root, "concept-type")
    common = about | {"derived": _sources(root.find("derived-from")), "parameters": _parameters(root.find("parameters")), "ignore_unfulfilled": _truth(root.get("ignore-unfulfilled-anchors"))}
    rules = []
    for r in root.find("abstraction-rules"):
        fit = r.find("compliance-function")
        find = lambda tag, fit=fit: None if fit is None else fit.find(tag)
        value = _compliance(find("value-constraint-compliance"), False)
        gate = _gate(r.find("context"))
        if kind == "local-pattern":
            t = r.find("temporal-relation")
            if t is None or find("cyclic-constraint-compliance") is not None:
                raise DefinitionError(f"{about['name']}: a local pattern has temporal relations only")
            anchor, event = t.find("anchor"), t.find("event")
            rules.append(
                M.LocalRule(
                    _need(t, "how"), _conditions(anchor), _conditions(event), anchor.get("select"), event.get("select"), _span(t, "min-distance") or 0.0, _span(t, "max-distance"),
                    _truth(t.get("existence-compliance")), gate, _compliance(find("time-constraint-compliance"), True), value,
                )
            )
            if t.get("how") == "overlap" and (t.get("min-distance") or t.get("max-distance")):
                raise DefinitionError(f"{about['name']}: overlap has no distances")
        else:
            c = r.find("cyclic")
            if c is None or find("time-constraint-compliance") is not None:
                raise DefinitionError(f"{about['name']}: a global pattern has cyclic rules only")
            many = lambda tag, c=c: tuple(x for e in c.findall(tag) for x in _conditions(e))
            rules.append(
                M.CyclicRule(
                    parse_duration(_need(c, "start")), parse_duration(_need(c, "end")), parse_duration(_need(c, "time-window")), int(_need(c, "min-occurrences")), int(_need(c, "max-occurrences")),
                    many("event"), many("initiator"), many("clipper"), gate, _compliance(find("cyclic-constraint-compliance"), False), value,
                )
            )
    return (M.LocalPattern if kind == "local-pattern" else M.GlobalPattern)(**common, rules=tuple(rules))


_PARSERS = {"raw-concept": _raw, "parameterized-raw-concept": _parameterized, "event": _event, "state": _state, "trend": _trend, "context": _context, "pattern": _pattern}


# --- checks ----------------------------------------------------------------------------------------------------------


def _fail(d: M.Definition, why: str) -> None:
    raise DefinitionError(f"{d.name}: {why}")


def check_alone(d: M.Definition) -> None:
    """Rules that need no other definition."""
    if isinstance(d, M.RawConcept):
        names = [a.name for a in d.attributes]
        if len(set(names)) < len(names):
            _fail(d, "attributes repeat")
        for a in d.attributes:
            if a.kind not in ("numeric", "nominal", "boolean"):
                _fail(d, f"unknown attribute type {a.kind}")
            if a.kind == "nominal" and len(set(a.values)) < len(a.values):
                _fail(d, "nominal values repeat")
            if a.kind == "numeric":
                if a.bound.min is None and a.bound.max is None:
                    _fail(d, f"numeric attribute {a.name} needs a bound")
                if None not in (a.bound.min, a.bound.max) and a.bound.min >= a.bound.max:
                    _fail(d, f"bounds of {a.name} are reversed")
        if d.concept_type == "raw":
            if len(names) < 2 or set(d.order) != set(names) or len(d.order) != len(names):
                _fail(d, "a tuple needs two or more attributes and an order of just these")
        elif d.concept_type not in ("raw-numeric", "raw-nominal", "raw-boolean") or {a.kind for a in d.attributes} != {d.concept_type[4:]}:
            _fail(d, "attributes must all have the concept's type")
    if isinstance(d, M.ParameterizedConcept):
        if not d.calls:
            _fail(d, "functions are needed")
        for p in d.parameters:
            if p.how not in ("all", "before"):
                _fail(d, f"unknown how {p.how}")
            if p.name == d.parent.name and p.how == "all":
                _fail(d, "a parameter from the parent itself would see the future: how must be before")
            if (p.good_before is not None or p.good_after is not None) and not p.dynamic:
                _fail(d, "good-before and good-after need a dynamic parameter")
            if p.good_after is not None and p.how == "before":
                _fail(d, "good-after does not go with how=before")
        refs = {p.ref for p in d.parameters}
        for c in d.calls:
            if c.function not in FUNCTIONS:
                _fail(d, f"unknown function {c.function}")
            if not set(c.parameters) <= refs:
                _fail(d, "a function names an unknown parameter")
    if isinstance(d, (M.Event, M.Context)) and not d.rules:
        _fail(d, "rules are needed")
    if isinstance(d, M.Event) or isinstance(d, M.Context):
        refs = {s.ref: s.name for s in d.derived}
        for r in d.rules:
            if r.operator not in ("and", "or") or not r.conditions:
                _fail(d, f"rule {r.value} needs an operator and conditions")
            if any(c.ref not in refs for c in r.conditions):
                _fail(d, f"rule {r.value} names an unknown ref")
            if r.operator == "and" and len({refs[c.ref] for c in r.conditions}) > 1:
                _fail(d, f"rule {r.value}: `and` works within one source only")
    if isinstance(d, M.State):
        if d.good_after <= 0:
            _fail(d, "good-after must be positive")
        for r in d.rules:
            for c in r.conditions:
                ranges = sorted((b.min if b.min is not None else float("-inf"), b.max if b.max is not None else float("inf")) for b in c.allowed if b.equal is None)
                for b in c.allowed:
                    if b.equal is None and b.min is None and b.max is None:
                        _fail(d, f"rule {r.value}: a range without bounds")
                for low, high in ranges:
                    if low >= high:
                        _fail(d, f"rule {r.value}: a range is reversed")
                for (_, high), (low, _) in zip(ranges, ranges[1:]):
                    if low < high:
                        _fail(d, f"rule {r.value}: ranges overlap")
                    if low > high:
                        warnings.warn(f"{d.name}, rule {r.value}: gap between ranges", stacklevel=2)
    if isinstance(d, M.Trend):
        if d.parent.tak not in ("raw-concept", "parameterized-raw-concept"):
            _fail(d, "a trend derives from a raw concept")
        if d.good_after <= 0 or d.time_steady <= 0:
            _fail(d, "good-after and time-steady must be positive")
    if isinstance(d, M.Context):
        for c in d.clippers:
            if c.before is None and c.after is None:
                _fail(d, f"clipper {c.name} needs clip-before or clip-after")
        values = {r.value for r in d.rules}
        named = {v for v in d.windows if v is not None}
        if named - values:
            _fail(d, f"windows for unknown values: {sorted(named - values)}")
        if None not in d.windows and values - named:
            _fail(d, f"no window for values: {sorted(values - named)}")
    if isinstance(d, M.Pattern):
        refs = {s.ref for s in d.derived}
        known = {p.ref for p in d.parameters}
        for p in d.parameters:
            if p.default is None:
                _fail(d, f"parameter {p.ref} needs a default")
        for r in d.rules:
            used = [*r.event, *(r.gate.conditions if r.gate else ()), *(r.anchor if isinstance(r, M.LocalRule) else (*r.initiator, *r.clipper))]
            if any(c.ref not in refs for c in used):
                _fail(d, "a rule names an unknown ref")
            if not r.event:
                _fail(d, "a rule needs event attributes")
            for fit in (r.value, getattr(r, "time", None), getattr(r, "cyclic", None)):
                if fit is None:
                    continue
                if fit.function not in FUNCTIONS or FUNCTIONS[fit.function].raw_only:
                    _fail(d, f"function {fit.function} can't be used for compliance")
                if not set(fit.parameters) <= known:
                    _fail(d, "compliance names an unknown parameter")
            if r.value is not None:
                allowed = {c.ref for c in (*r.event, *(r.anchor if isinstance(r, M.LocalRule) else ()))}
                if not r.value.targets or not set(r.value.targets) <= allowed:
                    _fail(d, "targets of value compliance must be attributes of the rule's anchor or event")
            if isinstance(r, M.LocalRule):
                if not r.anchor:
                    _fail(d, "a rule needs anchor attributes")
                if r.how == "before":
                    if not r.max_distance or r.max_distance <= 0:
                        _fail(d, "before needs a positive max-distance")
                    if r.min_distance > r.max_distance:
                        _fail(d, "min-distance exceeds max-distance")
                    if r.time and (r.time.trapezoid.d > r.max_distance or r.time.trapezoid.a < r.min_distance):
                        _fail(d, "the time trapezoid leaves the distances")
                elif r.how == "overlap":
                    if not r.existence:
                        _fail(d, "overlap needs existence-compliance")
                    if r.time:
                        _fail(d, "time compliance needs before")
                else:
                    _fail(d, f"unknown relation {r.how}")
                if r.existence and d.ignore_unfulfilled:
                    _fail(d, "existence compliance does not go with ignore-unfulfilled-anchors")
            else:
                if d.ignore_unfulfilled:
                    _fail(d, "ignore-unfulfilled-anchors is for local patterns")
                if r.window <= 0 or r.end <= r.start or r.least > r.most:
                    _fail(d, "windows or occurrences are reversed")


_PARENTS = {
    "parameterized-raw-concept": {"raw-concept"},
    "event": {"raw-concept", "parameterized-raw-concept", "event"},
    "state": {"raw-concept", "parameterized-raw-concept", "event"},
    "trend": {"raw-concept", "parameterized-raw-concept"},
    "context": {"raw-concept", "parameterized-raw-concept", "event", "state", "trend", "context"},
}


class KnowledgeBase:
    """Definitions by name, in dependency order."""

    def __init__(self, definitions: Iterable[M.Definition] = (), clippers: Iterable[M.GlobalClipper] = ()):
        self.by_name: dict[str, M.Definition] = {}
        self.clippers = tuple(clippers)
        for d in definitions:
            self.register(d)

    def register(self, d: M.Definition) -> None:
        if d.name in self.by_name:
            raise DefinitionError(f"{d.name} is defined twice")
        self.by_name[d.name] = d

    def get(self, name: str) -> M.Definition | None:
        return self.by_name.get(name)

    def graph(self) -> dict[str, set[str]]:
        """Each definition and the other ones it needs. A parameter with a default may be undefined."""
        out = {}
        for d in self.by_name.values():
            optional = {p.name for p in getattr(d, "parameters", ()) if p.default is not None}
            out[d.name] = {n for n in d.needs() if n != d.name and (n in self.by_name or n not in optional)}
        return out

    def order(self) -> list[str]:
        """Topological order; among those ready by family, then name. Missing references and cycles are errors."""
        graph = self.graph()
        for name, needs in graph.items():
            if missing := sorted(n for n in needs if n not in self.by_name):
                raise DefinitionError(f"{name} needs {missing[0]}, which is not defined")
        rank = {f: i for i, f in enumerate(M.FAMILIES)}
        left = {n: set(x) for n, x in graph.items()}
        out: list[str] = []
        while left:
            ready = sorted((n for n, x in left.items() if not x), key=lambda n: (rank[self.by_name[n].family], n))
            if not ready:
                raise DefinitionError(f"definitions need each other: {sorted(left)}")
            out.append(ready[0])
            left.pop(ready[0])
            for x in left.values():
                x.discard(ready[0])
        return out

    def closure(self, names: Iterable[str]) -> set[str]:
        """`names` and all they need."""
        graph, out, todo = self.graph(), set(), list(names)
        while todo:
            n = todo.pop()
            if n not in self.by_name:
                raise DefinitionError(f"{n} is not defined")
            if n not in out:
                out.add(n)
                todo += graph[n]
        return out

    def dependants(self, names: Iterable[str]) -> set[str]:
        """`names` and all that need them, directly or not: what is stale after a change."""
        graph, out = self.graph(), set(names)
        while more := {n for n, needs in graph.items() if needs & out} - out:
            out |= more
        return out

    def unused(self) -> list[str]:
        """Raw concepts and contexts that nothing refers to."""
        used = {n for x in self.graph().values() for n in x}
        return sorted(n for n, d in self.by_name.items() if d.family in ("raw-concept", "parameterized-raw-concept", "context") and n not in used)

    def check(self) -> KnowledgeBase:
        """Rules between definitions; returns itself."""
        self.order()
        for d in self.by_name.values():
            check_alone(d)
            if isinstance(d, M.ParameterizedConcept) and d.parent.name == d.name:
                _fail(d, "derives from itself")
            for s in d.sources():
                parent = self.get(s.name)
                if parent is None:
                    continue
                raw = ("raw-concept", "parameterized-raw-concept")
                if s.tak and s.tak != parent.family and not (s.tak in raw and parent.family in raw) and not (s.tak == "pattern" and isinstance(parent, M.Pattern)):
                    _fail(d, f"{s.name} is a {parent.family}, not a {s.tak}")
                if isinstance(parent, M.RawConcept) and s.idx >= max(1, len(parent.order)):
                    _fail(d, f"{s.name} has no element {s.idx}")
            if d.family in _PARENTS:
                for s in [d.parent] if hasattr(d, "parent") else d.derived:
                    if self.by_name[s.name].family not in _PARENTS[d.family]:
                        _fail(d, f"can't derive from {s.name}")
            if isinstance(d, M.Trend):
                a = self.attribute(d.parent.name, d.parent.idx)
                if a is not None and a.kind != "numeric":
                    _fail(d, "a trend needs a numeric attribute")
            if isinstance(d, M.State):
                for r in d.rules:
                    for c in r.conditions:
                        self._check_values(d, d.parent.name, c.idx, c.allowed)
            if isinstance(d, (M.Event, M.Context)):
                refs = {s.ref: s for s in d.derived}
                for r in d.rules:
                    for c in r.conditions:
                        self._check_values(d, refs[c.ref].name, refs[c.ref].idx, c.allowed)
            if isinstance(d, M.Pattern):
                for r in d.rules:
                    for c in (*r.event, *(r.anchor if isinstance(r, M.LocalRule) else (*r.initiator, *r.clipper))):
                        self._check_values(d, d.source(c.ref).name, d.source(c.ref).idx, c.allowed)
        return self

    def attribute(self, name: str, idx: int) -> M.Attribute | None:
        """The raw attribute behind element idx of a concept; None where it can't be told."""
        d = self.get(name)
        while isinstance(d, M.ParameterizedConcept):
            d = self.get(d.parent.name)
        if not isinstance(d, M.RawConcept):
            return None
        if not d.order:
            return d.attributes[0] if d.attributes else None
        return next((a for a in d.attributes if idx < len(d.order) and a.name == d.order[idx]), None)

    def _check_values(self, d: M.Definition, name: str, idx: int, allowed: tuple[M.Bound, ...]) -> None:
        parent = self.get(name)
        a = self.attribute(name, idx)
        labels = {r.value for r in getattr(parent, "rules", ())} if isinstance(parent, (M.Event, M.State, M.Context)) else set()
        for b in allowed:
            if b.min is not None and b.max is not None and b.min >= b.max:
                _fail(d, f"a range of {name} is reversed")
            if a is not None and isinstance(parent, M.RawConcept):
                if a.kind == "numeric" and b.equal is not None:
                    _fail(d, f"{name} is numeric: use min and max")
                if a.kind == "nominal" and b.equal is None:
                    _fail(d, f"{name} is nominal: use equal")
                if a.kind == "nominal" and a.values and b.equal not in a.values:
                    _fail(d, f"{name} can't be {b.equal}")
                if a.kind == "boolean" and b.equal not in (("True", "False") if isinstance(d, (M.Context, M.Pattern)) else ("True",)):
                    _fail(d, f"{name} is boolean: equal must be True")
            if labels and b.equal is not None and b.equal not in labels:
                _fail(d, f"{name} is never {b.equal}")

    # --- reading and writing

    @classmethod
    def read(cls, folder: str | Path) -> KnowledgeBase:
        """All XML files under a folder, family by family, and global_clippers.json."""
        folder = Path(folder)
        found = [parse(p.read_text(encoding="utf-8")) for p in sorted(folder.rglob("*.xml"))]
        found.sort(key=lambda d: (M.FAMILIES.index(d.family), d.name))
        at = folder / "global_clippers.json"
        return cls(found, read_clippers(at.read_text(encoding="utf-8")) if at.exists() else ()).check()

    def to_json(self) -> str:
        """A portable text from which `from_json` makes an equal knowledge base."""
        return json.dumps({"definitions": [_plain(self.by_name[n]) for n in self.order()], "clippers": [_plain(c) for c in self.clippers]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> KnowledgeBase:
        data = json.loads(text)
        return cls([_build(x) for x in data["definitions"]], [_build(x) for x in data["clippers"]]).check()

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One row per definition: name, family, categories, description, what it needs, and all settings as JSON."""
        rows = [(d.name, d.family, d.categories, d.description, sorted(self.graph()[d.name]), json.dumps(_plain(d))) for d in (self.by_name[n] for n in self.order())]
        return spark.createDataFrame(rows, "name string, family string, categories string, description string, needs array<string>, settings string")


def read_clippers(text: str) -> tuple[M.GlobalClipper, ...]:
    out = tuple(M.GlobalClipper(c["name"], c["how"]) for c in json.loads(text)["global_clippers"])
    if any(c.how not in ("START", "END") for c in out):
        raise DefinitionError("a global clipper is START or END")
    return out


def _plain(x):
    if dataclasses.is_dataclass(x):
        return {"is": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {"pairs": [[k, _plain(v)] for k, v in x.items()]}
    return [_plain(v) for v in x] if isinstance(x, (tuple, list)) else x


def _build(x):
    if isinstance(x, dict):
        if "pairs" in x:
            return {k: _build(v) for k, v in x["pairs"]}
        return getattr(M, x["is"])(**{k: _build(v) for k, v in x.items() if k != "is"})
    return tuple(_build(v) for v in x) if isinstance(x, list) else x
