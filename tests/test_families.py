"""Hand-computed cases; times are hours from day 0."""

import datetime as dt

from intervallum.operators import families
from intervallum.plans import model as M

T0 = dt.datetime(2024, 1, 1)
H = 3600.0
FRAME = "patient_id long, concept string, start timestamp_ntz, end timestamp_ntz, value array<string>, kind string, ord long"


def at(h):
    return T0 + dt.timedelta(hours=h)


def rows(spark, concept, items, patient=1):
    """items: (start, value) or (start, end, value), in hours."""
    out = []
    for i, it in enumerate(items):
        s, e, v = it if len(it) == 3 else (it[0], it[0] + 1 / 3600, it[1])
        out.append((patient, concept, at(s), at(e), [None if x is None else str(x) for x in (v if isinstance(v, (list, tuple)) else [v])], "raw-concept", i))
    return spark.createDataFrame(out, FRAME)


def spans(df):
    return sorted(((r.start - T0).total_seconds() / 3600, (r.end - T0).total_seconds() / 3600, r.value[0]) for r in df.collect())


def rule(value, low=None, high=None, idx=0):
    return M.Rule(value, (M.Condition("", (M.Bound(None, low, high),), idx),), "and")


def state(spark, items, **kw):
    d = M.State("S", parent=M.Source("G", "raw-concept"), good_after=24 * H, rules=kw.pop("rules", (rule("Low", None, 70), rule("High", 70))), **kw)
    return spans(families.state(d, rows(spark, "G", items)))


def test_state(spark):
    assert state(spark, [(0, 50), (6, 50), (12, 50)]) == [(0, 36, "Low")]
    assert state(spark, [(0, 50), (26, 50)]) == [(0, 24, "Low"), (26, 50, "Low")]
    assert state(spark, [(0, 50), (4, 50), (8, 100), (12, 50)], interpolate=True, max_skip=1) == [(0, 36, "Low")]
    assert state(spark, [(0, 50), (4, 50), (8, 100), (12, 50)]) == [(0, 8, "Low"), (8, 12, "High"), (12, 36, "Low")]
    assert state(spark, [(0, 50), (23, 50), (25, 50)]) == [(0, 25, "Low"), (25, 49, "Low")]
    bands = (rule("a", None, 70), rule("b", 70, 140), rule("c", 140, 250), rule("d", 250))
    assert [x[:2] for x in state(spark, [(8, 50), (10, 80), (12, 150), (14, 300)], rules=bands)] == [(8, 10), (10, 12), (12, 14), (14, 38)]
    assert state(spark, [(0, 50), (1, "x"), (2, 50), (3, 70)]) == [(0, 3, "Low"), (3, 27, "High")]
    assert state(spark, []) == []


def test_state_tuple_and_pass_through(spark):
    d = M.State("S", parent=M.Source("D", "raw-concept"), good_after=24 * H, rules=(M.Rule("SC low", (M.Condition("", (M.Bound(None, 0, 20),), 0), M.Condition("", (M.Bound("SC"),), 1)), "and"),))
    assert spans(families.state(d, rows(spark, "D", [(0, (10, "SC")), (6, (10, "IV")), (8, (20, "SC")), (9, (19.9, "SC")), (10, (5,))]))) == [(0, 33, "SC low")]
    p = M.State("S", parent=M.Source("E", "event"), good_after=3 * H)
    assert spans(families.state(p, rows(spark, "E", [(0, "Hypo"), (2, "Hypo"), (4, "Hyper")]))) == [(0, 4, "Hypo"), (4, 7, "Hyper")]


def trend(spark, items):
    d = M.Trend("T", parent=M.Source("G", "raw-concept"), significant=40, time_steady=12 * H, good_after=24 * H)
    return spans(families.trend(d, rows(spark, "G", items)))


def test_trend(spark):
    assert trend(spark, [(0, 100), (2, 150), (4, 200), (6, 210), (31, 120), (36, 130)]) == [(0, 6, "Increasing"), (31, 36, "Steady")]
    assert trend(spark, [(0, 100), (2, 150), (4, 50), (5, 30), (26, 100), (31, 120), (36, 130)]) == [(0, 2, "Increasing"), (2, 5, "Decreasing"), (5, 26, "Steady"), (26, 31, "Increasing"), (31, 36, "Steady")]
    got = trend(spark, [(0, 100), (2, 100), (4, 150), (6, 200), (8, 210), (33, 120), (38, 130)])
    assert got[:2] == [(0, 2, "Steady"), (2, 8, "Increasing")] and got[2][0] == 33
    assert trend(spark, [(0, 100)]) == [] and trend(spark, []) == []


def context(spark, before, after, clippers=()):
    return M.Context("C", derived=(M.Source("G", "raw-concept", 0, "A"),), rules=(M.Rule("Low", (M.Condition("A", (M.Bound(None, None, 70),)),)),), windows={None: M.Window(before * H, after * H)}, clippers=clippers)


def test_context(spark):
    d = context(spark, 1, 2)
    assert spans(families.context(d, rows(spark, "G", [(8, 8, 60), (12, 12, 90)]))) == [(7, 10, "Low")]
    assert spans(families.context(d, rows(spark, "G", [(8, 8, 60), (9.5, 9.5, 50)]))) == [(7, 8.5, "Low"), (8.5, 11.5, "Low")]


def test_clippers(spark):
    ctx = rows(spark, "C", [(6, 9, "True")])
    cut = lambda items, b, a: spans(families.clip_by(ctx, rows(spark, "X", items), b, a))
    assert cut([(5, 6.5, "x"), (4, 7, "x")], 0, 0) == [(7, 9, "True")]
    assert cut([(5, 6.5, "x"), (8, 9, "x")], 0, 0) == [(6.5, 8, "True")]
    assert cut([(7, 7, "x")], H, None) == []  # the end is trimmed to 6, where it starts
    assert cut([(10, 11, "x")], None, 4 * H) == [(6, 9, "True")]
    assert cut([(5, 5.5, "x")], None, 4 * H) == []
    assert cut([(3, 3, "x")], None, 4 * H) == [(7, 9, "True")]
    assert cut([], 0, 0) == [(6, 9, "True")]


def records(spark, items):
    return spark.createDataFrame([(1, c, at(h), at(h), v, i) for i, (c, h, v) in enumerate(items)], "patient_id long, concept string, start timestamp_ntz, end timestamp_ntz, value string, ord long")


def test_raw_concepts(spark):
    d = M.RawConcept("G", concept_type="raw-numeric", attributes=(M.Attribute("g", "numeric", M.Bound(None, 0, 600)),))
    assert [x[2] for x in spans(families.raw_concept(d, records(spark, [("g", 0, "0"), ("g", 1, "600"), ("g", 2, "601"), ("g", 3, "x"), ("g", 4, None), ("h", 5, "1"), ("g", 6, "NaN")])))] == ["0.0", "600.0"]
    t = M.RawConcept("D", concept_type="raw", attributes=(M.Attribute("dose", "numeric", M.Bound(None, 0, 100)), M.Attribute("route", "nominal", values=("SC", "IV"))), order=("dose", "route"))
    data = records(spark, [("dose", 0, "5"), ("dose", 0, "7"), ("route", 0, "SC"), ("dose", 1, "9"), ("route", 2, "IV"), ("route", 3, "PO"), ("dose", 4, "500")])
    got = sorted((r.start, r.value) for r in families.raw_concept(t, data).collect())
    assert [v for _, v in got] == [["7.0", "SC"], ["9.0", None], [None, "IV"]]
    whole = M.RawConcept("D", concept_type="raw", attributes=t.attributes, order=t.order, require_all=True)
    assert [r.value for r in families.raw_concept(whole, data).collect()] == [["7.0", "SC"]]
    b = M.RawConcept("B", concept_type="raw-boolean", attributes=(M.Attribute("b", "boolean"),))
    assert [x[2] for x in spans(families.raw_concept(b, records(spark, [("b", 0, "False"), ("b", 1, None)])))] == ["True", "True"]


def test_parameters(spark):
    p = lambda **kw: M.Parameter("C", "raw-concept", "P", **kw)
    run = lambda d, *frames: [round(float(x[2]), 6) for x in spans(families.parameterized_concept(d, frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])))]
    c = rows(spark, "C", [(0, 0.8), (10, 1.0), (20, 0.7)])
    base = M.ParameterizedConcept("R", parent=M.Source("C", "raw-concept"), parameters=(p(how="before"),), calls=(M.Call("subtract", 0, ("P",)),))
    assert run(base, c) == [0.2, -0.1]
    assert run(base, rows(spark, "C", [(0, 0.8)])) == []
    previous = M.ParameterizedConcept("R", parent=M.Source("C", "raw-concept"), parameters=(p(how="before", dynamic=True),), calls=(M.Call("div", 0, ("P",)),))
    assert run(previous, c) == [1.25, 0.7]
    assert run(previous, rows(spark, "C", [(0, 0), (1, 5)])) == []  # nothing is divided by 0
    near = M.ParameterizedConcept("R", parent=M.Source("G", "raw-concept"), parameters=(p(dynamic=True, good_before=2 * H, good_after=H),), calls=(M.Call("add", 0, ("P",)),))
    g = rows(spark, "G", [(1, 100), (5, 100), (9.5, 100), (15, 100)])
    assert run(near, g, c) == [100.8, 101.0]  # 1 h after, and half an hour before; the others are too far
    static = M.ParameterizedConcept("R", parent=M.Source("G", "raw-concept"), parameters=(p(default="1"),), calls=(M.Call("mul", 0, ("P",)),))
    assert run(static, g, c) == [80, 80, 80, 80] and run(static, g) == [100, 100, 100, 100]
    pivot = M.ParameterizedConcept("R", parent=M.Source("G", "raw-concept"), parameters=(p(),), calls=(M.Call("mul", 0, ("P",)),))
    assert run(pivot, rows(spark, "G", [(0, 10), (1, 10), (12, 10)]), c) == [8, 8] and run(pivot, g) == []
    gate = M.ParameterizedConcept("R", parent=M.Source("C", "raw-concept"), parameters=(p(how="before", dynamic=True),), calls=(M.Call("id_if_thresh_met", 0, ("P",), ("0.9", "ge")),))
    assert run(gate, c) == [0.7]


def test_event_rules(spark):
    d = M.Event("E", derived=(M.Source("G", "raw-concept", 0, "A"), M.Source("F", "raw-concept", 0, "B")), rules=(M.Rule("Hypo", (M.Condition("A", (M.Bound(None, None, 70),)), M.Condition("B", (M.Bound("True"),)))), M.Rule("Any", (M.Condition("A", (M.Bound(None, 0),)),))))
    got = families.event(d, rows(spark, "G", [(0, 70), (0, 60), (1, 71), (2, -5), (3, "x")]).unionByName(rows(spark, "F", [(0, "True"), (5, "False")])))
    assert spans(got) == [(0, 1 / 3600, "Hypo"), (0, 1 / 3600, "Hypo"), (1, 1 + 1 / 3600, "Any"), (2, 2 + 1 / 3600, "Hypo")]


def test_global_clip(spark):
    bounds = families.clip_bounds(records(spark, [("ADM", 8, ""), ("ADM", 9, ""), ("REL", 20, "")]), (M.GlobalClipper("ADM", "START"), M.GlobalClipper("REL", "END")))
    cut = lambda items, p=1: spans(families.clip_globally(rows(spark, "C", items, p), bounds))
    assert cut([(7, 10, "x"), (1, 8, "x"), (19, 30, "x"), (20, 21, "x"), (8, 8.5, "x")]) == [(8, 8.5, "x"), (8, 10, "x"), (19, 20, "x")]
    assert cut([(7, 7, "x")], 2) == [(7, 7, "x")]


def test_intersect(spark):
    a, b = rows(spark, "A", [(0, 5, "x"), (8, 9, "x")]), rows(spark, "B", [(4, 8, "x"), (20, 21, "x")])
    got = sorted(((r.start - T0).total_seconds() / 3600, (r.end - T0).total_seconds() / 3600) for r in families.intersect(a, b).collect())
    assert got == [(4, 5), (8, 8)]
