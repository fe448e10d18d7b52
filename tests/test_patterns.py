"""Hand-computed pattern cases; times are hours from day 0."""

import dataclasses

from pyspark.sql import functions as F

from intervallum.functions.exprs import combined_score, compliance_score, fulfilment, trapezoid_score
from intervallum.operators import patterns
from intervallum.plans import model as M
from tests.test_families import H, T0, rows

A, E = M.Source("ADM", "event", 0, "A1"), M.Source("BMI", "raw-concept", 0, "E1")
ANCHOR, EVENT = (M.Condition("A1", (M.Bound("True"),)),), (M.Condition("E1", (M.Bound(None, 10),)),)
TIME = M.Compliance(M.Trapezoid(0, 0, 48 * H, 72 * H, True))
BMI = M.LocalPattern("P", derived=(A, E), rules=(M.LocalRule("before", ANCHOR, EVENT, None, "first", 0.0, 72 * H, time=TIME),))


def run(d, *frames):
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    build = patterns.local_pattern if isinstance(d, M.LocalPattern) else patterns.global_pattern
    rnd = lambda x: None if x is None else round(x, 4)
    return sorted((round((r.start - T0).total_seconds() / 3600, 4), r.value[0], rnd(r.time_score), rnd(r.value_score), rnd(r.cyclic_score)) for r in build(d, df).collect())


def changed(d, **kw):
    return dataclasses.replace(d, rules=(dataclasses.replace(d.rules[0], **kw),))


def test_time_scores(spark):
    adm = rows(spark, "ADM", [(8, 8, "True")])
    assert run(BMI, adm, rows(spark, "BMI", [(9, 20)])) == [(9, "True", 1.0, None, None)]
    assert run(BMI, adm, rows(spark, "BMI", [(68, 20)])) == [(68, "Partial", 0.5, None, None)]
    assert run(BMI, adm, rows(spark, "BMI", [(9, 5), (100, 20)])) == [(8, "False", 0.0, None, None)]
    assert run(BMI, adm, rows(spark, "BMI", [(8, 20)])) == [(8, "False", 0.0, None, None)]  # an event must start after the anchor
    assert run(BMI, rows(spark, "BMI", [(9, 20)])) == []
    assert run(dataclasses.replace(BMI, ignore_unfulfilled=True), adm) == []


def test_greedy_order(spark):
    adm, bmi = rows(spark, "ADM", [(0, 0, "True"), (10, 10, "True")]), rows(spark, "BMI", [(20, 20), (30, 20)])
    d = changed(BMI, time=None)
    assert run(d, adm, bmi) == [(20, "True", None, None, None), (30, "True", None, None, None)]
    one = rows(spark, "BMI", [(20, 20)])
    # the first anchor takes the event; the second lies inside the match and is not punished
    assert run(d, adm, one) == [(20, "True", None, None, None)]
    # from the last anchor on, the first one is left open
    assert run(changed(d, anchor_select="last"), adm, one) == [(0, "False", None, None, None), (20, "True", None, None, None)]
    assert run(changed(d, event_select="last"), rows(spark, "ADM", [(0, 0, "True")]), bmi) == [(30, "True", None, None, None)]
    assert run(changed(d, min_distance=25 * H), rows(spark, "ADM", [(0, 0, "True")]), bmi) == [(30, "True", None, None, None)]


def test_overlap_and_gates(spark):
    meal, bolus, high = M.Source("MEAL", "context", 0, "A1"), M.Source("BOLUS", "context", 0, "E1"), M.Source("HIGH", "context", 0, "C1")
    low = M.Source("LOW", "context", 0, "C2")
    base = M.LocalRule("overlap", ANCHOR, (M.Condition("E1", (M.Bound("True"),)),), existence=True)
    gate = lambda how, *refs: M.Gate(tuple(M.Condition(r, (M.Bound("True"),)) for r in refs), how)
    d = M.LocalPattern("P", derived=(meal, bolus, high, low), rules=(base,))
    m, b, h = rows(spark, "MEAL", [(9, 11, "True")]), rows(spark, "BOLUS", [(10, 12, "True")]), rows(spark, "HIGH", [(8.5, 10.5, "True")])
    assert run(d, m, b) == [(10, "True", 1.0, None, None)]
    assert run(d, m) == [(9, "False", 0.0, None, None)]
    assert run(d, m, rows(spark, "BOLUS", [(11, 12, "True")])) == [(11, "True", 1.0, None, None)]  # touching counts
    gated = changed(d, gate=gate("or", "C1"))
    assert run(gated, m, b, h) == [(10, "True", 1.0, None, None)]
    assert run(gated, m, b) == [] and run(gated, m, b, rows(spark, "HIGH", [(12, 13, "True")])) == []
    both = changed(d, gate=gate("and", "C1", "C2"))
    assert run(both, m, b, h) == []
    assert run(both, m, b, h, rows(spark, "LOW", [(10, 20, "True")])) == [(10, "True", 1.0, None, None)]
    assert run(both, m, b, h, rows(spark, "LOW", [(10.6, 20, "True")])) == []


def test_values_and_parameters(spark):
    fit = M.Compliance(M.Trapezoid(0, 0.2, 0.6, 1), "mul", ("P1",), ("E1",))
    d = dataclasses.replace(changed(BMI, time=None, value=fit), parameters=(M.Parameter("WEIGHT", "raw-concept", "P1", default="100"),))
    adm = rows(spark, "ADM", [(0, 0, "True")])
    assert run(d, adm, rows(spark, "BMI", [(1, 40)])) == [(1, "True", None, 1.0, None)]
    assert run(d, adm, rows(spark, "BMI", [(1, 80)])) == [(1, "Partial", None, 0.5, None)]
    assert run(d, adm, rows(spark, "BMI", [(1, 40)]), rows(spark, "WEIGHT", [(5, 50), (6, 1000)])) == [(1, "Partial", None, 0.5, None)]
    assert run(d, adm, rows(spark, "BMI", [(1, 120)])) == [(1, "False", None, 0.0, None)]
    assert run(d, adm) == [(0, "False", None, 0.0, None)]


def test_rules_share_anchors_and_events(spark):
    r = BMI.rules[0]
    near = dataclasses.replace(r, max_distance=2 * H, time=None)
    d = dataclasses.replace(BMI, rules=(near, r))
    adm, bmi = rows(spark, "ADM", [(0, 0, "True"), (50, 50, "True")]), rows(spark, "BMI", [(1, 20), (110, 20)])
    # the second anchor fails the first rule (a row without scores to lose: full), then meets the second one
    got = run(d, adm, bmi)
    assert (1, "True", None, None, None) in got and (110, "Partial", 0.5, None, None) in got and len(got) == 2


def cyclic(**kw):
    base = {"start": 0, "end": 24 * H, "window": 12 * H, "least": 1, "most": 3, "event": (M.Condition("E1", (M.Bound(None, 0),)),)}
    return M.GlobalPattern("W", derived=(M.Source("ADM", "event", 0, "I1"), M.Source("G", "raw-concept", 0, "E1"), M.Source("REL", "event", 0, "C1"), M.Source("CTX", "context", 0, "X1")), rules=(M.CyclicRule(**(base | kw)),))


def test_cyclic(spark):
    start = (M.Condition("I1", (M.Bound("True"),)),)
    count = M.Compliance(M.Trapezoid(0, 3, 10, 100))
    adm, rel = rows(spark, "ADM", [(8, 8, "True")]), rows(spark, "REL", [(240, 240, "True")])
    d = cyclic(end=120 * H, initiator=start, cyclic=count)
    got = run(d, adm, rel, rows(spark, "G", [(10, 100)]))
    assert len(got) == 10 and got[0] == (20, "Partial", None, None, 0.3333) and got[1] == (32, "False", None, None, 0.0)
    assert run(d, rel, rows(spark, "G", [(10, 100)])) == []  # a declared initiator that is absent
    clipped = cyclic(end=120 * H, initiator=start, clipper=(M.Condition("C1", (M.Bound("True"),)),), cyclic=count)
    assert [x[0] for x in run(clipped, adm, rows(spark, "REL", [(33, 33, "True"), (240, 240, "True")]), rows(spark, "G", [(10, 100)]))] == [20, 32]
    free = cyclic(value=M.Compliance(M.Trapezoid(0, 100, 200, 300), targets=("E1",)))
    got = run(free, rows(spark, "G", [(0, 50), (1, 250), (13, 150), (30, 30)]))
    assert got == [(12, "Partial", None, 0.5, None), (24, "True", None, 1.0, None)]
    gate = M.Gate((M.Condition("X1", (M.Bound("True"),)),))
    assert [x[0] for x in run(cyclic(gate=gate), rows(spark, "G", [(0, 5), (30, 5)]), rows(spark, "CTX", [(12, 13, "True")]))] == [12, 24]
    assert [x[0] for x in run(cyclic(gate=gate), rows(spark, "G", [(0, 5), (30, 5)]), rows(spark, "CTX", [(12.5, 13, "True")]))] == [24]


def test_overlapping_episodes_consume_events_once(spark):
    start = (M.Condition("I1", (M.Bound("True"),)),)
    d = cyclic(initiator=start)
    got = run(d, rows(spark, "ADM", [(0, 0, "True"), (6, 6, "True")]), rows(spark, "G", [(7, 1), (40, 1)]))
    # windows 0-12, 12-24 of the first episode, 6-18, 18-30 of the second: the event at 7 counts in the first only
    assert [(x[0], x[1]) for x in got] == [(12, "True"), (18, "False"), (24, "False"), (30, "False")]


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    t = M.Trapezoid(0, 2, 4, 8)
    assert [value(trapezoid_score(t, F.lit(float(x)))) for x in (-1, 0, 1, 2, 4, 6, 8, 9)] == [0, 0, 0.5, 1, 1, 0.5, 0, 0]
    assert value(trapezoid_score(M.Trapezoid(0, 0, 4, 8), F.lit(-1.0))) == 1.0  # open below
    assert value(trapezoid_score(t, F.lit(None).cast("double"))) is None
    assert value(compliance_score(M.Compliance(t, "mul", ("p",)), F.lit(3.0), {"p": F.lit(-1.0)})) == 0.0  # corners lose their order
    assert value(compliance_score(M.Compliance(t, "mul", ("p",)), F.lit(3.0), {"p": F.lit(None).cast("double")})) == 0.0
    assert value(combined_score(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5))) == 0.75 and value(combined_score(F.lit(None).cast("double"))) == 1.0
    assert [value(fulfilment(F.lit(x))) for x in (1.0, 0.3, 0.0)] == ["True", "Partial", "False"]
