import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from intervallum.llm import nearest
from intervallum.llm.queries import SQL, p7_found
from tests.oracle import compare

LEFT = "dose long, entity long, concept string, t long, tol long, gap string"
RIGHT = "entity long, concept string, t long, id long, tol long, dose string"


def run(spark, left, right, **kw):
    l = spark.createDataFrame([(i, *x, "old") for i, x in enumerate(left)], LEFT)
    r = spark.createDataFrame([(*x, 0, "x") for x in right], RIGHT)
    return {x.dose: (x.gap, x.id) for x in nearest.nearest(l, r, **kw).collect()}


def brute(left, right):
    out = {}
    for i, (e, c, t, tol) in enumerate(left):
        if None in (e, c, t, tol):
            continue
        near = [(abs(t - rt), rid) for re, rc, rt, rid in right if None not in (re, rc, rt, rid) and (re, rc) == (e, c) and abs(t - rt) <= tol]
        if near:
            out[i] = min(near)
    return out


def test_cases(spark):
    day = 86_400_000_000
    left = [(1, "a", 100, 10), (1, "a", 100, 10), (1, "a", 100, 5), (1, "b", 100, 10), (2, "a", 100, 10), (None, "a", 100, 10), (1, None, 100, 10), (1, "a", None, 10), (1, "a", 100, None), (1, "a", day, 20), (1, "a", 3 * day, 0)]
    right = [(1, "a", 90, 7), (1, "a", 110, 3), (1, "a", 110, 2), (1, "a", 110, 9), (2, "a", 111, 1), (None, "a", 100, 5), (1, "a", None, 4), (1, "a", day - 20, 50), (1, "a", day + 20, 49), (1, "a", 3 * day, 8), (1, "a", 3 * day, None)]
    assert run(spark, left, right) == brute(left, right)
    assert run(spark, left, []) == {} and run(spark, [], right) == {}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from("ab"), st.integers(0, 5_000_000), st.integers(0, 900_000)), max_size=40), st.lists(st.tuples(st.integers(1, 2), st.sampled_from("ab"), st.integers(0, 5_000_000), st.integers(1, 99)), max_size=40))
def test_property(spark, left, right):
    assert run(spark, left, right, group_rows=5, shard_seconds=1) == brute(left, right)


def test_doses(spark):
    T = dt.datetime(2014, 1, 1)
    cat = spark.createDataFrame([("D", "M", 30), ("N", None, None)], "concept_name string, paired_concept string, tolerance_minutes int")
    doses = spark.createDataFrame([(1, 5, "D", T), (2, 5, "D", T), (3, 5, "N", T), (4, None, "D", T), (5, 5, "D", None), (6, 5, None, T), (7, 5, "D", T + dt.timedelta(hours=3))], "dose_id long, patient_id long, concept_name string, start_date_time timestamp_ntz")
    inputs = spark.createDataFrame([(10, 5, "M", T + dt.timedelta(minutes=30)), (9, 5, "M", T - dt.timedelta(minutes=30)), (8, 5, "X", T)], "row_id long, patient_id long, concept_name string, start_date_time timestamp_ntz")
    assert sorted(map(tuple, nearest.pair_doses(doses, inputs, cat).collect())) == [(1, 9), (2, 9)]


def test_sql(spark, sf_dir):
    compare(spark, sf_dir, p7_found, SQL["p7_found"])
