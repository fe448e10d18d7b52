import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from intervallum.operators import periods

T0 = dt.datetime(2014, 1, 1)


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def run(spark, rows, shard_days=7, extra=False):
    schema = "patient_id long, s timestamp_ntz, e timestamp_ntz" + (", entity string, shard int, kind string" if extra else "")
    data = [(p, at(a), at(b), *(("x", 1, "y") if extra else ())) for p, a, b in rows]
    got = periods.periods_and_gaps(spark.createDataFrame(data, schema), "patient_id", "s", "e", shard_days)
    return sorted((r.patient_id, r.kind, (r.s - T0).total_seconds(), (r.e - T0).total_seconds()) for r in got.collect())


def brute(rows):
    out, by = [], {}
    for p, a, b in rows:
        if None not in (p, a, b):
            by.setdefault(p, []).append((min(a, b), max(a, b)))
    for p, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(p, "period", a, b) for a, b in merged] + [(p, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def test_cases(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 21, 21), (1, 5, 5), (1, 40, 30), (2, 7, 7), (None, 1, 2), (3, None, 4), (3, 4, None), (1, 0, 10)]
    assert run(spark, rows, extra=True) == brute(rows)
    assert run(spark, []) == []


def test_across_shards(spark):
    day = 86_400
    rows = [(1, 0, 5 * day), (1, 5 * day, 5 * day), (1, 5 * day + 1, 9 * day), (1, 2 * day, 3 * day), (1, 20 * day, 20 * day + 5), (1, 21 * day, 21 * day), (2, day - 1, day), (2, day, day + 1), (2, 3 * day - 1, 3 * day - 1), (2, 3 * day, 3 * day)]
    assert run(spark, rows, 1) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400_000), st.integers(0, 60_000)), min_size=1, max_size=60))
def test_property(spark, rows):
    rows = [(p, a, a + b) for p, a, b in rows]
    assert run(spark, rows, 1) == brute(rows)
