import datetime as dt

import numpy as np
import pandas as pd

from intervallum.operators import spikes

T = dt.datetime(2014, 1, 1)
SCHEMA = "row_id long, patient_id long, concept_name string, source_id string, start_date_time timestamp_ntz, y double, factor double, decimals int, unit_code string, min_possible double, max_possible double"


def frame(spark, series):
    """series: {(patient, concept, source): [(minute or None, y), ...]}"""
    rows, n = [], 0
    for (p, c, s), xs in series.items():
        for t, y in xs:
            n += 1
            rows.append((n, p, c, s, None if t is None else T + dt.timedelta(minutes=t), float(y), 1.0, 2, "u", 0.0, 1000.0))
    return spark.createDataFrame(rows, SCHEMA)


def noise(seed, n=60, level=100.0):
    return list(enumerate(np.round(np.random.default_rng(seed).normal(level, 1.0, n), 2)))


def kinds(spark, df, **kw):
    return {r.row_id: r.kind for r in spikes.implausible(df, **kw).collect()}


def test_kinds(spark):
    a = noise(1)
    a[20] = (20, 130.0)  # alone
    a[30], a[31] = (30, 70.0), (31, 71.0)  # with one neighbour
    a = a[:45] + [(t, y + 40) for t, y in a[45:]]  # a lasting change of level
    b = noise(2)
    b[10:16] = [(t, 99.5) for t, _ in b[10:16]]  # six times the same
    b[30:35] = [(t, 99.5) for t, _ in b[30:35]]  # five times
    b[50] = (50, -5.0)
    df = frame(spark, {(1, "A", "s"): a, (1, "A", "t"): b})
    assert kinds(spark, df) == {21: "spike", 31: "spike", 32: "spike", **{60 + i: "stuck" for i in range(11, 17)}, 111: "impossible"}


def test_copies_ties_and_nulls(spark):
    a = noise(3)
    a[20] = (20, 130.0)
    a += [(20, 130.0), (20, 100.0), (None, 2000.0), (None, 50.0)]
    df = frame(spark, {(1, "A", None): a, (None, "A", "s"): [(1, -1), (2, 5)], (2, "B", "s"): [(1, 5)], (3, "B", "s"): [(1, 5), (1, 6), (2, 500), (3, 5)]})
    assert kinds(spark, df) == {21: "spike", 61: "spike", 63: "impossible", 65: "impossible"}


def test_empty(spark):
    assert kinds(spark, frame(spark, {}).limit(0)) == {}


def brute(df: pd.DataFrame) -> dict:
    """The definition, series by series, with plain loops."""
    info, out = [], {}
    for _, g in df.groupby(["patient_id", "concept_name", "source_id"], dropna=False):
        g = g.sort_values(["start_date_time", "row_id"])
        y, ids = g.y.tolist(), g.row_id.tolist()
        run = 0
        for i in range(len(y)):
            run = run + 1 if i and abs(y[i] - y[i - 1]) <= 1e-9 * abs(y[i]) else 1
            if run >= 6:
                for k in range(i - run + 1, i + 1):
                    out[ids[k]] = "stuck"
        steps = [abs(b - a) for a, b in zip(y, y[1:])]
        info.append((ids, y, np.median(steps) / 0.954 if steps else 0.0, abs(np.median(y))))
    usual = np.median([s / c for ids, y, s, c in info if len(y) >= 10])
    for ids, y, s, c in info:
        n = len(y)
        limit = 8 * np.sqrt((n * s**2 + 12 * (usual * c) ** 2) / (n + 12))
        far = lambda v, *xs: all(v - x > limit for x in xs) or all(x - v > limit for x in xs)
        for i in range(n):
            if 0 < i < n - 1 and far(y[i], y[i - 1], y[i + 1]):
                out.setdefault(ids[i], "spike")
            if 0 < i < n - 2 and far(y[i], y[i - 1], y[i + 2]) and far(y[i + 1], y[i - 1], y[i + 2]) and (y[i] > y[i - 1]) == (y[i + 1] > y[i - 1]):
                out.setdefault(ids[i], "spike")
                out.setdefault(ids[i + 1], "spike")
    return out


def test_against_brute_force_and_shards(spark):
    rng = np.random.default_rng(9)
    series = {}
    for p in range(12):
        x = noise(100 + p, 80)
        for at in rng.choice(np.arange(3, 76, 5), 3, replace=False):
            x[at] = (x[at][0], x[at][1] + rng.choice([-1, 1]) * 25)
            if rng.random() < 0.4:
                x[at + 1] = (x[at + 1][0], x[at][1] + 0.3)
        if p % 3 == 0:
            k = int(rng.integers(5, 60))
            x[k : k + 8] = [(t, x[k][1]) for t, _ in x[k : k + 8]]
        series[p, "A", "s"] = x
    df = frame(spark, series)
    expected = brute(df.toPandas())
    assert "spike" in expected.values() and "stuck" in expected.values()
    assert kinds(spark, df) == expected
    assert kinds(spark, df, shard_rows=20) == expected


def test_shards_of_different_scatter(spark):
    """A noisy period of a long series hides no spikes of its quiet ones, and judges its own by the whole series."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(500, 1, 80), rng.normal(500, 60, 70), rng.normal(500, 1, 80)]), 2)
    x[[20, 50, 180, 210]] = 530, 472, 525, 474
    df = frame(spark, {(1, "A", "s"): list(enumerate(x)), (2, "A", "s"): noise(5, 60)})
    expected = kinds(spark, df)
    assert {21, 51, 181, 211} <= set(expected)
    assert kinds(spark, df, shard_rows=70) == expected
    assert kinds(spark, df, shard_rows=20) == expected
