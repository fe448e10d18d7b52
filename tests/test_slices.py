"""Slices of time against plain loops over whole patients."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervallum.functions.exprs import FRAME_SCHEMA
from intervallum.operators import families, slices
from intervallum.plans import model as M

D = slices.DAY


def sample(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(p), int(t), int(n)) for n, (p, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-3 * D, 30 * D, 300)))]
    spans = [(int(p), int(a), int(a + rng.integers(0, 5 * D))) for p, a in zip(rng.integers(0, 3, 60), rng.integers(-3 * D, 30 * D, 60))]
    return rows, spans, spark.createDataFrame(rows, "patient_id long, t long, ord long"), spark.createDataFrame(spans, "patient_id long, a long, b long")


@pytest.mark.parametrize("seed", [0, 1])
def test_running_values(spark, seed):
    rows, spans, r, s = sample(spark, seed)
    got = {x.ord: x._reach for x in slices.reached(r, F.col("t"), s, F.col("a"), F.col("b")).collect()}
    assert got == {n: max((b for q, a, b in spans if q == p and a <= t), default=None) for p, t, n in rows}
    got = {x.ord: x.after for x in slices.next_at(r, F.col("t"), s, F.col("a"), "after").collect()}
    assert got == {n: min((a for q, a, _ in spans if q == p and a >= t), default=None) for p, t, n in rows}


def test_overlaps(spark):
    rows, spans, r, s = sample(spark)
    right = s.select(F.col("patient_id").alias("_rp"), "a", "b")
    got = sorted((x.ord, x.a, x.b) for x in slices.overlap_join(r, right, (F.col("t") - D, F.col("t") + D // 2), (F.col("a"), F.col("b")), 2 * D).collect())
    assert got == sorted((n, a, b) for p, t, n in rows for q, a, b in spans if p == q and t - D <= b and a <= t + D // 2)
    left = slices.overlap_join(r, right, (F.col("t"), F.col("t")), (F.col("a"), F.col("b")), D, "left").groupBy("ord").agg(F.count("a").alias("n")).collect()
    assert {x.ord: x.n for x in left} == {n: sum(q == p and a <= t <= b for q, a, b in spans) for p, t, n in rows}


def test_stretches_part_only_what_is_apart(spark):
    rows, *_ = sample(spark)
    df = spark.createDataFrame([(p, t, t + 1, n) for p, t, n in rows if not 8 * D < t < 14 * D], "patient_id long, _s long, _e long, ord long")
    got = slices.with_stretches(df, D).collect()
    assert len({(x.patient_id, x.stretch) for x in got}) >= 6
    for x in got:
        for y in got:
            if x.patient_id == y.patient_id and x.stretch != y.stretch:
                assert abs(x._s - y._s) > D


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def source(spark, n, patients=1):
    base = F.timestamp_micros(F.lit(1_388_534_400_000_000) + F.col("id") * 600_000_000).cast("timestamp_ntz")
    value = F.array((F.pmod(F.xxhash64("id"), F.lit(7)) + F.floor(F.col("id") / 50) % 2 * 100).cast("string"))
    return spark.range(n).select(F.pmod("id", F.lit(patients)).alias("patient_id"), F.lit("G").alias("concept"), base.alias("start"), (base + F.expr("interval 1 second")).alias("end"), value.alias("value"), F.lit("raw-concept").alias("kind"), F.col("id").alias("ord")).select(*families.FRAME)


STATE = M.State("S", parent=M.Source("G", "raw-concept"), good_after=86_400.0, rules=(M.Rule("Low", (M.Condition("", (M.Bound(None, None, 50),), 0),), "and"), M.Rule("High", (M.Condition("", (M.Bound(None, 50, None),), 0),), "and")))
TREND = M.Trend("T", parent=M.Source("G", "raw-concept"), significant=40, time_steady=43_200.0, good_after=86_400.0)


def test_hot_patient_is_spread(spark):
    """One patient of 200,000 samples without a gap: no sorted window over the patient alone, and done in seconds."""
    df = source(spark, 200_000)
    for d, build in ((STATE, families.state), (TREND, families.trend)):
        began = time.time()
        out = build(d, df)
        assert out.count() > 1000 and time.time() - began < 90
        for line in plan_of(out).splitlines():
            if "Window" in line and "patient_id" in line:
                assert "_slice" in line, line


def test_states_across_slices(spark):
    """Runs that cross many slices fold as one; a plain loop says the same."""
    rows = source(spark, 3000, 2).collect()
    expected = []
    for p in (0, 1):
        cur = None
        own = [(int((r.start - dt.datetime(1970, 1, 1)).total_seconds()), "Low" if float(r.value[0]) < 50 else "High") for r in rows if r.patient_id == p]
        for s, label in own:
            if cur and label == cur[2] and s <= cur[0] + 86_400:
                cur[1] = s
                continue
            if cur:
                expected.append((p, cur[0], min(cur[1] + 86_400, s), cur[2]))
            cur = [s, s, label]
        expected.append((p, cur[0], cur[1] + 86_400, cur[2]))
    got = sorted((r.patient_id, int((r.start - dt.datetime(1970, 1, 1)).total_seconds()), int((r.end - dt.datetime(1970, 1, 1)).total_seconds()), r.value[0]) for r in families.state(STATE, spark.createDataFrame(rows, FRAME_SCHEMA)).collect())
    assert got == sorted(expected)
