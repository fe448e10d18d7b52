import math

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from intervallum.functions import registry, stats


def test_student_tail():
    for t, dof, p in ((2.0, 10, 0.07338803477074037), (0.0, 5, 1.0), (3.5, 2.7, 0.046), (12.7062, 1, 0.05), (1.96, 1e6, 0.05)):
        assert abs(stats.student_tail(t, dof) - p) < 2e-3
    assert abs(stats.student_tail(2.0, 10) - 0.07338803477074037) < 1e-9
    assert stats.student_tail(None, 3) is None


def test_firth_known_separation():
    """Perfect separation: plain likelihood has no maximum, the penalised one has."""
    x = np.column_stack([np.ones(8), np.arange(8) - 3.5])
    got = stats.firth(x, (np.arange(8) > 3).astype(float))
    assert got["converged"] and 0 < got["beta"][1] < 5 and abs(got["beta"][0]) < 1e-6


def test_firth_score_is_zero():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -0.5])))).astype(float)
    got = stats.firth(x, y)
    mu = got["fitted"]
    w = mu * (1 - mu)
    h = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ (x * w[:, None])), x)
    assert np.abs(x.T @ (y - mu + h * (0.5 - mu))).max() < 1e-5
    plain = stats.firth(x, y, penalised=False)
    assert np.abs(x.T @ (y - plain["fitted"])).max() < 1e-6
    assert (stats.sandwich(x, y - plain["fitted"], plain["covariance"], np.arange(200) // 2) > 0).all()


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    got = {r.i: r.q for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    assert got[4] is None and [round(got[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]


def test_bins(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(11)] + [(None, 1)], "s double, y int")
    got = {r.bin: r.n for r in stats.score_bins(df, "s", "y", 5, 1).collect()}
    expected = pd.cut(pd.Series(np.arange(11.0)), bins=5, include_lowest=True).value_counts(sort=False).tolist()
    assert [got[i + 1] for i in range(5)] == expected
    assert stats.score_bins(spark.createDataFrame([(1.0, 1)] * 3, "s double, y int"), "s", "y", 5, 1).first().n == 3


def test_groups_and_impute(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, float(x), float(x + rng.normal()), int(x + rng.normal() > 0), None if i % 3 else 1.0) for k in ("a", "b") for i, x in enumerate(rng.normal(size=80))], "k string, x double, z double, y int, m double")
    rows = stats.logistic_by_group(df, "k", "y", ["x", "z"]).collect()
    assert len(rows) == 6 and all(r.converged for r in rows) and all(r.coef > 0 for r in rows if r.feature == "x")
    assert {r.agreement for r in stats.sign_stability(df, "k", "y", ["x"], 8).collect()} == {1.0}
    assert stats.logistic_by_group(df.where("y = 1"), "k", "y", ["x"]).count() == 0
    got = stats.impute(df, ["m", "x"], 0.5)
    assert "m" not in got.columns and "x__missing" in got.columns
    got = stats.impute(df, ["m"], 0.9)
    assert got.where("m is null").count() == 0 and got.where("m__missing = 1").count() == df.where("m is null").count()
    assert stats.informative(df, ["m", "x"]) == ["x"]
    s = stats.standardised(df, ["x"]).selectExpr("avg(x) as m", "stddev_pop(x) as s").first()
    assert abs(s.m) < 1e-9 and abs(s.s - 1) < 1e-9
    p = stats.propensity(df, "k", "y", ["x"], [])
    w = stats.stabilised_weights(p, "y", by=["k"])
    b = {(r.k, r.feature): r for r in stats.balance(w, "y", ["x"], ["k"]).collect()}
    assert all(abs(r.smd_after) < abs(r.smd_before) for r in b.values())


def test_profile_and_totals(spark):
    df = spark.createDataFrame([(1, None, "a"), (3, "5", "a")], "n int, t string, c string")
    got = {r.column_name: r for r in stats.profile(df, ["n", "t", "c"]).collect()}
    assert got["n"].median == 2 and got["t"].nulls == 1 and got["t"].greatest == 5 and got["c"].mean is None and got["c"].distinct_values == 1
    t = stats.aspect_totals(spark.createDataFrame([(1.0, 0.0, 0.5), (None, None, 0.5), (None, None, None)], "a__x double, a__y double, b__x double"), ["a__x", "a__y", "b__x"]).collect()
    assert [r.total_adherence for r in t] == [0.5, 0.5, None]
    assert math.isclose(0.5, 0.5)


def test_prune_correlated(spark):
    """A column goes if one before it is too much like it, also if that one goes itself; without pairs all stay."""
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), float((i * 7) % 5), float(-i)) for i in range(50)], "`a.1` double, b double, c double, d double")
    assert stats.prune_correlated(df, ["a.1", "b", "c", "d"]) == ["a.1", "c"]
    assert stats.prune_correlated(df, ["b"]) == ["b"] and stats.prune_correlated(df, []) == []


def test_duration_columns(spark):
    """Durations in rows are read as those in definitions; other texts are none."""
    texts = ["90s", "15m", " 24h", "1d 12h", "2w", "6M", "1y", "h", "", None, "5", "3x"]
    got = [r.d for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", registry.duration(F.col("t")).alias("d")).orderBy("i").collect()]

    def expected(t):
        try:
            return registry.parse_duration(t)
        except ValueError:
            return None

    assert got == [expected(t) for t in texts]
