"""Analytics over the output and score tables, as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --- adherence -------------------------------------------------------------------------------------------------------


def dated(scores: DataFrame) -> DataFrame:
    """Scores with a value and a start, and their day."""
    return scores.where("compliance_score is not null and not isnan(compliance_score) and start_date_time is not null").withColumn("day", F.to_date("start_date_time"))


def daily_adherence(scores: DataFrame) -> DataFrame:
    """Mean score per patient, pattern, type and day."""
    return dated(scores).groupBy("patient_id", "pattern_name", "compliance_type", "day").agg(F.avg("compliance_score").alias("day_score"))


def type_adherence(scores: DataFrame) -> DataFrame:
    """Mean over days per patient, pattern and type, with first start and last end."""
    key = ["patient_id", "pattern_name", "compliance_type"]
    days = dated(scores).groupBy(*key, "day").agg(F.avg("compliance_score").alias("s"), F.min("start_date_time").alias("a"), F.max("end_date_time").alias("b"))
    return days.groupBy(*key).agg(F.avg("s").alias("avg_score"), F.min("a").alias("first_start"), F.max("b").alias("last_end"))


def pattern_adherence(scores: DataFrame) -> DataFrame:
    """Types collapsed within the day, then days, per patient and pattern."""
    key = ["patient_id", "pattern_name"]
    types = dated(scores).groupBy(*key, "compliance_type", "day").agg(F.avg("compliance_score").alias("s"), F.min("start_date_time").alias("a"))
    days = types.groupBy(*key, "day").agg(F.avg("s").alias("s"), F.min("a").alias("a"))
    return days.groupBy(*key).agg(F.avg("s").alias("avg_score"), F.min("a").alias("first_start"))


def total_adherence(scores: DataFrame) -> DataFrame:
    """Each patient's mean over patterns, and first start."""
    return pattern_adherence(scores).groupBy("patient_id").agg(F.avg("avg_score").alias("total_score"), F.min("first_start").alias("first_start"))


def adherence_summary(by_type: DataFrame) -> DataFrame:
    """Number, mean, deviation, median and interquartile range per pattern and type."""
    got = by_type.groupBy("pattern_name", "compliance_type").agg(F.count("avg_score").alias("n"), F.avg("avg_score").alias("mean"), F.stddev_samp("avg_score").alias("sd"), F.expr("percentile(avg_score, array(0.25, 0.5, 0.75))").alias("q"))
    return got.select("pattern_name", "compliance_type", "n", "mean", "sd", F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"))


def monthly(totals: DataFrame, value: str = "total_score", at: str = "first_start") -> DataFrame:
    """Per month: mean, deviation, number, standard error and 95 % interval."""
    got = totals.where(F.col(at).isNotNull()).groupBy(F.date_trunc("month", at).cast("date").alias("month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    sem = F.col("sd") / F.sqrt("n")
    return got.select("month", "mean", "sd", "n", sem.alias("sem"), (F.col("mean") - 1.96 * sem).alias("low"), (F.col("mean") + 1.96 * sem).alias("high"))


def score_bins(df: DataFrame, score: str, outcome: str, bins: int = 10, least: int = 30) -> DataFrame:
    """Equal-width bins of `score` (right-closed, the first closed on both sides): size, outcome ratio and mean score; small bins are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    x = F.ceil((F.col(score) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    k = F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(x, F.lit(1)))).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("ratio"), F.avg(score).alias("avg_score")).where(F.col("n") >= least)


def event_day_ratio(scores: DataFrame, output: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Per patient: days with scores, days with one of the events, and per concept the number of events."""
    days = dated(scores).groupBy("patient_id").agg(F.countDistinct("day").alias("score_days"))
    rows = output.where(F.col("concept_name").isin(list(concepts))).withColumn("day", F.to_date("start_date_time"))
    counts = rows.groupBy("patient_id").agg(F.countDistinct("day").alias("event_days"), *[F.count_if(F.col("concept_name") == c).alias(f"n_{c.lower()}") for c in concepts])
    both = days.join(counts, "patient_id", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["event_days", *[f"n_{c.lower()}" for c in concepts]]]
    return both.select("patient_id", "score_days", *zero, (F.coalesce(F.col("event_days"), F.lit(0)) / F.col("score_days")).alias("event_ratio"))


def compare_periods(df: DataFrame, value: str, at: str, split: str, by: Sequence[str] = ()) -> DataFrame:
    """Number and mean before and from a date, and their difference, per group."""
    before = F.col(at) < F.lit(split).cast("timestamp_ntz")
    got = df.where(F.col(at).isNotNull()).groupBy(*by).agg(F.count(F.when(before, F.col(value))).alias("n_before"), F.avg(F.when(before, F.col(value))).alias("mean_before"), F.count(F.when(~before, F.col(value))).alias("n_after"), F.avg(F.when(~before, F.col(value))).alias("mean_after"))
    return got.withColumn("difference", F.col("mean_after") - F.col("mean_before"))


# --- tests and association -------------------------------------------------------------------------------------------


def welch(df: DataFrame, value: str, group: Column, by: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t statistic and degrees of freedom of the difference in means, group true minus false."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    got = df.groupBy(*by).agg(F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n0"), F.avg(b).alias("m0"), F.var_samp(b).alias("v0"))
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(s1 + s0))
    dof = F.try_divide((s1 + s0) * (s1 + s0), s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1))
    enough = (F.col("n1") > 1) & (F.col("n0") > 1)
    return got.select(*by, "n1", "n0", (F.col("m1") - F.col("m0")).alias("difference"), F.when(enough, t).alias("t"), F.when(enough, dof).alias("dof"))


def student_tail(t: float | None, dof: float | None) -> float | None:
    """Two-sided p-value of a t statistic, by the continued fraction of the incomplete beta function."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    x, a, b = dof / (dof + t * t), dof / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def with_p_values(df: DataFrame, t: str = "t", dof: str = "dof", out: str = "p") -> DataFrame:
    """`df` with two-sided p-values of its t statistics."""
    p = F.pandas_udf(lambda a, b: pd.Series([student_tail(None if x != x else x, None if y != y else y) for x, y in zip(a, b)], dtype="float64"), "double")
    return df.withColumn(out, p(F.col(t).cast("double"), F.col(dof).cast("double")))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """False-discovery-rate adjusted p-values within groups; null p-values stay null and do not count."""
    ok = F.col(p).isNotNull()
    w = W.partitionBy(*by, ok)
    rank = F.row_number().over(w.orderBy(F.col(p)))
    raw = df.withColumn("__raw", F.when(ok, F.col(p) * F.count("*").over(w) / rank)).withColumn("__k", rank)
    least = F.min("__raw").over(W.partitionBy(*by, F.col(p).isNotNull()).orderBy(F.col("__k").desc()).rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0)))).drop("__raw", "__k")


def association(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Number, Pearson correlation and least-squares line of y on x."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], over: float = 0.9) -> DataFrame:
    """(a, b, r) of column pairs whose absolute correlation over the rows that have both is over a limit.

    Each partition adds up one matrix of moments about the means, so the cost is one pass however many pairs there are.
    """
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(len(columns))])
    names = ("n", "x", "y", "xx", "yy", "xy")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(columns), len(columns)))
        for part in batches:
            v = part.to_numpy(float) - centre
            there = np.isfinite(v).astype(float)
            v = np.where(there > 0, v, 0.0)
            total += np.stack([there.T @ there, v.T @ there, there.T @ v, (v * v).T @ there, there.T @ (v * v), v.T @ v])
        i, j = np.triu_indices(len(columns), 1)
        yield pd.DataFrame({"i": i, "j": j} | {name: total[k, i, j] for k, name in enumerate(names)})

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    got = rows.mapInPandas(moments, "i long, j long, " + ", ".join(f"{n} double" for n in names)).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    cov, vx, vy = F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r = F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    label = F.array(*[F.lit(c) for c in columns])
    return got.select(F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"), r.alias("r")).where(F.abs("r") > over)


def prune_correlated(df: DataFrame, columns: Sequence[str], over: float = 0.9) -> list[str]:
    """The columns without those that correlate too much with one before them. As many numbers as column pairs reach the driver."""
    if len(columns) < 2:
        return list(columns)
    drop = {r.b for r in correlated_pairs(df, columns, over).collect()}
    return [c for c in columns if c not in drop]


# --- features --------------------------------------------------------------------------------------------------------


def complication_labels(output: DataFrame, visits: DataFrame, concepts: Sequence[str], cutoff_hours: float = 48.0) -> DataFrame:
    """(patient_id, complication, admit_time, cutoff_time, y) per visit and complication.

    A complication before the cutoff excludes the visit; one at or after it is positive, with the first such time; none is
    negative, with the end of the visit.
    """
    times = visits.select(F.col("visit_id").alias("patient_id"), F.col("start_datetime").alias("admit_time"), F.col("end_datetime").alias("end_time"))
    rows = output.where(F.col("concept_name").isin(list(concepts)) & F.col("start_date_time").isNotNull()).select("patient_id", F.col("concept_name").alias("complication"), "start_date_time")
    limit = F.col("admit_time") + F.expr(f"interval {round(cutoff_hours * 3600)} seconds")
    known = rows.join(times, "patient_id").where("admit_time is not null")
    seen = known.groupBy("patient_id", "complication").agg(F.bool_or(F.col("start_date_time") < limit).alias("early"), F.min(F.when(F.col("start_date_time") >= limit, F.col("start_date_time"))).alias("first_late"))
    types = known.select("complication").distinct()
    grid = times.join(F.broadcast(types))  # as many types as concepts are asked for
    both = grid.join(seen, ["patient_id", "complication"], "left").where(~F.coalesce("early", F.lit(False)))
    return both.select("patient_id", "complication", "admit_time", F.coalesce("first_late", "end_time").alias("cutoff_time"), F.col("first_late").isNotNull().cast("int").alias("y"))


def window_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels with the mean score of each aspect (pattern__type) in [admit, cutoff), days first: (…, aspect, avg_score)."""
    s = dated(scores).select("patient_id", F.concat_ws("__", "pattern_name", "compliance_type").alias("aspect"), "start_date_time", "day", "compliance_score")
    inside = labels.join(s, "patient_id").where((F.col("start_date_time") >= F.col("admit_time")) & (F.col("start_date_time") < F.col("cutoff_time")))
    key = [*labels.columns, "aspect"]
    return inside.groupBy(*key, "day").agg(F.avg("compliance_score").alias("s")).groupBy(*key).agg(F.avg("s").alias("avg_score"))


def feature_table(labels: DataFrame, by_aspect: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """One row per label with a column per aspect, null where it never applied."""
    key = labels.columns
    wide = by_aspect.groupBy(*key).pivot("aspect", list(aspects)).agg(F.first("avg_score"))
    wide = wide.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(f"`{a}`") for a in aspects])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return labels.join(wide, same, "left").select(*key, *[F.col(f"`{a}`") for a in aspects])


def impute(df: DataFrame, columns: Sequence[str], most_missing: float = 0.95) -> DataFrame:
    """Columns missing too often are dropped; the others get `<column>__missing` and their median in place of nulls."""
    got = df.agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[F.expr(f"percentile(`{c}`, 0.5)").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    keep = [(c, got[f"m{i}"]) for i, c in enumerate(columns) if got.n and 1 - got[f"c{i}"] / got.n <= most_missing]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in rest], *[F.coalesce(F.col(f"`{c}`"), F.lit(m)).alias(c) for c, m in keep], *[F.col(f"`{c}`").isNull().cast("int").alias(f"{c}__missing") for c, _ in keep])


def informative(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that take more than one value."""
    got = df.agg(*[F.countDistinct(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if got[f"c{i}"] > 1]


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean, over their population deviation (or 1)."""
    got = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(got[f"m{i}"])) / F.lit(got[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def visit_times(visits: DataFrame) -> DataFrame:
    """Visits with their duration in days from the times, else the recorded one; -1 stands for an unknown number."""
    span = F.timestamp_diff("SECOND", F.col("start_datetime"), F.col("end_datetime")) / 86_400.0
    return visits.select("visit_id", "person_id", "start_datetime", "end_datetime", F.coalesce(F.round(span, 4), sentinel("duration_days")).alias("duration_days"), "hospital", sentinel("death_within_30d").cast("int").alias("death_within_30d"))


def sentinel(column: str, value: float = -1.0) -> Column:
    """The column with a sentinel as null."""
    return F.when(F.col(column) != value, F.col(column))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: nulls, share of nulls, distinct values, least, greatest, mean and median of its numbers."""
    cast = lambda c: F.col(c).try_cast("double") if dict(df.dtypes)[c] != "boolean" else F.col(c).cast("double")
    measures = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_share"), F.countDistinct(c).alias("distinct_values"),
            F.min(cast(c)).alias("least"), F.max(cast(c)).alias("greatest"), F.avg(cast(c)).alias("mean"), F.percentile(cast(c), F.lit(0.5)).alias("median"),
        )
        for c in columns
    ])
    return df.agg(measures.alias("x")).select(F.inline("x"))


def robust_findings(results: DataFrame, runs: int, significant: str = "significant", effect: str = "coef") -> DataFrame:
    """(complication, feature, robust): found in every run, always significant, with one sign that is not 0."""
    sign = F.signum(effect)
    return results.groupBy("complication", "feature").agg(((F.count("*") >= runs) & F.coalesce(F.bool_and(significant), F.lit(False)) & (F.min(sign) == F.max(sign)) & (F.min(sign) != 0)).alias("robust"))


# --- models ----------------------------------------------------------------------------------------------------------


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) if np.isfinite(v) else np.nan for v in z])


def firth(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalised: bool = True, rounds: int = 200, tol: float = 1e-8) -> dict:
    """Logistic regression with Jeffreys' prior (Firth), or plain. x has its constant column. Newton steps are halved until
    the (penalised) likelihood does not fall."""
    w0 = np.ones(len(y)) if weight is None else weight

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        eta = np.clip(x @ beta, -35, 35)
        mu = 1 / (1 + np.exp(-eta))
        v = w0 * mu * (1 - mu)
        info = x.T @ (x * v[:, None]) + 1e-12 * np.eye(x.shape[1])
        sign, logdet = np.linalg.slogdet(info)
        fit = float(np.sum(w0 * (y * eta - np.logaddexp(0, eta)))) + (0.5 * logdet if penalised and sign > 0 else 0.0)
        return fit, mu, v, info

    beta = np.zeros(x.shape[1])
    fit, mu, v, info = at(beta)
    done = False
    for used in range(1, rounds + 1):
        inverse = np.linalg.pinv(info)
        residual = w0 * (y - mu)
        if penalised:
            leverage = v * np.sum((x @ inverse) * x, axis=1)
            residual = residual + leverage * (0.5 - mu)
        step = inverse @ (x.T @ residual)
        for _ in range(30):
            new = at(beta + step)
            if new[0] >= fit - 1e-10:
                break
            step = step / 2
        beta = beta + step
        fit, mu, v, info = new
        if np.abs(step).max() < tol:
            done = True
            break
    inverse = np.linalg.pinv(info)
    se = np.sqrt(np.maximum(np.diag(inverse), 0))
    return {"beta": beta, "se": se, "p": _normal_tail(beta / np.where(se > 0, se, np.nan)), "covariance": inverse, "fitted": mu, "converged": done, "rounds": used}


def sandwich(x: np.ndarray, residual: np.ndarray, inverse: np.ndarray, cluster: np.ndarray | None = None) -> np.ndarray:
    """Robust standard errors, by rows or by clusters."""
    score = x * residual[:, None]
    if cluster is not None:
        _, code = np.unique(cluster, return_inverse=True)
        score = np.stack([np.bincount(code, score[:, j]) for j in range(score.shape[1])], axis=1)
    return np.sqrt(np.maximum(np.diag(inverse @ (score.T @ score) @ inverse), 0))


_MODEL = "{key} string, feature string, coef double, se double, p double, low double, high double, n long, converged boolean"


def _design(part: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    x = part[list(features)].to_numpy(float)
    s = x.std(0)
    return np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(s > 0, s, 1)])


def logistic_by_group(df: DataFrame, key: str, target: str, features: Sequence[str], penalised: bool = True, cluster: str | None = None) -> DataFrame:
    """One logistic model per group over standardised features: coefficients with errors. Rows with nulls are left out.

    A group is one complication; its model needs all its rows in one place, so `df` should have one row per visit.
    """
    need = [key, target, *features, *([cluster] if cluster else [])]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        y = part[target].to_numpy(float)
        if len(np.unique(y)) < 2:
            return pd.DataFrame(columns=[key, "feature", "coef", "se", "p", "low", "high", "n", "converged"])
        x = _design(part, features)
        got = firth(x, y, penalised=penalised)
        se = sandwich(x, y - got["fitted"], got["covariance"], part[cluster].to_numpy()) if cluster else got["se"]
        p = _normal_tail(got["beta"] / np.where(se > 0, se, np.nan))
        out = pd.DataFrame({"feature": ["const", *features], "coef": got["beta"], "se": se, "p": p, "low": got["beta"] - 1.96 * se, "high": got["beta"] + 1.96 * se})
        out.insert(0, key, str(part[key].iloc[0]))
        return out.assign(n=len(y), converged=bool(got["converged"]))

    return df.select(*need).dropna().groupBy(key).applyInPandas(fit, _MODEL.format(key=key))


def sign_stability(df: DataFrame, key: str, target: str, features: Sequence[str], resamples: int = 50, seed: int = 42) -> DataFrame:
    """(key, feature, agreement): share of bootstrap fits whose sign is that of the full fit. Seeded, so repeatable."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([target, *features], kind="stable").reset_index(drop=True)
        x, y = _design(part, features), part[target].to_numpy(float)
        if len(np.unique(y)) < 2:
            return pd.DataFrame(columns=[key, "feature", "agreement"])
        sign, rng = np.sign(firth(x, y)["beta"][1:]), np.random.default_rng(seed)
        agree, done = np.zeros(len(features)), 0
        for _ in range(resamples):
            at = rng.integers(0, len(y), len(y))
            if len(np.unique(y[at])) == 2:
                agree += np.sign(firth(x[at], y[at], rounds=50)["beta"][1:]) == sign
                done += 1
        return pd.DataFrame({key: str(part[key].iloc[0]), "feature": list(features), "agreement": agree / done if done else np.nan})

    return df.select(key, target, *features).dropna().groupBy(key).applyInPandas(fit, f"{key} string, feature string, agreement double")


def propensity(df: DataFrame, key: str, treatment: str, covariates: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """(key, identity, treatment, covariates, propensity): a penalised logistic model of the treatment in each group."""
    columns = [key, *identity, treatment, *covariates]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields) + ", propensity double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        y = part[treatment].to_numpy(float)
        p = firth(_design(part, covariates), y)["fitted"] if len(np.unique(y)) == 2 else np.full(len(y), y.mean())
        return part.assign(propensity=np.clip(p, 0.01, 0.99))

    return df.select(*columns).dropna(subset=[treatment, *covariates]).groupBy(key).applyInPandas(fit, schema)


def stabilised_weights(df: DataFrame, treatment: str, score: str = "propensity", by: Sequence[str] = (), trim: float = 0.01) -> DataFrame:
    """`df` with weight: share of the treatment over its propensity, clipped at the trim quantiles of the group."""
    w = W.partitionBy(*by)
    share = F.avg(F.col(treatment).cast("double")).over(w)
    raw = df.withColumn("__w", F.when(F.col(treatment) == 1, share / F.col(score)).otherwise((1 - share) / (1 - F.col(score))))
    ends = raw.groupBy(*by).agg(F.expr(f"percentile(__w, {trim})").alias("__lo"), F.expr(f"percentile(__w, {1 - trim})").alias("__hi"))
    both = raw.join(ends, list(by)) if by else raw.join(F.broadcast(ends))
    return both.withColumn("weight", F.greatest("__lo", F.least("__hi", "__w"))).drop("__w", "__lo", "__hi")


def balance(df: DataFrame, treatment: str, covariates: Sequence[str], by: Sequence[str] = (), weight: str = "weight") -> DataFrame:
    """(by, feature, smd_before, smd_after): standardised mean differences between treated and others, plain and weighted."""
    t, o = F.col(treatment) == 1, F.col(treatment) == 0

    def row(c: str) -> Column:
        x, w = F.col(c), F.col(weight)
        sd = F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
        mean = lambda g: F.sum(F.when(g, x * w)) / F.sum(F.when(g, w))
        return F.struct(F.lit(c).alias("feature"), ((F.avg(F.when(t, x)) - F.avg(F.when(o, x))) / sd).alias("smd_before"), ((mean(t) - mean(o)) / sd).alias("smd_after"))

    return df.groupBy(*by).agg(F.array(*[row(c) for c in covariates]).alias("x")).select(*by, F.inline("x"))


def weighted_outcome(df: DataFrame, key: str, target: str, treatment: str, weight: str = "weight") -> DataFrame:
    """Effect of the treatment on the outcome in each group: weighted logistic model with robust errors."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        y, t, w = (part[c].to_numpy(float) for c in (target, treatment, weight))
        if len(np.unique(y)) < 2 or len(np.unique(t)) < 2:
            return pd.DataFrame(columns=[key, "feature", "coef", "se", "p", "low", "high", "n", "converged"])
        x = np.column_stack([np.ones(len(t)), t])
        got = firth(x, y, w, penalised=False)
        se = sandwich(x, w * (y - got["fitted"]), got["covariance"])[1]
        b = got["beta"][1]
        return pd.DataFrame({key: [str(part[key].iloc[0])], "feature": [treatment], "coef": [b], "se": [se], "p": _normal_tail(np.array([b / se if se else np.nan])), "low": [b - 1.96 * se], "high": [b + 1.96 * se], "n": [len(y)], "converged": [bool(got["converged"])]})

    return df.select(key, target, treatment, weight).dropna().groupBy(key).applyInPandas(fit, _MODEL.format(key=key))


def aspect_totals(df: DataFrame, aspects: Sequence[str], out: str = "total_adherence") -> DataFrame:
    """Total adherence of a feature row: mean over patterns of the mean over their aspects, nulls left out."""
    groups: dict[str, list[str]] = {}
    for a in aspects:
        groups.setdefault(a.split("__")[0], []).append(a)
    mean = lambda xs: F.aggregate(F.filter(F.array(*xs), lambda v: v.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
    return df.withColumn(out, mean([mean([F.col(f"`{a}`").cast("double") for a in g]) for g in groups.values()]))
