"""Queries of the analytics over scores, outputs and visits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervallum.functions import stats
from intervallum.functions.exprs import micros
from intervallum.queries.rounding import rounded, six, six_sql
from intervallum.tables import cut, table

EVENTS = ("INFECTION_EVENT", "KETOACIDOSIS_EVENT", "DIALYSIS_EVENT")
COVARIATES = ("age_like", "n_events", "stay_days")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patient_qa_scores")


def adherence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.daily_adherence(_scores(spark, sf_dir)), "day_score").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def adherence_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.type_adherence(_scores(spark, sf_dir))
    return rounded(got.select("patient_id", "pattern_name", "compliance_type", "avg_score", micros("first_start").alias("first_us"), micros("last_end").alias("last_us")), "avg_score")


def adherence_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pattern_adherence(_scores(spark, sf_dir)).select("patient_id", "pattern_name", "avg_score", micros("first_start").alias("first_us")), "avg_score")


def adherence_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.total_adherence(_scores(spark, sf_dir)).select("patient_id", "total_score", micros("first_start").alias("first_us")), "total_score")


def adherence_summary_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.adherence_summary(stats.type_adherence(_scores(spark, sf_dir))), "mean", "sd", "median", "iqr")


def monthly_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.monthly(stats.total_adherence(_scores(spark, sf_dir)))
    return rounded(got, "mean", "sd", "sem", "low", "high").withColumn("month", F.date_format("month", "yyyy-MM-dd"))


def event_day_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.event_day_ratio(_scores(spark, sf_dir), table(spark, sf_dir, "output_patient_data"), EVENTS), "event_ratio")


def _with_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = stats.visit_times(table(spark, sf_dir, "visit_master"))
    return stats.total_adherence(_scores(spark, sf_dir)).join(visits.withColumnRenamed("visit_id", "patient_id"), "patient_id")


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.score_bins(_with_outcome(spark, sf_dir), "total_score", "death_within_30d", 10), "ratio", "avg_score")


def visit_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.visit_times(table(spark, sf_dir, "visit_master"))
    return got.select("visit_id", "person_id", micros("start_datetime").alias("start_us"), "duration_days", "hospital", F.col("death_within_30d").cast("long").alias("death_within_30d"))


def complication_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _labels(spark, sf_dir)
    return got.select("patient_id", "complication", micros("admit_time").alias("admit_us"), micros("cutoff_time").alias("cutoff_us"), F.col("y").cast("long").alias("y"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.complication_labels(table(spark, sf_dir, "output_patient_data"), table(spark, sf_dir, "visit_master"), EVENTS, 48.0)


def windowed_qa_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.window_scores(_labels(spark, sf_dir), _scores(spark, sf_dir))
    return rounded(got.select("patient_id", "complication", "aspect", "avg_score"), "avg_score")


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """One row per visit and complication with a column per aspect: every pattern of the catalogue by every compliance type of the scores."""
    labels = cut(_labels(spark, sf_dir))
    names = [r[0] for r in table(spark, sf_dir, "concept_catalog").where("family = 'pattern'").select("concept_name").dropna().distinct().orderBy("concept_name").collect()]
    types = [r[0] for r in _scores(spark, sf_dir).select("compliance_type").dropna().distinct().orderBy("compliance_type").collect()]
    aspects = [f"{n}__{t}" for n in names for t in types]
    by = stats.window_scores(labels, _scores(spark, sf_dir))
    return cut(stats.feature_table(labels, by, aspects)), aspects


def feature_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit, complication and aspect that is known often enough, with its value (median where unknown)."""
    wide, aspects = _features(spark, sf_dir)
    got = stats.impute(wide, aspects)
    kept = [a for a in aspects if a in got.columns]
    if not kept:
        return got.select("patient_id", "complication", F.lit("").alias("aspect"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("missing")).limit(0)
    each = F.array(*[F.struct(F.lit(a).alias("aspect"), six(F.col(f"`{a}`")).alias("score"), F.col(f"`{a}__missing`").cast("long").alias("missing")) for a in kept])
    return got.select("patient_id", "complication", F.inline(each))


def feature_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the filled-in aspects that vary at all a model keeps: one that correlates too much with an earlier one goes."""
    wide, aspects = _features(spark, sf_dir)
    got = stats.impute(wide, aspects)
    there = sorted(a for a in aspects if a in got.columns)
    spread = got.agg(*[F.var_samp(f"`{a}`").alias(f"v{i}") for i, a in enumerate(there)]).first() if there else ()
    vary = [a for a, v in zip(there, spread) if v is not None and v > 1e-5]
    kept = set(stats.prune_correlated(got, vary))
    return spark.createDataFrame([(a, int(a in kept)) for a in vary], "aspect string, kept long")


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted p-values of a made-up family: one per order, by priority."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    p = F.col("o_totalprice") / 500_000.0
    return rounded(stats.benjamini_hochberg(o.select("o_orderkey", "o_orderpriority", F.when(p <= 1, p).alias("p")), "p", ["o_orderpriority"]), "q").drop("p")


def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.welch(_scores(spark, sf_dir).where("compliance_score between 0 and 1"), "compliance_score", F.col("compliance_type") == "TimeConstraint", ["pattern_name"])
    return rounded(got.where("pattern_name is not null"), "difference", "t", "dof")


def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values and their adjustment."""
    got = stats.welch(_scores(spark, sf_dir).where("compliance_score between 0 and 1 and pattern_name is not null"), "compliance_score", F.col("compliance_type") == "TimeConstraint", ["pattern_name"])
    return stats.benjamini_hochberg(stats.with_p_values(got), "p")


def pearson_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    return rounded(stats.association(l.withColumn("price", F.col("l_extendedprice") / 1000), "l_quantity", "price", ["l_returnflag"]), "r", "slope", "intercept")


def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(stats.correlated_pairs(l, l.columns, 0.0005), "r")


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return stats.top_per_group(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).withColumn("place", F.col("place").cast("long"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.profile(table(spark, sf_dir, "visit_master"), ["visit_id", "duration_days", "death_within_30d", "hospital"])
    return rounded(got, "null_share", "mean", "median")


def period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.compare_periods(_with_outcome(spark, sf_dir), "total_score", "first_start", "2014-01-20 00:00:00", ["hospital"])
    return rounded(got, "mean_before", "mean_after", "difference")


def rows_per_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of output rows of every concept of the catalogue, unused ones with 0."""
    rows = table(spark, sf_dir, "output_patient_data", ["concept_name"]).groupBy("concept_name").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "concept_catalog", ["concept_name"]).join(rows, "concept_name", "left").select("concept_name", F.coalesce("n", F.lit(0)).alias("n_rows"))


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a cohort with a treatment, an outcome and three covariates."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    l = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_discount"]).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    both = o.join(l, o.o_orderkey == l.l_orderkey)
    return both.select(
        "o_orderkey", F.col("o_orderstatus").alias("complication"), (F.col("o_totalprice") > 150_000).cast("int").alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("treated"),
        F.col("n_lines").cast("double").alias("n_lines"), "quantity", "discount",
    )


def iptw_weights_smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance with weights from a propensity that is the share of the treated by number of lines (so that SQL can follow)."""
    c = _cohort(spark, sf_dir)
    share = c.groupBy("n_lines").agg(F.least(F.greatest(F.avg(F.col("treated").cast("double")), F.lit(0.01)), F.lit(0.99)).alias("propensity"))
    w = stats.stabilised_weights(c.join(share, "n_lines"), "treated")
    return rounded(stats.balance(w, "treated", ["n_lines", "quantity", "discount"]), "smd_before", "smd_after")


def firth_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.logistic_by_group(_cohort(spark, sf_dir), "complication", "y", ["n_lines", "quantity", "discount"])


def logistic_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cohort(spark, sf_dir).withColumn("cluster", F.pmod("o_orderkey", F.lit(500)))
    return stats.logistic_by_group(c, "complication", "y", ["n_lines", "quantity", "discount"], penalised=False, cluster="cluster")


def bootstrap_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_stability(_cohort(spark, sf_dir), "complication", "y", ["n_lines", "quantity", "discount"])


def iptw_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.propensity(_cohort(spark, sf_dir), "complication", "treated", ["n_lines", "quantity", "discount"], ["o_orderkey", "y"])
    return stats.benjamini_hochberg(stats.weighted_outcome(stats.stabilised_weights(p, "treated", by=["complication"]), "complication", "y", "treated"), "p")


def robust_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects that keep their sign in each of three groups of a table of effects: discount by return flag and year."""
    l = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"])
    effects = l.groupBy(F.col("l_returnflag").alias("complication"), F.col("l_linenumber").cast("string").alias("feature"), "l_linestatus").agg((F.avg("l_discount") - F.avg("l_tax")).alias("coef"))
    return stats.robust_findings(effects.withColumn("significant", F.abs("coef") > 0.0095), 2)


def aspect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, aspects = _features(spark, sf_dir)
    return rounded(stats.aspect_totals(wide, aspects).select("patient_id", "complication", "total_adherence"), "total_adherence")


QUERIES = {
    f.__name__: f
    for f in (
        adherence_daily, adherence_type, adherence_pattern, adherence_total, adherence_summary_iqr, monthly_ci, event_day_ratio, score_bins, visit_durations, complication_labels, windowed_qa_features, feature_imputation, feature_pruning,
        aspect_totals, bh_fdr, welch_t, welch_p, pearson_ols, correlated_columns, topk_per_group, column_profile, period_compare, rows_per_concept, iptw_weights_smd, firth_logistic, logistic_clustered, bootstrap_signs, iptw_outcome, robust_findings,
    )
}

_D = "d as (select *, cast(start_date_time as date) as day from patient_qa_scores where compliance_score is not null and not isnan(compliance_score) and start_date_time is not null)"
_PAT = f"""{_D}, t1 as (select patient_id, pattern_name, compliance_type, day, avg(compliance_score) as s, min(start_date_time) as a from d group by all), t2 as (select patient_id, pattern_name, day, avg(s) as s, min(a) as a from t1 group by all),
pat as (select patient_id, pattern_name, avg(s) as avg_score, min(a) as first_start from t2 group by all), tot as (select patient_id, avg(avg_score) as total_score, min(first_start) as first_start from pat group by all)"""
_TYP = f"{_D}, t1 as (select patient_id, pattern_name, compliance_type, day, avg(compliance_score) as s, min(start_date_time) as a, max(end_date_time) as b from d group by all), typ as (select patient_id, pattern_name, compliance_type, avg(s) as avg_score, min(a) as first_start, max(b) as last_end from t1 group by all)"
_VIS = "vis as (select visit_id, person_id, start_datetime, end_datetime, coalesce(round(date_diff('second', start_datetime, end_datetime) / 86400.0, 4), case when duration_days <> -1 then duration_days end) as duration_days, hospital, case when death_within_30d <> -1 then death_within_30d end as death_within_30d from visit_master)"
_IN = ", ".join(f"'{e}'" for e in EVENTS)
_LAB = f"""ev as (select patient_id, concept_name as complication, start_date_time from output_patient_data where concept_name in ({_IN}) and start_date_time is not null),
kn as (select ev.*, start_datetime as admit from ev join visit_master on visit_id = patient_id where start_datetime is not null),
se as (select patient_id, complication, bool_or(start_date_time < admit + interval 48 hours) as early, min(case when start_date_time >= admit + interval 48 hours then start_date_time end) as late from kn group by all),
lab as (select v.visit_id as patient_id, c.complication, v.start_datetime as admit, coalesce(late, v.end_datetime) as cutoff, case when late is not null then 1 else 0 end as y from visit_master v cross join (select distinct complication from kn) c
 left join se on se.patient_id = v.visit_id and se.complication = c.complication where not coalesce(early, false))"""
_ASP = f"{_LAB}, {_D}, w1 as (select lab.patient_id, complication, concat_ws('__', pattern_name, compliance_type) as aspect, day, avg(compliance_score) as s from lab join d on lab.patient_id = d.patient_id and start_date_time >= admit and start_date_time < cutoff group by all), asp as (select patient_id, complication, aspect, avg(s) as avg_score from w1 group by all)"
_R = lambda *xs: ", ".join(f"round({x}, 6) as {x}" for x in xs)
_PROFILE = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls, round(count(*) filter (where {c} is null) / count(*), 6) as null_share, count(distinct {c}) as distinct_values, min(try_cast({c} as double)) as least, max(try_cast({c} as double)) as greatest, round(avg(try_cast({c} as double)), 6) as mean, round(quantile_cont(try_cast({c} as double), 0.5), 6) as median from visit_master"
    for c in ("visit_id", "duration_days", "death_within_30d", "hospital")
)
_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]]
_SMD = " union all ".join(
    f"select '{c}' as feature, round((avg({c}) filter (where treated = 1) - avg({c}) filter (where treated = 0)) / coalesce(nullif(stddev_pop({c}), 0), 1), 6) as smd_before, round((sum({c} * w) filter (where treated = 1) / sum(w) filter (where treated = 1) - sum({c} * w) filter (where treated = 0) / sum(w) filter (where treated = 0)) / coalesce(nullif(stddev_pop({c}), 0), 1), 6) as smd_after from f"
    for c in ("n_lines", "quantity", "discount")
)
_NAMES = "nm as (select concept_name as pattern_name from concept_catalog where family = 'pattern')"

SQL = {
    "adherence_daily": f"with {_D} select patient_id, pattern_name, compliance_type, strftime(day, '%Y-%m-%d') as day, round(avg(compliance_score), 6) as day_score from d group by patient_id, pattern_name, compliance_type, d.day",
    "adherence_type": f"with {_TYP} select patient_id, pattern_name, compliance_type, {_R('avg_score')}, epoch_us(first_start) as first_us, epoch_us(last_end) as last_us from typ",
    "adherence_pattern": f"with {_PAT} select patient_id, pattern_name, {_R('avg_score')}, epoch_us(first_start) as first_us from pat",
    "adherence_total": f"with {_PAT} select patient_id, {_R('total_score')}, epoch_us(first_start) as first_us from tot",
    "adherence_summary_iqr": f"with {_TYP} select pattern_name, compliance_type, count(avg_score) as n, round(avg(avg_score), 6) as mean, round(stddev_samp(avg_score), 6) as sd, round(quantile_cont(avg_score, 0.5), 6) as median, round(quantile_cont(avg_score, 0.75) - quantile_cont(avg_score, 0.25), 6) as iqr from typ group by all",
    "monthly_ci": f"with {_PAT}, m as (select date_trunc('month', first_start) as month, avg(total_score) as mean, stddev_samp(total_score) as sd, count(total_score) as n from tot group by all) select strftime(month, '%Y-%m-%d') as month, {_R('mean', 'sd')}, n, round(sd / sqrt(n), 6) as sem, round(mean - 1.96 * sd / sqrt(n), 6) as low, round(mean + 1.96 * sd / sqrt(n), 6) as high from m",
    "event_day_ratio": f"""with {_D}, a as (select patient_id, count(distinct day) as score_days from d group by all), b as (select patient_id, count(distinct cast(start_date_time as date)) as event_days, {", ".join(f"count(*) filter (where concept_name = '{e}') as n_{e.lower()}" for e in EVENTS)} from output_patient_data where concept_name in ({_IN}) group by all)
select a.patient_id, score_days, coalesce(event_days, 0) as event_days, {", ".join(f"coalesce(n_{e.lower()}, 0) as n_{e.lower()}" for e in EVENTS)}, round(coalesce(event_days, 0) / score_days, 6) as event_ratio from a left join b on a.patient_id = b.patient_id""",
    "score_bins": f"with {_PAT}, {_VIS}, r as (select total_score as x, death_within_30d as y from tot join vis on visit_id = patient_id where total_score is not null and death_within_30d is not null), e as (select min(x) as lo, max(x) as hi from r), b as (select greatest(1, least(10, coalesce(ceil((x - lo) / nullif(hi - lo, 0) * 10), 1))) as bin, x, y from r, e) select cast(bin as integer) as bin, count(*) as n, round(avg(y), 6) as ratio, round(avg(x), 6) as avg_score from b group by bin having count(*) >= 30",
    "visit_durations": f"with {_VIS} select visit_id, person_id, epoch_us(start_datetime) as start_us, duration_days, hospital, cast(death_within_30d as bigint) as death_within_30d from vis",
    "complication_labels": f"with {_LAB} select patient_id, complication, epoch_us(admit) as admit_us, epoch_us(cutoff) as cutoff_us, cast(y as bigint) as y from lab",
    "windowed_qa_features": f"with {_ASP} select patient_id, complication, aspect, {_R('avg_score')} from asp",
    "feature_imputation": f"""with {_ASP}, {_NAMES}, kept as (select aspect, median(avg_score) as middle from asp where split_part(aspect, '__', 1) in (select pattern_name from nm) and contains(aspect, '__') group by aspect having 1 - count(*) / (select count(*) from lab) <= 0.95)
select lab.patient_id, lab.complication, kept.aspect, round(coalesce(avg_score, middle), 6) as score, cast(case when avg_score is null then 1 else 0 end as bigint) as missing from lab cross join kept left join asp on asp.patient_id = lab.patient_id and asp.complication = lab.complication and asp.aspect = kept.aspect""",
    "feature_pruning": f"""with {_ASP}, {_NAMES}, known as (select aspect, median(avg_score) as middle from asp where split_part(aspect, '__', 1) in (select pattern_name from nm) and contains(aspect, '__') group by aspect having 1 - count(*) / (select count(*) from lab) <= 0.95),
x as (select lab.patient_id, lab.complication, known.aspect, coalesce(avg_score, middle) as score from lab cross join known left join asp on asp.patient_id = lab.patient_id and asp.complication = lab.complication and asp.aspect = known.aspect),
v as (select aspect from x group by aspect having var_samp(score) > 1e-5), dropped as (select b.aspect from x a join x b on a.patient_id = b.patient_id and a.complication = b.complication and a.aspect < b.aspect
 where a.aspect in (select aspect from v) and b.aspect in (select aspect from v) group by a.aspect, b.aspect having abs(corr(a.score, b.score)) > 0.9)
select aspect, cast(case when aspect in (select aspect from dropped) then 0 else 1 end as bigint) as kept from v""",
    "aspect_totals": f"""with {_ASP}, {_NAMES}, k as (select patient_id, complication, split_part(aspect, '__', 1) as pattern, avg(avg_score) as s from asp where split_part(aspect, '__', 1) in (select pattern_name from nm) and contains(aspect, '__') group by all),
z as (select patient_id, complication, avg(s) as s from k group by all) select lab.patient_id, lab.complication, round(s, 6) as total_adherence from lab left join z on z.patient_id = lab.patient_id and z.complication = lab.complication""",
    "bh_fdr": """with o as (select o_orderkey, o_orderpriority, case when o_totalprice / 500000.0 <= 1 then o_totalprice / 500000.0 end as p from orders),
r as (select *, row_number() over (partition by o_orderpriority order by p) as k, count(*) over (partition by o_orderpriority) as m from o where p is not null),
a as (select *, least(min(p * m / k) over (partition by o_orderpriority order by k desc rows unbounded preceding), 1.0) as q from r)
select o.o_orderkey, o.o_orderpriority, round(q, 6) as q from o left join a on o.o_orderkey = a.o_orderkey""",
    "welch_t": """with g as (select pattern_name, count(compliance_score) filter (where compliance_type = 'TimeConstraint') as n1, count(compliance_score) filter (where compliance_type <> 'TimeConstraint') as n0, avg(compliance_score) filter (where compliance_type = 'TimeConstraint') as m1, avg(compliance_score) filter (where compliance_type <> 'TimeConstraint') as m0,
var_samp(compliance_score) filter (where compliance_type = 'TimeConstraint') as v1, var_samp(compliance_score) filter (where compliance_type <> 'TimeConstraint') as v0 from patient_qa_scores where compliance_score between 0 and 1 and pattern_name is not null group by all)
select pattern_name, n1, n0, round(m1 - m0, 6) as difference, case when n1 > 1 and n0 > 1 then round((m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0), 6) end as t, case when n1 > 1 and n0 > 1 then round(power(v1 / n1 + v0 / n0, 2) / nullif(power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1), 0), 6) end as dof from g""",
    "pearson_ols": "select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice / 1000), 6) as r, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) as intercept from lineitem group by all",
    "correlated_columns": "select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a, b in _PAIRS) + ") where abs(r) > 0.0005",
    "topk_per_group": "select o_orderkey, o_orderpriority, o_totalprice, place from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) where place <= 5".replace("select *,", "select o_orderkey, o_orderpriority, o_totalprice,"),
    "column_profile": _PROFILE,
    "period_compare": f"""with {_PAT}, {_VIS}, x as (select hospital, total_score, first_start < timestamp '2014-01-20 00:00:00' as b from tot join vis on visit_id = patient_id where first_start is not null),
g as (select hospital, count(total_score) filter (where b) as n_before, avg(total_score) filter (where b) as mean_before, count(total_score) filter (where not b) as n_after, avg(total_score) filter (where not b) as mean_after from x group by all)
select hospital, n_before, {_R("mean_before")}, n_after, {_R("mean_after")}, round(mean_after - mean_before, 6) as difference from g""".replace("round(mean_after - mean_before", "round(g.mean_after - g.mean_before"),
    "rows_per_concept": "select c.concept_name, count(o.concept_name) as n_rows from concept_catalog c left join output_patient_data o on o.concept_name = c.concept_name group by all",
    "iptw_weights_smd": f"""with c as (select o_orderkey, case when o_orderpriority < '3' then 1 else 0 end as treated, cast(n as double) as n_lines, quantity, discount from orders join (select l_orderkey, count(*) as n, avg(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by all) on l_orderkey = o_orderkey),
s as (select n_lines, least(greatest(avg(treated), 0.01), 0.99) as ps from c group by all), t as (select avg(treated) as share from c),
r as (select c.*, case when treated = 1 then share / ps else (1 - share) / (1 - ps) end as w0 from c join s on c.n_lines = s.n_lines, t), q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from r),
f as (select treated, n_lines, quantity, discount, greatest(lo, least(hi, w0)) as w from r, q) {_SMD}""",
    "robust_findings": """with e as (select l_returnflag as complication, cast(l_linenumber as varchar) as feature, l_linestatus, avg(l_discount) - avg(l_tax) as coef from lineitem group by all)
select complication, feature, count(*) >= 2 and bool_and(abs(coef) > 0.0095) and min(sign(coef)) = max(sign(coef)) and min(sign(coef)) <> 0 as robust from e group by all""",
}
SQL = {k: six_sql(v) for k, v in SQL.items()}
