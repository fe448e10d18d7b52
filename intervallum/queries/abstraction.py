"""Queries of the definition families over the event, line item and input tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervallum.functions.exprs import micros
from intervallum.operators import families
from intervallum.plans import model as M
from intervallum.plans.engine import Abstraction, output_rows, score_rows
from intervallum.plans.knowledge import KnowledgeBase
from intervallum.queries.rounding import six, six_sql
from intervallum.sources import records as R
from intervallum.tables import table

H, D = 3600.0, 86_400.0


def _src(name: str, ref: str = "", tak: str = "raw-concept") -> M.Source:
    return M.Source(name, tak, 0, ref)


def _raw(name: str, low: float = 0, high: float = 1000) -> M.RawConcept:
    return M.RawConcept(name.upper(), concept_type="raw-numeric", attributes=(M.Attribute(name, "numeric", M.Bound(None, low, high)),))


def _if(ref: str, low: float | None = None, high: float | None = None, equal: str | None = None, idx: int = 0) -> M.Condition:
    return M.Condition(ref, (M.Bound(equal, low, high),), idx)


_BANDS = tuple(M.Rule(v, (M.Condition("", (M.Bound(None, a, b),), 0),), "and") for v, a, b in (("Low", None, 20.0), ("Mid", 20.0, 60.0), ("High", 60.0, None)))
_VIEW, _BUY, _CLICK, _ERROR = _src("VIEW", "A1"), _src("PURCHASE", "E1"), _src("CLICK", "B1"), _src("ERROR", "I1")
_FULL = (M.Condition("C1", (M.Bound("True"),)),)

#: Definitions over the event table: a user is a patient, an event type a concept.
KB = KnowledgeBase(
    [
        _raw("view"), _raw("purchase"), _raw("error"), _raw("click"), _raw("signup"),
        M.RawConcept("PURCHASE_RANGE", concept_type="raw-numeric", attributes=(M.Attribute("purchase", "numeric", M.Bound(None, 10, 60)),)),
        M.RawConcept("ACTIVITY", concept_type="raw-boolean", attributes=(M.Attribute("click", "boolean"), M.Attribute("view", "boolean"))),
        M.ParameterizedConcept("PURCHASE_RATIO", parent=_BUY, parameters=(M.Parameter("PURCHASE", "raw-concept", "P1", how="before", dynamic=True),), calls=(M.Call("div", 0, ("P1",)),)),
        M.ParameterizedConcept("PURCHASE_BASE", parent=_BUY, parameters=(M.Parameter("PURCHASE", "raw-concept", "P1", how="before", dynamic=False),), calls=(M.Call("div", 0, ("P1",)),)),
        M.ParameterizedConcept("ERROR_VS_VIEW", parent=_ERROR, parameters=(M.Parameter("VIEW", "raw-concept", "P1", dynamic=True, good_before=6 * H, good_after=3 * H),), calls=(M.Call("subtract", 0, ("P1",)),)),
        M.ParameterizedConcept("CLICK_SHIFT", parent=_CLICK, parameters=(M.Parameter("SIGNUP", "raw-concept", "P1", default="50"),), calls=(M.Call("add", 0, ("P1",)),)),
        M.ParameterizedConcept("CLICK_AFTER", parent=_CLICK, parameters=(M.Parameter("SIGNUP", "raw-concept", "P1"),), calls=(M.Call("add", 0, ("P1",)),)),
        M.ParameterizedConcept("VIEW_GATED", parent=_VIEW, parameters=(M.Parameter("VIEW", "raw-concept", "P1", how="before", dynamic=True),), calls=(M.Call("id_if_thresh_met", 0, ("P1",), ("40", "ge")),)),
        M.Event("BIG_EVENT", derived=(_src("PURCHASE", "A1"), _src("ERROR", "A2")), rules=(M.Rule("Huge", (_if("A1", 100), _if("A2", 120))), M.Rule("Big", (_if("A1", 40, 100), _if("A2", 60))), M.Rule("Tiny", (_if("A1", 1), _if("A1", None, 5)), "and"))),
        M.State("VIEW_STATE", parent=_VIEW, good_after=3 * D, rules=_BANDS),
        M.State("VIEW_STATE_SMOOTH", parent=_VIEW, good_after=7 * D, interpolate=True, max_skip=1, rules=_BANDS),
        M.State("EVENT_STATE", parent=_src("BIG_EVENT", tak="event"), good_after=2 * D),
        M.Trend("CLICK_TREND", parent=_CLICK, significant=20, time_steady=2 * D, good_after=3 * D),
        M.Context("ERROR_CONTEXT", derived=(_src("ERROR", "A1"),), rules=(M.Rule("True", (_if("A1", 30),)),), windows={None: M.Window(2 * H, 36 * H)}),
        M.Context("ERROR_CLIPPED", derived=(_src("ERROR", "A1"),), rules=(M.Rule("True", (_if("A1", 30),)),), windows={None: M.Window(2 * H, 36 * H)}, clippers=(M.Clipper("PURCHASE", "raw-concept", H, 0.5 * H), M.Clipper("CLICK", "raw-concept", None, 0.25 * H))),
        M.Context("VIEW_CONTEXT", derived=(_src("VIEW", "A1"),), rules=(M.Rule("Seen", (_if("A1", 10, 80),)), M.Rule("Watched", (_if("A1", 80),))), windows={"Seen": M.Window(6 * H, 24 * H), None: M.Window(0, 48 * H)}),
        M.LocalPattern("BUY_AFTER_VIEW", derived=(_VIEW, _BUY), rules=(M.LocalRule("before", (_if("A1", 20),), (_if("E1", 0),), None, "first", 0.0, 72 * H, time=M.Compliance(M.Trapezoid(0, 0, 24 * H, 72 * H, True))),)),
        M.LocalPattern("LAST_VIEW_BUY", derived=(_VIEW, _BUY), ignore_unfulfilled=True, rules=(M.LocalRule("before", (_if("A1", 0),), (_if("E1", 0),), "last", "last", H, 48 * H),)),
        M.LocalPattern("SEEN_IN_ERROR", derived=(_src("ERROR_CONTEXT", "A1", "context"), _src("VIEW_CONTEXT", "E1", "context")), rules=(M.LocalRule("overlap", (_if("A1", equal="True"),), (_if("E1", equal="Seen"),), existence=True),)),
        M.LocalPattern("BUY_VALUE", derived=(_VIEW, _BUY), parameters=(M.Parameter("CLICK", "raw-concept", "P1", default="1.5"),), rules=(M.LocalRule("before", (_if("A1", 20),), (_if("E1", 0),), max_distance=72 * H, value=M.Compliance(M.Trapezoid(0, 0.5, 2, 8), "mul", ("P1",), ("A1", "E1"))),)),
        M.LocalPattern("BUY_IN_ANY", derived=(_VIEW, _BUY, _src("ERROR_CONTEXT", "C1", "context"), _src("VIEW_CONTEXT", "C2", "context")), rules=(M.LocalRule("before", (_if("A1", 0),), (_if("E1", 0),), max_distance=72 * H, gate=M.Gate((_FULL[0], _if("C2", equal="Watched")), "or")),)),
        M.LocalPattern("BUY_IN_BOTH", derived=(_VIEW, _BUY, _src("ERROR_CONTEXT", "C1", "context"), _src("VIEW_CONTEXT", "C2", "context")), rules=(M.LocalRule("before", (_if("A1", 0),), (_if("E1", 0),), max_distance=72 * H, gate=M.Gate((_FULL[0], _if("C2", equal="Seen")), "and")),)),
        M.LocalPattern("BUY_RULES", derived=(_CLICK, _VIEW, _BUY), rules=(M.LocalRule("before", (_if("B1", 30),), (_if("E1", 0),), max_distance=24 * H), M.LocalRule("before", (_if("A1", 30), _if("B1", 0)), (_if("E1", 0),), max_distance=72 * H, time=M.Compliance(M.Trapezoid(0, H, 48 * H, 72 * H, True))))),
        M.GlobalPattern("DAILY_VIEWS", derived=(_src("SIGNUP", "I1"), _VIEW), rules=(M.CyclicRule(0, 20 * D, D, 1, 10, (_if("A1", 0),), (_if("I1", 0),), cyclic=M.Compliance(M.Trapezoid(0, 1, 3, 10))),)),
        M.GlobalPattern("CLICK_VALUES", derived=(_CLICK, _src("VIEW_CONTEXT", "C2", "context")), rules=(M.CyclicRule(0, 28 * D, 2 * D, 1, 3, (_if("B1", 0),), gate=M.Gate((_if("C2", equal="Seen"),)), value=M.Compliance(M.Trapezoid(0, 10, 60, 300), targets=("B1",))),)),
        M.GlobalPattern("BUYS_AFTER_ERRORS", derived=(_src("ERROR", "I1"), _BUY, _src("SIGNUP", "S1")), rules=(M.CyclicRule(0, 5 * D, D, 1, 5, (_if("E1", 0),), (_if("I1", 40),), (_if("S1", 60),), cyclic=M.Compliance(M.Trapezoid(0, 1, 2, 5))),)),
    ],
)
CLIPPED_KB = KnowledgeBase([KB.by_name[n] for n in ("VIEW", "SIGNUP", "PURCHASE", "VIEW_STATE")], (M.GlobalClipper("signup", "START"), M.GlobalClipper("purchase", "END")))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as records: one second long, the event's id as ordinal."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 second")).alias("end"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("ord"))


def run(spark: SparkSession, sf_dir: str) -> Abstraction:
    return Abstraction(event_records(spark, sf_dir), KB)


def number_rows(df: DataFrame) -> DataFrame:
    return df.select("patient_id", "ord", micros("start").alias("start_us"), six(F.get("value", F.lit(0)).cast("double")).alias("x"))


def label_rows(df: DataFrame) -> DataFrame:
    return df.select("patient_id", micros("start").alias("start_us"), micros("end").alias("end_us"), F.get("value", F.lit(0)).alias("label"))


def scored_rows(df: DataFrame) -> DataFrame:
    return df.select("patient_id", micros("start").alias("start_us"), F.get("value", F.lit(0)).alias("label"), *[six(c).alias(c) for c in ("time_score", "value_score", "cyclic_score")])


def _query(name: str, show) -> object:
    return lambda spark, sf_dir: show(run(spark, sf_dir)[name])


def tuple_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records: supplier, return flag, ship date, quantity."""
    l = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate"])
    at = F.col("l_shipdate").cast("timestamp_ntz")
    return l.select(F.col("l_suppkey").alias("patient_id"), F.col("l_returnflag").alias("concept"), at.alias("start"), (at + F.expr("interval 1 second")).alias("end"), F.col("l_quantity").cast("string").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def _tuple(require_all: bool):
    d = M.RawConcept("FLAGS", concept_type="raw", attributes=tuple(M.Attribute(a, "numeric", M.Bound(None, 0, 45)) for a in ("A", "N", "R")), order=("A", "N", "R"), require_all=require_all)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = families.raw_concept(d, tuple_records(spark, sf_dir))
        return t.select("patient_id", micros("start").alias("start_us"), *[F.get("value", F.lit(i)).cast("double").alias(c) for i, c in enumerate("anr")])

    return query


def flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over line items, where many rows of one source share an instant."""
    attribute = lambda a: M.RawConcept(f"FLAG_{a}", concept_type="raw-numeric", attributes=(M.Attribute(a, "numeric", M.Bound(None, 0, 100)),))
    d = M.Event("FLAG_EVENT", derived=(_src("FLAG_A", "A"), _src("FLAG_R", "R")), rules=(M.Rule("High", (_if("A", 40), _if("R", 45))), M.Rule("Low", (_if("A", None, 10), _if("R", None, 5)))))
    kb = KnowledgeBase([attribute("A"), attribute("R"), d])
    return Abstraction(tuple_records(spark, sf_dir), kb)["FLAG_EVENT"].select("patient_id", "ord", micros("start").alias("start_us"), F.get("value", F.lit(0)).alias("label"))


def nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of high priority by customer."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = o.select(F.col("o_custkey").alias("patient_id"), F.lit("priority").alias("concept"), at.alias("start"), at.alias("end"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord"))
    d = M.RawConcept("PRIORITY", concept_type="raw-nominal", attributes=(M.Attribute("priority", "nominal", values=("1-URGENT", "2-HIGH")),))
    return families.raw_concept(d, rows).select("patient_id", "ord", micros("start").alias("start_us"), F.get("value", F.lit(0)).alias("label"))


def trend_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.trend_points(KB.by_name["CLICK_TREND"], run(spark, sf_dir)["CLICK"]).select("patient_id", "ord", six(F.col("slope") * 86_400).alias("slope_per_day"), "label")


def window_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_rows(families.context_windows(KB.by_name["VIEW_CONTEXT"], run(spark, sf_dir)["VIEW"]))


def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = run(spark, sf_dir)
    both = families.intersect(a["ERROR_CONTEXT"], a["VIEW_CONTEXT"])
    return both.select("patient_id", micros("start").alias("start_us"), micros("end").alias("end_us"))


def global_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_rows(Abstraction(event_records(spark, sf_dir), CLIPPED_KB)["VIEW_STATE"])


def qa_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = run(spark, sf_dir)
    rows = a["BUY_AFTER_VIEW"].unionByName(a["BUY_VALUE"]).unionByName(a["DAILY_VIEWS"])
    return score_rows(rows).select("patient_id", "pattern_name", micros("start_date_time").alias("start_us"), "compliance_type", six("compliance_score").alias("compliance_score"))


def output_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output table's form of events with several sources at one instant: the first of each key."""
    attribute = lambda a: M.RawConcept(f"FLAG_{a}", concept_type="raw-numeric", attributes=(M.Attribute(a, "numeric", M.Bound(None, 0, 100)),))
    d = M.Event("FLAG_EVENT", derived=(_src("FLAG_A", "A"), _src("FLAG_R", "R")), rules=(M.Rule("High", (_if("A", 40), _if("R", 45))), M.Rule("Low", (_if("A", None, 10), _if("R", None, 5)))))
    rows = output_rows(Abstraction(tuple_records(spark, sf_dir), KnowledgeBase([attribute("A"), attribute("R"), d]))["FLAG_EVENT"])
    return rows.select("patient_id", "concept_name", micros("start_date_time").alias("start_us"), "value", "abstraction_type")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.concept_name for r in table(spark, sf_dir, "concept_catalog", ["concept_name"]).collect()]
    return R.coverage(table(spark, sf_dir, "input_patient_data", ["concept_name"]), names)


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table_stats({n: table(spark, sf_dir, n, ["patient_id"]) for n in ("input_patient_data", "output_patient_data", "patient_qa_scores")})


def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "visit_master", ["visit_id"]).withColumnRenamed("visit_id", "patient_id")
    return R.id_coverage({"input": table(spark, sf_dir, "input_patient_data", ["patient_id"]), "output": table(spark, sf_dir, "output_patient_data", ["patient_id"]), "visits": visits})


def first_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each (patient, concept, start) of the input table, in order of arrival."""
    rows = table(spark, sf_dir, "input_patient_data", ["row_id", "patient_id", "concept_name", "start_date_time", "value"])
    return R.first_rows(rows, ["patient_id", "concept_name", "start_date_time"], ["row_id"]).select("row_id", "patient_id", "concept_name", micros("start_date_time").alias("start_us"), "value")


def glucose_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of glucose over the input table's readings, as a state with a window of one day: the flagship query."""
    bands = (("Low", None, 70.0), ("Normal", 70.0, 180.0), ("High", 180.0, None))
    rules = tuple(M.Rule(v, (M.Condition("", (M.Bound(None, a, b),), 0),), "and") for v, a, b in bands)
    kb = KnowledgeBase([M.RawConcept("GLUCOSE", concept_type="raw-numeric", attributes=(M.Attribute("GLUCOSE_MEASURE", "numeric", M.Bound(None, 10, 1500)),)), M.State("GLUCOSE_STATE", parent=_src("GLUCOSE"), good_after=D, rules=rules)])
    rows = table(spark, sf_dir, "input_patient_data", ["row_id", "patient_id", "concept_name", "start_date_time", "value"])
    records = rows.select("patient_id", F.col("concept_name").alias("concept"), F.col("start_date_time").alias("start"), F.col("start_date_time").alias("end"), "value", F.col("row_id").alias("ord")).dropna(subset=["patient_id", "start"])
    return label_rows(Abstraction(records, kb)["GLUCOSE_STATE"])


QUERIES = {
    "raw_numeric_filter": _query("PURCHASE_RANGE", number_rows),
    "raw_nominal_filter": nominal,
    "raw_boolean_presence": _query("ACTIVITY", label_rows),
    "raw_tuple_merge": _tuple(False),
    "raw_tuple_merge_require_all": _tuple(True),
    "param_prev_ratio": _query("PURCHASE_RATIO", number_rows),
    "param_baseline_ratio": _query("PURCHASE_BASE", number_rows),
    "param_nearest_tolerance": _query("ERROR_VS_VIEW", number_rows),
    "param_static_default": _query("CLICK_SHIFT", number_rows),
    "param_static_pivot": _query("CLICK_AFTER", number_rows),
    "param_gate_threshold": _query("VIEW_GATED", number_rows),
    "event_rules_or": _query("BIG_EVENT", lambda df: df.select("patient_id", "ord", micros("start").alias("start_us"), F.get("value", F.lit(0)).alias("label"))),
    "event_multi_source_dedupe": flag_events,
    "state_merge": _query("VIEW_STATE", label_rows),
    "state_merge_interpolate": _query("VIEW_STATE_SMOOTH", label_rows),
    "state_from_event": _query("EVENT_STATE", label_rows),
    "state_glucose": glucose_abstraction,
    "trend_slope_label": trend_slopes,
    "trend_intervals": _query("CLICK_TREND", label_rows),
    "context_window": window_only,
    "context_self_clip": _query("VIEW_CONTEXT", label_rows),
    "context_clippers": _query("ERROR_CLIPPED", label_rows),
    "context_intersection": intersection,
    "global_clip": global_clip,
    "local_before_time_score": _query("BUY_AFTER_VIEW", scored_rows),
    "local_before_greedy_last": _query("LAST_VIEW_BUY", scored_rows),
    "local_overlap_existence": _query("SEEN_IN_ERROR", scored_rows),
    "local_value_score_min": _query("BUY_VALUE", scored_rows),
    "local_context_gate_or": _query("BUY_IN_ANY", scored_rows),
    "local_context_gate_and": _query("BUY_IN_BOTH", scored_rows),
    "local_two_rules": _query("BUY_RULES", scored_rows),
    "cyclic_windows_count": _query("DAILY_VIEWS", scored_rows),
    "cyclic_value_score": _query("CLICK_VALUES", scored_rows),
    "cyclic_clipper_initiator": _query("BUYS_AFTER_ERRORS", scored_rows),
    "qa_melt": qa_melt,
    "output_dedupe_first": output_first,
    "input_dedupe_first": first_loaded,
    "coverage_check": coverage,
    "table_stats": table_stats,
    "id_coverage": id_coverage,
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_E = "e as (select user_id as p, event_type as c, epoch_us(ts) as t, value as v, event_id as o from events)"
_US = 1_000_000
_HU, _DU = 3600 * _US, 86_400 * _US
_FLAGS = "l as (select l_suppkey as p, l_returnflag as c, epoch_us(l_shipdate) as t, l_quantity as v, l_orderkey * 10 + l_linenumber as o from lineitem)"


def _tuple_sql(having: str) -> str:
    each = ", ".join(f"max_by(v, o) filter (where c = '{a}') as {a.lower()}" for a in "ANR")
    return f"with {_FLAGS} select p as patient_id, t as start_us, {each} from l where v between 0 and 45 and c in ('A', 'N', 'R') group by p, t {having}"


def _state_sql(source: str, reach: int, smooth: bool) -> str:
    """source: a query of (p, t, o, label)."""
    swallow = f"(s.label <> r.label and s.t <= r.anchor + {reach} and s.nl = r.label and s.nt <= r.anchor + {reach})" if smooth else "false"
    join = f"(s.label = r.label and s.t <= r.anchor + {reach})"
    return f"""s0 as ({source}), s as (select *, row_number() over w as n, lead(label) over w as nl, lead(t) over w as nt from s0 window w as (partition by p order by t, o)),
r as (select p, n, t as anchor, t as last, label, o from s where n = 1
 union all select s.p, s.n, case when {join} or {swallow} then r.anchor else s.t end, case when {swallow} then r.last else s.t end,
 case when {join} or {swallow} then r.label else s.label end, case when {join} or {swallow} then r.o else s.o end from r join s on s.p = r.p and s.n = r.n + 1),
g as (select p, o, any_value(label) as label, min(anchor) as a, max(last) as z from r group by p, o),
f as (select p as patient_id, a as start_us, least(z + {reach}, lead(a) over (partition by p order by a, o)) as end_us, label from g)
"""


def _band(v: str = "v") -> str:
    return f"case when {v} < 20 then 'Low' when {v} < 60 then 'Mid' else 'High' end"


_TREND = f"""with recursive {_E}, k as (select p, o, t, v - first_value(v) over w as y, floor((t - first_value(t) over w) / {_US}.0) as x from e where c = 'click' window w as (partition by p order by t, o)),
m as (select *, regr_sxx(y, x) over w as sxx, count(*) over w as n, regr_slope(y, x) over w as b from k window w as (partition by p order by t range between {2 * _DU} preceding and current row)),
q as (select p, o, t, case when n >= 2 and sxx > 1e-10 then b else 0 end as slope from m),
c as (select *, case when round(slope * 172800, 9) >= 20 then 'Increasing' when round(slope * 172800, 9) <= -20 then 'Decreasing' else 'Steady' end as label from q)
"""
_ERRORS = f"x1 as (select p, o, t - {2 * _HU} as s, t + {_US} + {36 * _HU} as z from e where c = 'error' and v >= 30), x2 as (select p, o, s, least(z, lead(s) over (partition by p order by s, o)) as z from x1), xe as (select * from x2 where s < z)"
_VIEWS = f"""y1 as (select p, o, case when v between 10 and 80 then 'Seen' when v >= 80 then 'Watched' end as label, t from e where c = 'view'),
y2 as (select p, o, label, t - case when label = 'Seen' then {6 * _HU} else 0 end as s, t + {_US} + case when label = 'Seen' then {24 * _HU} else {48 * _HU} end as z from y1 where label is not null),
y3 as (select p, o, label, s, least(z, lead(s) over (partition by p order by s, o)) as z from y2), xv as (select * from y3 where s < z)"""


def _trap(x: str, a: str, b: str, c: str, d: str, missing: str = "0.0") -> str:
    return f"(case when {x} is null then null when {x} < {a} or {x} > {d} then {missing} when {x} >= {b} and {x} <= {c} then 1.0 when {x} < {b} then ({x} - {a}) / ({b} - {a}) else ({d} - {x}) / ({d} - {c}) end)"


def _mean(*xs: str) -> str:
    listed = ", ".join(f"cast({x} as double)" for x in xs)
    return f"coalesce(list_avg(list_filter([{listed}], lambda z: z is not null)), 1.0)"


def _label(score: str) -> str:
    return f"case when {score} >= 1 then 'True' when {score} > 0 then 'Partial' else 'False' end"


def _local_sql(with_: str, rules: list[dict], keep_open: bool = True) -> str:
    """Greedy matching in SQL. rule: anchor, event (queries of p, id, s, z, o, v), on, time, value, miss_time, miss_value, turn."""
    pairs, anchors = [], []
    for k, r in enumerate(rules):
        turn_a, turn_e = r.get("turn", ("", ""))
        gate = r.get("gate", "true")
        anchors.append(f"select {k} as rule, a.p, a.id, a.s, a.o, cast({r.get('miss_time', 'null')} as double) as ts, cast({r.get('miss_value', 'null')} as double) as vs from ({r['anchor']}) a where {gate}")
        pairs.append(
            f"select {k} as rule, a.p, a.id as a, b.id as b, {turn_a}a.s as ak, a.o as ao, {turn_e}b.s as bk, b.o as bo, a.s as a_s, b.s as b_s, b.z as b_z, cast({r.get('time', 'null')} as double) as ts, cast({r.get('value', 'null')} as double) as vs "
            f"from ({r['anchor']}) a join ({r['event']}) b on a.p = b.p and {r['on']} {r.get('join', '')} where {gate}"
        )
    fit = _mean("ts", "vs")
    scored = any("miss_time" in r or "miss_value" in r for r in rules)
    open_ = f"""union all select p, s, {_label(fit) if scored else "'False'"}, ts, vs from (select *, row_number() over (partition by p, id order by rule) as k from anchors a
 where not exists (select 1 from kept q where q.p = a.p and q.a = a.id and q.rule <= a.rule)) f where k = 1 and not exists (select 1 from kept q where q.p = f.p and q.a_s <= f.s and f.s < q.b_z)"""
    return f"""with recursive {with_}, anchors as ({" union all ".join(anchors)}), pairs0 as ({" union all ".join(pairs)}),
pairs as (select *, row_number() over (partition by p order by rule, ak, ao, bk, bo) as n from pairs0),
r as (select p, n, true as took, [a] as ua, [b] as ub from pairs where n = 1
 union all select q.p, q.n, not list_contains(r.ua, q.a) and not list_contains(r.ub, q.b), case when list_contains(r.ua, q.a) or list_contains(r.ub, q.b) then r.ua else list_append(r.ua, q.a) end,
 case when list_contains(r.ua, q.a) or list_contains(r.ub, q.b) then r.ub else list_append(r.ub, q.b) end from r join pairs q on q.p = r.p and q.n = r.n + 1),
kept as (select pairs.* from pairs join r on pairs.p = r.p and pairs.n = r.n where took)
select p as patient_id, s as start_us, label, round(ts, 6) as time_score, round(vs, 6) as value_score, cast(null as double) as cyclic_score from (
select p, b_s as s, {_label(fit)} as label, ts, vs from kept {open_ if keep_open else ""})"""


def _pts(c: str, where: str = "true") -> str:
    return f"select p, '{c}' || o as id, t as s, t + {_US} as z, o, v from e where c = '{c}' and {where}"


def _before(low: int, high: int) -> str:
    return f"b.s > a.z and b.s - a.z >= {low} and b.s - a.z <= {high}"


_GAP = f"(b.s - a.z) / {_US}.0"
_CLICKS = "cp as (select p, arg_min(v, (t, o)) as w from e where c = 'click' group by p)"
_MUL = lambda x: _trap(x, "(0.0 * w)", "(0.5 * w)", "(2.0 * w)", "(8.0 * w)", "0.0")


def _value_min() -> str:
    w = "(select coalesce(max(cp.w), 1.5) from cp where cp.p = a.p)"
    one = lambda x: _trap(x, "0.0", f"(0.5 * {w})", f"(2.0 * {w})", f"(8.0 * {w})", "0.0")
    ordered = f"({w} >= 0)"
    return f"(case when {ordered} then least({one('a.v')}, {one('b.v')}) else 0.0 end)"


def _cyclic_sql(with_: str, episodes: str, events: str, window: int, gate: str, cyclic: str, met: str, x_score: str) -> str:
    """episodes: (p, init, a, z); events: (p, t, id, v)."""
    return f"""with {with_}, ep as ({episodes}), w0 as (select p, init, unnest(generate_series(a, z - {window}, {window})) as ws from ep where z - a >= {window}),
w1 as (select * from w0 where {gate}), own as (select * from (select *, row_number() over (partition by p, ws order by init) as k from w1) where k = 1),
h as (select b.p, b.id, b.v, own.ws, own.init, row_number() over (partition by b.p, b.id order by own.init, own.ws) as k from ({events}) b join own on own.p = b.p and b.t >= own.ws and b.t < own.ws + {window}),
n as (select p, ws, count(*) as n, avg({x_score}) as s from h where k = 1 group by p, ws),
f as (select own.p, own.ws, coalesce(n.n, 0) as n, n.s from own left join n on own.p = n.p and own.ws = n.ws)
select p as patient_id, ws + {window} as start_us, {_label(_mean(cyclic, "coalesce(s, 0.0)" if x_score != "null" else "null", met))} as label, cast(null as double) as time_score, {"round(coalesce(s, 0.0), 6)" if x_score != "null" else "cast(null as double)"} as value_score, round(cast({cyclic} as double), 6) as cyclic_score from f"""


_LOCALS = {
    "local_before_time_score": (_E, [{"anchor": _pts("view", "v between 20 and 1000"), "event": _pts("purchase"), "on": _before(0, 72 * _HU), "time": _trap(_GAP, "0", "0", "86400", "259200.0"), "miss_time": "0.0"}], True),
    "local_before_greedy_last": (_E, [{"anchor": _pts("view"), "event": _pts("purchase"), "on": _before(_HU, 48 * _HU), "turn": ("-", "-")}], False),
    "local_overlap_existence": (
        f"{_E}, {_ERRORS}, {_VIEWS}",
        [{"anchor": "select p, 'x' || o as id, s, z, o, 0 as v from xe", "event": "select p, 'y' || o as id, s, z, o, 0 as v from xv where label = 'Seen'", "on": "a.s <= b.z and b.s <= a.z", "time": "1.0", "miss_time": "0.0"}],
        True,
    ),
    "local_value_score_min": (f"{_E}, {_CLICKS}", [{"anchor": _pts("view", "v >= 20"), "event": _pts("purchase"), "on": _before(0, 72 * _HU), "value": _value_min(), "miss_value": "0.0"}], True),
    "local_context_gate_or": (
        f"{_E}, {_ERRORS}, {_VIEWS}, g as (select p, s, z from xe union all select p, s, z from xv where label = 'Watched')",
        [{"anchor": _pts("view"), "event": _pts("purchase"), "on": _before(0, 72 * _HU), "gate": "exists (select 1 from g where g.p = a.p and g.s <= a.z and a.s <= g.z)"}],
        True,
    ),
    "local_context_gate_and": (
        f"{_E}, {_ERRORS}, {_VIEWS}, g as (select xe.p, greatest(xe.s, xv.s) as s, least(xe.z, xv.z) as z from xe join xv on xe.p = xv.p and xv.label = 'Seen' and xe.s <= xv.z and xv.s <= xe.z)",
        [{"anchor": _pts("view"), "event": _pts("purchase"), "on": _before(0, 72 * _HU), "gate": "exists (select 1 from g where g.p = a.p and g.s <= a.z and a.s <= g.z)"}],
        True,
    ),
    "local_two_rules": (
        _E,
        [
            {"anchor": _pts("click", "v >= 30"), "event": _pts("purchase"), "on": _before(0, 24 * _HU)},
            {"anchor": f"{_pts('view', 'v >= 30')} union all {_pts('click')}", "event": _pts("purchase"), "on": _before(0, 72 * _HU), "time": _trap(_GAP, "0", "3600", "172800", "259200.0"), "miss_time": "0.0"},
        ],
        True,
    ),
}

SQL = {
    "raw_numeric_filter": f"with {_E} select p as patient_id, o as ord, t as start_us, round(v, 6) as x from e where c = 'purchase' and v between 10 and 60",
    "raw_nominal_filter": "select o_custkey as patient_id, o_orderkey as ord, epoch_us(o_orderdate) as start_us, o_orderpriority as label from orders where o_orderpriority in ('1-URGENT', '2-HIGH')",
    "raw_boolean_presence": f"with {_E} select p as patient_id, t as start_us, t + {_US} as end_us, 'True' as label from e where c in ('click', 'view')",
    "raw_tuple_merge": _tuple_sql(""),
    "raw_tuple_merge_require_all": _tuple_sql("having a is not null and n is not null and r is not null"),
    "param_prev_ratio": f"with {_E}, k as (select *, last_value(v) over (partition by p order by t range between unbounded preceding and 1 preceding) as w from e where c = 'purchase') select p as patient_id, o as ord, t as start_us, round(v / w, 6) as x from k where w is not null and w <> 0",
    "param_baseline_ratio": f"with {_E}, k as (select *, first_value(v) over w as b, row_number() over w as n from e where c = 'purchase' window w as (partition by p order by t, o)) select p as patient_id, o as ord, t as start_us, round(v / b, 6) as x from k where n > 1 and b <> 0",
    "param_nearest_tolerance": f"""with {_E}, m as (select a.p, a.o, a.t, a.v, b.v as w, row_number() over (partition by a.p, a.o order by abs(a.t - b.t), b.t, b.o) as n from e a join e b on a.c = 'error' and b.c = 'view' and a.p = b.p and b.t >= a.t - {6 * _HU} and b.t <= a.t + {3 * _HU})
select p as patient_id, o as ord, t as start_us, round(v - w, 6) as x from m where n = 1""",
    "param_static_default": f"""with {_E}, f as (select p, min(t) as t0 from e where c = 'click' group by p), s as (select f.p, arg_min(e.v, (abs(e.t - t0), e.t, e.o)) as w from f join e on e.p = f.p and e.c = 'signup' group by f.p)
select e.p as patient_id, o as ord, t as start_us, round(v + coalesce(w, 50), 6) as x from e left join s on e.p = s.p where c = 'click'""",
    "param_static_pivot": f"""with {_E}, g as (select p, min(t) as t1 from e where c = 'signup' group by p), k as (select e.* from e join g on e.p = g.p where c = 'click' and t > t1), f as (select p, min(t) as t0 from k group by p),
s as (select f.p, arg_min(e.v, (abs(e.t - t0), e.t, e.o)) as w from f join e on e.p = f.p and e.c = 'signup' group by f.p)
select k.p as patient_id, o as ord, t as start_us, round(v + w, 6) as x from k join s on k.p = s.p""",
    "param_gate_threshold": f"with {_E}, k as (select *, last_value(v) over (partition by p order by t range between unbounded preceding and 1 preceding) as w from e where c = 'view') select p as patient_id, o as ord, t as start_us, round(v, 6) as x from k where w >= 40",
    "event_rules_or": f"""with {_E}, k as (select *, case when (c = 'purchase' and v >= 100) or (c = 'error' and v >= 120) then 'Huge' when (c = 'purchase' and v between 40 and 100) or (c = 'error' and v >= 60) then 'Big' when c = 'purchase' and v between 1 and 5 then 'Tiny' end as label from e),
n as (select *, row_number() over (partition by p, c, t order by case label when 'Huge' then 0 when 'Big' then 1 else 2 end, o) as n from k where label is not null) select p as patient_id, o as ord, t as start_us, label from n where n = 1""",
    "event_multi_source_dedupe": f"""with {_FLAGS}, k as (select *, case when (c = 'A' and v >= 40) or (c = 'R' and v >= 45) then 'High' when (c = 'A' and v <= 10) or (c = 'R' and v <= 5) then 'Low' end as label from l where v between 0 and 100),
n as (select *, row_number() over (partition by p, c, t order by label, o) as n from k where label is not null) select p as patient_id, o as ord, t as start_us, label from n where n = 1""",
    "state_merge": f"with recursive {_E}, {_state_sql(f'select p, t, o, {_band()} as label from e where c = {chr(39)}view{chr(39)}', 3 * _DU, False)} select * from f",
    "state_merge_interpolate": f"with recursive {_E}, {_state_sql(f'select p, t, o, {_band()} as label from e where c = {chr(39)}view{chr(39)}', 7 * _DU, True)} select * from f",
    "state_from_event": f"""with recursive {_E}, k as (select *, case when (c = 'purchase' and v >= 100) or (c = 'error' and v >= 120) then 'Huge' when (c = 'purchase' and v between 40 and 100) or (c = 'error' and v >= 60) then 'Big' when c = 'purchase' and v between 1 and 5 then 'Tiny' end as label from e),
n as (select *, row_number() over (partition by p, c, t order by case label when 'Huge' then 0 when 'Big' then 1 else 2 end, o) as n from k where label is not null), {_state_sql("select p, t, o, label from n where n = 1", 2 * _DU, False)} select * from f""",
    "state_glucose": f"""with recursive g0 as (select patient_id as p, epoch_us(start_date_time) as t, row_id as o, try_cast(trim(value) as double) as v from input_patient_data where concept_name = 'GLUCOSE_MEASURE' and patient_id is not null and start_date_time is not null),
{_state_sql("select p, t, o, case when v < 70 then 'Low' when v < 180 then 'Normal' else 'High' end as label from g0 where v between 10 and 1500 and not isnan(v)", _DU, False)} select * from f""",
    "trend_slope_label": f"{_TREND} select p as patient_id, o as ord, round(slope * 86400, 6) as slope_per_day, label from c",
    "trend_intervals": f"""{_TREND}, d as (select *, lag(t) over (partition by p order by t, o) as f0 from c), i as (select * from d where t - f0 <= {3 * _DU}),
j as (select *, case when lag(t) over w = f0 and lag(label) over w = label then 0 else 1 end as new from i window w as (partition by p order by t, o)), u as (select *, sum(new) over (partition by p order by t, o rows unbounded preceding) as g from j)
select p as patient_id, min(f0) as start_us, max(t) as end_us, any_value(label) as label from u group by p, g""",
    "context_window": f"with {_E}, {_VIEWS} select p as patient_id, s as start_us, z as end_us, label from y2",
    "context_self_clip": f"with {_E}, {_VIEWS} select p as patient_id, s as start_us, z as end_us, label from xv",
    "context_clippers": f"""with recursive {_E}, {_ERRORS},
h1 as (select xe.p, xe.o, xe.s, xe.z, e.t as cs, e.t + {_US} as ce, row_number() over (partition by xe.p, xe.o order by e.t, e.o) as n from xe join e on e.p = xe.p and e.c = 'purchase' and e.t - {_HU} <= xe.z and e.t + {_US} + {_HU // 2} >= xe.s),
r1 as (select p, o, s, z, cast(0 as bigint) as n from xe union all select r1.p, r1.o, case when r1.s < cs then r1.s else greatest(r1.s, ce + {_HU // 2}) end, case when r1.s < cs then least(r1.z, cs - {_HU}) else r1.z end, h1.n from r1 join h1 on r1.p = h1.p and r1.o = h1.o and h1.n = r1.n + 1),
f1 as (select p, o, arg_max(s, n) as s, arg_max(z, n) as z from r1 group by p, o having arg_max(s, n) < arg_max(z, n)),
h2 as (select f1.p, f1.o, f1.s, f1.z, e.t as cs, e.t + {_US} as ce, row_number() over (partition by f1.p, f1.o order by e.t, e.o) as n from f1 join e on e.p = f1.p and e.c = 'click' and e.t <= f1.z and e.t + {_US} + {_HU // 4} >= f1.s),
r2 as (select p, o, s, z, cast(0 as bigint) as n from f1 union all select r2.p, r2.o, case when r2.s < cs then r2.s else greatest(r2.s, ce + {_HU // 4}) end, case when r2.s < cs then least(r2.z, cs) else r2.z end, h2.n from r2 join h2 on r2.p = h2.p and r2.o = h2.o and h2.n = r2.n + 1)
select p as patient_id, arg_max(s, n) as start_us, arg_max(z, n) as end_us, 'True' as label from r2 group by p, o having arg_max(s, n) < arg_max(z, n)""",
    "context_intersection": f"with {_E}, {_ERRORS}, {_VIEWS} select distinct xe.p as patient_id, greatest(xe.s, xv.s) as start_us, least(xe.z, xv.z) as end_us from xe join xv on xe.p = xv.p and xe.s <= xv.z and xv.s <= xe.z",
    "global_clip": f"""with recursive {_E}, b as (select p, min(case when c = 'signup' then t end) as lo, max(case when c = 'purchase' then t + {_US} end) as hi from e where c in ('signup', 'purchase') group by p),
v0 as (select e.p, greatest(t, lo) as t, o, v from e left join b on e.p = b.p where c = 'view' and ((lo is null and hi is null) or greatest(t, lo) < least(t + {_US}, hi))),
{_state_sql(f"select p, t, o, {_band()} as label from v0", 3 * _DU, False)}
select f.patient_id, greatest(start_us, lo) as start_us, least(end_us, hi) as end_us, label from f left join b on f.patient_id = b.p where (lo is null and hi is null) or greatest(start_us, lo) < least(end_us, hi)""",
    **{k: _local_sql(*v) for k, v in _LOCALS.items()},
    "cyclic_windows_count": _cyclic_sql(
        f"{_E}, hz as (select p, min(t) as a, max(t) + {_US} as z from e where c in ('signup', 'view') group by p)",
        f"select distinct e.p, t as init, greatest(t, hz.a) as a, least(t + {20 * _DU}, hz.z) as z from e join hz on e.p = hz.p where c = 'signup'",
        "select p, t, o as id, v from e where c = 'view'", _DU, "true", _trap("n", "0", "1", "3", "10.0", "0.0"), "null", "null",
    ),
    "cyclic_value_score": _cyclic_sql(
        f"{_E}, {_VIEWS}, hz as (select p, min(a) as a, max(z) as z from (select p, t as a, t + {_US} as z from e where c = 'click' union all select p, s, z from xv) group by p)",
        f"select p, a as init, a, least(a + {28 * _DU}, z) as z from hz",
        "select p, t, o as id, v from e where c = 'click'", 2 * _DU, f"exists (select 1 from xv where xv.p = w0.p and label = 'Seen' and xv.s <= w0.ws + {2 * _DU} and w0.ws <= xv.z)", "null", "case when n between 1 and 3 then 1.0 else 0.0 end", _trap("v", "0", "10", "60", "300.0", "0.0"),
    ),
    "cyclic_clipper_initiator": _cyclic_sql(
        f"{_E}, hz as (select p, min(t) as a, max(t) + {_US} as z from e where c in ('error', 'purchase', 'signup') group by p), ii as (select distinct p, t as init from e where c = 'error' and v >= 40)",
        f"select ii.p, init, greatest(init, hz.a) as a, least(init + {5 * _DU}, hz.z, (select min(t) from e where e.p = ii.p and c = 'signup' and v >= 60 and t >= init)) as z from ii join hz on ii.p = hz.p",
        "select p, t, o as id, v from e where c = 'purchase'", _DU, "true", _trap("n", "0", "1", "2", "5.0", "0.0"), "null", "null",
    ),
    "output_dedupe_first": f"""with {_FLAGS}, k as (select *, case when (c = 'A' and v >= 40) or (c = 'R' and v >= 45) then 'High' when (c = 'A' and v <= 10) or (c = 'R' and v <= 5) then 'Low' end as label from l where v between 0 and 100),
n as (select *, row_number() over (partition by p, c, t order by label, o) as n from k where label is not null), m as (select *, row_number() over (partition by p, t order by o) as m from n where n = 1)
select p as patient_id, 'FLAG_EVENT' as concept_name, t as start_us, label as value, 'event' as abstraction_type from m where m = 1""",
    "input_dedupe_first": "select row_id, patient_id, concept_name, epoch_us(start_date_time) as start_us, value from (select *, row_number() over (partition by patient_id, concept_name, start_date_time order by row_id) as n from input_patient_data) where n = 1",
    "coverage_check": "with d as (select distinct concept_name, true as i from input_patient_data where concept_name is not null), c as (select concept_name, true as j from concept_catalog) select concept_name, coalesce(i, false) as in_data, coalesce(j, false) as in_definitions from d full join c using (concept_name)",
    "table_stats": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct patient_id) as n_patients from {t}" for t in ("input_patient_data", "output_patient_data", "patient_qa_scores")),
    "id_coverage": """with a as (select distinct patient_id, true as i from input_patient_data where patient_id is not null), b as (select distinct patient_id, true as o from output_patient_data where patient_id is not null), c as (select distinct visit_id as patient_id, true as v from visit_master)
select patient_id, coalesce(i, false) as in_input, coalesce(o, false) as in_output, coalesce(v, false) as in_visits from a full join b using (patient_id) full join c using (patient_id)""",
}
SQL = {k: six_sql(v) for k, v in SQL.items()}
SQL["qa_melt"] = " union all ".join(
    f"select patient_id, '{p}' as pattern_name, start_us, '{k}' as compliance_type, {c} as compliance_score from ({SQL[q]}) where {c} is not null"
    for q, p, k, c in (("local_before_time_score", "BUY_AFTER_VIEW", "TimeConstraint", "time_score"), ("local_value_score_min", "BUY_VALUE", "ValueConstraint", "value_score"), ("cyclic_windows_count", "DAILY_VIEWS", "CyclicConstraint", "cyclic_score"))
)
