"""Pattern operators: greedy one-to-one matching of anchors and events, and cyclic windows with compliance scores.

Anchors and events meet in slices of the patient's time as wide as their greatest distance, gates and clippers are looked up by
running values (see slices.py), and the greedy choice goes through the sorted pairs of a stretch: a part of the patient's time
that no pair can cross. So no window, join or list ever holds a whole patient, unless its pairs hang together without a gap;
such a stretch is read by one task, in order, keeping only which anchors and events are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.functions.exprs import candidate, combined_score, compliance_score, element, fulfilment, instant, micros, number
from intervallum.functions.registry import duration, parse_duration
from intervallum.operators.families import MICRO, WIDE, intersect
from intervallum.operators.slices import DAY, next_at, overlap_join, reached, with_stretches
from intervallum.plans import model as M
from intervallum.tables import cut

SCORES = ("time_score", "value_score", "cyclic_score")
OUT = ("patient_id", "concept", "start", "end", "value", "kind", "ord", *SCORES)


def _refs(d: M.Pattern) -> dict[str, tuple[str, int]]:
    return {s.ref: (s.name, s.idx) for s in d.derived}


def _identity() -> Column:
    return F.xxhash64("concept", "ord", "start")


def parameter_values(d: M.Pattern, rows: DataFrame) -> tuple[DataFrame | None, dict[str, Column]]:
    """(patient_id and one column per parameter, columns with defaults): the row nearest to the first start of the pattern's rows, which is its earliest."""
    if not d.parameters:
        return None, {}
    of = {p.ref: f"_p_{i}" for i, p in enumerate(d.parameters)}
    first = lambda p: F.min_by(F.when(F.col("concept") == p.name, element(p.idx)), F.when(F.col("concept") == p.name, F.struct(F.col("start"), F.col("ord"))))
    found = rows.where(F.col("concept").isin([p.name for p in d.parameters])).groupBy("patient_id").agg(*[first(p).alias(of[p.ref]) for p in d.parameters])
    return found, {p.ref: F.coalesce(number(F.col(of[p.ref])), duration(F.col(of[p.ref])), F.lit(_number(p.default))) for p in d.parameters}


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        try:
            return parse_duration(text)
        except ValueError:
            return None


def gate_intervals(gate: M.Gate, rows: DataFrame, refs: dict[str, tuple[str, int]]) -> DataFrame:
    """(patient_id, start, end) of the gate: any of its contexts, or the common parts of all of them."""
    sets = [rows.where(candidate([c], refs)).select("patient_id", "start", "end") for c in gate.conditions]
    if gate.how == "and":
        return reduce(intersect, sets)
    return reduce(lambda a, b: a.unionByName(b), sets)


def gated(rows: DataFrame, contexts: DataFrame | None, start: str, end: str) -> DataFrame:
    """Rows whose closed interval touches one of the contexts."""
    if contexts is None:
        return rows
    near = reached(rows, micros(end), contexts, micros("start"), micros("end"))
    return near.where(F.col("_reach") >= micros(start)).drop("_reach")


def _value_score(fit: M.Compliance, d: M.Pattern, parameters: dict[str, Column]) -> Column:
    """The least score of the targets' values, looked up by concept in the anchor, then in the event; 0 without any."""
    refs, scores = _refs(d), []
    for t in fit.targets:
        name, idx = refs[t]
        x = F.when(F.col("a_concept") == name, number(element(idx, "a_value"))).when(F.col("e_concept") == name, number(element(idx, "e_value")))
        scores.append(compliance_score(fit, x, parameters))
    return F.coalesce(F.array_min(F.array(*scores)), F.lit(0.0))


def pairs(r: M.LocalRule, number_: int, rows: DataFrame, refs: dict[str, tuple[str, int]], contexts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(anchors that pass the gate, candidate pairs with the keys of their greedy order)."""
    side = lambda p, test: rows.where(test).select(
        "patient_id", "stretch", _identity().alias(f"{p}_id"), F.col("concept").alias(f"{p}_concept"), F.col("value").alias(f"{p}_value"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("_s").alias(f"{p}_s"), F.col("_e").alias(f"{p}_e"), F.col("ord").alias(f"{p}_ord")
    )
    anchors = gated(side("a", candidate(r.anchor, refs)), contexts, "a_start", "a_end").withColumn("rule", F.lit(number_))
    events = side("e", candidate(r.event, refs)).withColumnRenamed("patient_id", "_rp").drop("stretch")
    if r.how == "before":
        least, most = max(1, round(r.min_distance * MICRO)), round(r.max_distance * MICRO)
        both = overlap_join(anchors, events, (F.col("a_e") + least, F.col("a_e") + most), (F.col("e_s"), F.col("e_s")), max(DAY, most))
    else:
        both = overlap_join(anchors, events, (F.col("a_s"), F.col("a_e")), (F.col("e_s"), F.col("e_e")), WIDE).where(F.col("a_id") != F.col("e_id"))
    turn = lambda select, c: -F.col(c) if select == "last" else F.col(c)
    return anchors, both.withColumn("a_key", turn(r.anchor_select, "a_s")).withColumn("e_key", turn(r.event_select, "e_s"))


_PAIR = "rule:int,a_key:bigint,a_ord:bigint,e_key:bigint,e_ord:bigint,a_id:bigint,e_id:bigint,a_s:bigint,e_s:bigint,e_e:bigint,time_score:double,value_score:double"


def greedy(all_pairs: DataFrame) -> DataFrame:
    """One-to-one matches: pairs in order of rule, anchor and event, each taken if neither side is taken yet. One sort, one pass."""
    names = [f.split(":")[0] for f in _PAIR.split(",")]
    columns = ["patient_id", "stretch", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchors, events = None, set(), set()
        for part in batches:
            keep = np.zeros(len(part), bool)
            for i, (p, stretch, a, e) in enumerate(zip(part.patient_id.tolist(), part.stretch.tolist(), part.a_id.tolist(), part.e_id.tolist())):
                if (p, stretch) != key:
                    key, anchors, events = (p, stretch), set(), set()
                if a not in anchors and e not in events:
                    keep[i] = True
                    anchors.add(a)
                    events.add(e)
            yield part[keep]

    ordered = all_pairs.select(*columns).repartition("patient_id", "stretch").sortWithinPartitions(*columns)
    return ordered.mapInPandas(run, ordered.schema)


def local_pattern(d: M.LocalPattern, sources: DataFrame) -> DataFrame:
    """One row per match, one second from the event's start, and one per unfulfilled anchor, scored by what is missing.

    Unfulfilled: not used by this or an earlier rule, in its gate, and not inside a match [anchor start, event end). The first
    rule to find an anchor so gives the row. No anchors, no rows.
    """
    refs = _refs(d)
    rows = sources.where(F.col("concept").isin([s.name for s in d.sources()]))
    found, values = parameter_values(d, rows)
    used = rows.where(reduce(lambda a, b: a | b, [candidate((*r.anchor, *r.event), refs) for r in d.rules]))
    used = used.withColumn("_s", micros("start")).withColumn("_e", micros("end"))
    placed = with_stretches(used, max(round((r.max_distance or 0) * MICRO) for r in d.rules))
    timed = any(r.time or r.existence for r in d.rules)
    valued = any(r.value for r in d.rules)
    all_anchors, all_pairs = [], []
    for k, r in enumerate(d.rules):
        contexts = gate_intervals(r.gate, rows, refs) if r.gate else None
        anchors, both = pairs(r, k, placed, refs, contexts)
        if found is not None and (r.time and r.time.parameters or r.value and r.value.parameters):
            both = both.join(found, "patient_id", "left")
        time = F.lit(1.0) if r.existence and r.how == "overlap" else compliance_score(r.time, (F.col("e_s") - F.col("a_e")) / MICRO, values) if r.time else F.lit(None).cast("double")
        value = _value_score(r.value, d, values) if r.value else F.lit(None).cast("double")
        all_pairs.append(both.withColumn("time_score", time).withColumn("value_score", value).select("patient_id", "stretch", *[f.split(":")[0] for f in _PAIR.split(",")]))
        missing_time = 0.0 if r.existence and r.how == "overlap" else r.time.trapezoid.missing_score if r.time else None
        missing_value = r.value.trapezoid.missing_score if r.value else None
        all_anchors.append(anchors.select("patient_id", "stretch", "rule", "a_id", "a_s", "a_ord", F.lit(missing_time).cast("double").alias("time_score"), F.lit(missing_value).cast("double").alias("value_score")))
    kept = cut(greedy(reduce(DataFrame.unionByName, all_pairs)))  # read three times
    label = fulfilment(combined_score(F.col("time_score"), F.col("value_score")))
    none = F.lit(None).cast("double").alias("cyclic_score")

    def out(df: DataFrame, at: str, ord_: str, label: Column) -> DataFrame:
        start = instant(F.col(at))
        return df.select("patient_id", F.lit(d.name).alias("concept"), start.alias("start"), instant(F.col(at) + MICRO).alias("end"), F.array(label).alias("value"), F.lit(d.family).alias("kind"), F.col(ord_).alias("ord"), "time_score", "value_score", none)

    matched = out(kept, "e_s", "e_ord", label)
    if d.ignore_unfulfilled:
        return matched
    anchors = reduce(DataFrame.unionByName, all_anchors)
    taken = kept.select(F.col("patient_id").alias("_kp"), F.col("stretch").alias("_ks"), F.col("a_id").alias("_ka"), F.col("rule").alias("_kr"))
    open_ = anchors.join(taken, (F.col("patient_id") == F.col("_kp")) & (F.col("stretch") == F.col("_ks")) & (F.col("a_id") == F.col("_ka")) & (F.col("_kr") <= F.col("rule")), "left_anti")
    first = open_.withColumn("_n", F.row_number().over(W.partitionBy("patient_id", "stretch", "a_id").orderBy("rule"))).where("_n = 1")
    spans = reached(first, F.col("a_s"), kept, F.col("a_s"), F.col("e_e"))
    left = spans.where(F.coalesce(F.col("_reach") <= F.col("a_s"), F.lit(True))).drop("_reach")
    return matched.unionByName(out(left, "a_s", "a_ord", label if timed or valued else F.lit("False")))


# --- cyclic windows --------------------------------------------------------------------------------------------------


def episodes(r: M.CyclicRule, number_: int, rows: DataFrame, horizon: DataFrame, refs: dict[str, tuple[str, int]]) -> DataFrame:
    """(patient_id, rule, init, ep_start, ep_end) in microseconds: from each initiator (or the horizon's start) to the rule's end, the horizon or the first clipper."""
    if r.initiator:
        starts = rows.where(candidate(r.initiator, refs)).select("patient_id", micros("start").alias("init")).distinct().join(horizon, "patient_id")
    else:
        starts = horizon.withColumn("init", F.col("h_start"))
    ep = starts.withColumn("ep_start", F.greatest(F.col("init") + round(r.start * MICRO), "h_start")).withColumn("ep_end", F.least(F.col("init") + round(r.end * MICRO), "h_end"))
    if r.clipper:
        ep = next_at(ep, F.col("init"), rows.where(candidate(r.clipper, refs)), micros("start"), "_cs")
        ep = ep.withColumn("ep_end", F.least("ep_end", "_cs"))
    return ep.where(F.col("ep_end") - F.col("ep_start") >= round(r.window * MICRO)).select("patient_id", F.lit(number_).alias("rule"), "init", "ep_start", "ep_end")


def cyclic_windows(ep: DataFrame, window: float) -> DataFrame:
    """The whole windows of each episode, ws and we in microseconds."""
    w = round(window * MICRO)
    return ep.withColumn("ws", F.explode(F.sequence(F.col("ep_start"), F.col("ep_end") - w, F.lit(w)))).withColumn("we", F.col("ws") + w)


def global_pattern(d: M.GlobalPattern, sources: DataFrame) -> DataFrame:
    """One row per window, one second from its end. The first rule and episode to have a window keep it; an event counts in the first such window that holds it."""
    refs = _refs(d)
    rows = sources.where(F.col("concept").isin([s.name for s in d.sources()]))
    found, values = parameter_values(d, rows)
    horizon = rows.groupBy("patient_id").agg(F.min(micros("start")).alias("h_start"), F.max(micros("end")).alias("h_end"))
    eps, wins, hits = [], [], []
    for k, r in enumerate(d.rules):
        ep = episodes(r, k, rows, horizon, refs)
        win = cyclic_windows(ep, r.window).withColumn("_ws", instant(F.col("ws"))).withColumn("_we", instant(F.col("we")))
        wins.append(gated(win, gate_intervals(r.gate, rows, refs) if r.gate else None, "_ws", "_we").select("patient_id", "rule", "init", "ws", "we"))
        eps.append(ep)
        fit = r.value
        x = None
        if fit:
            for t in fit.targets:
                name, idx = refs[t]
                x = F.when(F.col("concept") == name, number(element(idx))) if x is None else x.when(F.col("concept") == name, number(element(idx)))
        event = rows.where(candidate(r.event, refs)).select("patient_id", micros("start").alias("_t"), _identity().alias("e_id"), (x if x is not None else F.lit(None)).cast("double").alias("x"))
        w = round(r.window * MICRO)
        at = overlap_join(event, ep.withColumnRenamed("patient_id", "_rp"), (F.col("_t"), F.col("_t")), (F.col("ep_start"), F.col("ep_end") - 1), WIDE)
        hits.append(at.withColumn("ws", F.col("ep_start") + F.floor((F.col("_t") - F.col("ep_start")) / w) * w).select("patient_id", "rule", "init", "ws", "e_id", "x"))
    all_windows = reduce(DataFrame.unionByName, wins)
    own = all_windows.withColumn("_n", F.row_number().over(W.partitionBy("patient_id", "ws", "we").orderBy("rule", "init"))).where("_n = 1").drop("_n")
    joined = reduce(DataFrame.unionByName, hits).join(own, ["patient_id", "rule", "init", "ws"])
    once = joined.withColumn("_n", F.row_number().over(W.partitionBy("patient_id", "e_id").orderBy("rule", "init", "ws"))).where("_n = 1")
    if found is not None:
        once, own = once.join(found, "patient_id", "left"), own.join(found, "patient_id", "left")
    score = F.lit(None).cast("double")
    for k, r in enumerate(d.rules):
        if r.value:
            score = F.when(F.col("rule") == k, compliance_score(r.value, F.col("x"), values)).otherwise(score)
    counts = once.withColumn("_score", score).groupBy("patient_id", "rule", "init", "ws").agg(F.count("*").alias("n"), F.avg("_score").alias("_avg"))
    full = own.join(counts, ["patient_id", "rule", "init", "ws"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cyclic = met = value = F.lit(None).cast("double")
    for k, r in enumerate(d.rules):
        mine = F.col("rule") == k
        if r.cyclic:
            cyclic = F.when(mine, compliance_score(r.cyclic, F.col("n").cast("double"), values)).otherwise(cyclic)
        else:
            met = F.when(mine, F.col("n").between(r.least, r.most).cast("double")).otherwise(met)
        if r.value:
            value = F.when(mine, F.coalesce("_avg", F.lit(0.0))).otherwise(value)
    done = full.withColumn("cyclic_score", cyclic).withColumn("value_score", value).withColumn("_met", met)
    label = fulfilment(combined_score(F.col("cyclic_score"), F.col("value_score"), F.col("_met")))
    ordinal = F.col("ws") * 64 + F.col("rule")  # windows of one rule that start together are one
    return done.select(
        "patient_id", F.lit(d.name).alias("concept"), instant(F.col("we")).alias("start"), instant(F.col("we") + MICRO).alias("end"), F.array(label).alias("value"), F.lit(d.family).alias("kind"), ordinal.alias("ord"),
        F.lit(None).cast("double").alias("time_score"), "value_score", "cyclic_score",
    )
