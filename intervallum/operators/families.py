"""Operators of the definition families that work on streams: raw concepts to contexts, and global clipping.

Each takes a definition and the frame of its sources (all patients at once) and returns a lazy frame; see exprs.FRAME.
Ties of time are broken by `ord`, the ordinal of the input row, which is unique within a patient and concept. Windows along
time work in slices of a patient's time (see slices.py), never on a whole patient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.functions.exprs import FRAME, element, event_label, instant, micros, number, state_label
from intervallum.functions.registry import call
from intervallum.operators.slices import DAY, carried, overlap_join, own_window, run_starts, with_halo, with_slices
from intervallum.plans import model as M

MICRO = 1_000_000
#: Width of the slices in which intervals meet; contexts last hours to weeks.
WIDE = 7 * DAY
#: Later than any time (microseconds).
FAR = 2**62


def frame(df: DataFrame, concept: str | Column, value: Column, kind: str, start: Column | str = "start", end: Column | str = "end") -> DataFrame:
    """`df` brought to the columns of FRAME."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.lit(concept) if isinstance(concept, str) else concept
    return df.select("patient_id", name.alias("concept"), col(start).alias("start"), col(end).alias("end"), value.alias("value"), F.lit(kind).alias("kind"), "ord")


# --- raw concepts ----------------------------------------------------------------------------------------------------


def _attribute_value(a: M.Attribute) -> Column:
    """The value of a record as text if it suits the attribute, else null."""
    if a.kind == "numeric":
        x = number(F.trim("value"))
        ok = x.isNotNull()
        if a.bound.min is not None:
            ok &= x >= F.lit(float(a.bound.min))
        if a.bound.max is not None:
            ok &= x <= F.lit(float(a.bound.max))
        return F.when(ok, x.cast("string"))
    if a.kind == "nominal":
        return F.when(F.col("value").isin(*a.values), F.col("value")) if a.values else F.col("value")
    return F.lit("True")  # a boolean record counts by its presence, whatever it says


def raw_concept(d: M.RawConcept, records: DataFrame) -> DataFrame:
    """records: patient_id, concept, start, end, value (text), ord. One element per row, or the merged tuple of a `raw` concept."""
    mine = records.where(F.col("concept").isin([a.name for a in d.attributes]))
    typed = F.coalesce(*[F.when(F.col("concept") == a.name, _attribute_value(a)) for a in d.attributes])
    valid = mine.withColumn("value", typed).where(F.col("value").isNotNull())
    if d.concept_type != "raw":
        return frame(valid, d.name, F.array("value"), d.family)
    order = list(d.order)
    last = lambda c, a: F.max_by(F.when(F.col("concept") == a, F.col(c)), F.when(F.col("concept") == a, F.col("ord")))
    cells = valid.groupBy("patient_id", "start").agg(*[last("value", a).alias(f"_v{i}") for i, a in enumerate(order)], *[last("end", a).alias(f"_e{i}") for i, a in enumerate(order)], F.min("ord").alias("ord"))
    if d.require_all:
        cells = cells.dropna(subset=[f"_v{i}" for i in range(len(order))])
    end = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_e{i}")) for i in range(len(order))])
    return frame(cells, d.name, F.array(*[F.col(f"_v{i}") for i in range(len(order))]), d.family, end=end)


# --- parameterized concepts ------------------------------------------------------------------------------------------


def _default(p: M.Parameter) -> Column:
    return F.lit(p.default).cast("string")


def resolve_dynamic(rows: DataFrame, params: DataFrame, p: M.Parameter, out: str) -> DataFrame:
    """`rows` with `out`: element idx of the parameter row nearest in time to each row's start, as text, else the default.

    how=before: strictly before; how=all: either side, at equal distance the earlier row. One sorted window over both
    streams in each slice, with the last (next) parameter of the slices before (after); no range join.
    """
    events = params.groupBy("patient_id", F.col("start").alias("_t")).agg(
        F.max_by(element(p.idx), "ord").alias("_last"), F.min_by(element(p.idx), "ord").alias("_first")
    )
    known = events.select("patient_id", micros("_t").alias("_at"), F.struct(micros("_t").alias("t"), F.col("_last").alias("v")).alias("_p"), F.struct(micros("_t").alias("t"), F.col("_first").alias("v")).alias("_q"))
    both = with_slices(rows.withColumn("_at", micros("start")).unionByName(known, allowMissingColumns=True), F.col("_at"))
    w = own_window("_at")
    if p.how == "before":
        both = carried(both, {"_lp": F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_at")))})
        before = F.coalesce(F.last("_p", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, -1)), F.col("_lp"))
        pick = F.when(F.col("_at") - before["t"] <= F.lit(round(p.good_before * MICRO)), before["v"]) if p.good_before is not None else before["v"]
    else:
        there = F.when(F.col("_q").isNotNull(), F.col("_at"))
        both = carried(both, {"_lq": F.max_by("_q", there)}, {"_fq": F.min_by("_q", there)})
        same = F.first("_q", ignorenulls=True).over(w.rangeBetween(0, 0))
        after = F.coalesce(F.first("_q", ignorenulls=True).over(w.rangeBetween(1, W.unboundedFollowing)), F.col("_fq"))
        earlier = F.coalesce(F.last("_q", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, -1)), F.col("_lq"))
        gap_b, gap_a = F.col("_at") - earlier["t"], after["t"] - F.col("_at")
        ok_b = gap_b <= round(p.good_before * MICRO) if p.good_before is not None else gap_b.isNotNull()
        ok_a = gap_a <= round(p.good_after * MICRO) if p.good_after is not None else gap_a.isNotNull()
        b, a = F.when(ok_b, gap_b), F.when(ok_a, gap_a)
        pick = F.when(same.isNotNull(), same["v"]).when(b.isNotNull() & (a.isNull() | (b <= a)), earlier["v"]).when(a.isNotNull(), after["v"])
    return both.withColumn(out, F.coalesce(pick, _default(p))).where(F.col("ord").isNotNull()).drop("_at", "_p", "_q", "_lp", "_lq", "_fq", "_slice")


def _nearest_at(times: DataFrame, params: DataFrame, p: M.Parameter, out: str) -> DataFrame:
    """(patient_id, out): the parameter row nearest to one time `_t0` per patient; ties: the first in time and order."""
    near = params.select("patient_id", micros("start").alias("_t"), element(p.idx).alias("_v"), "ord").join(times, "patient_id")
    if p.how == "before":
        near = near.where(F.col("_t") < F.col("_t0"))
    return near.groupBy("patient_id").agg(F.min_by("_v", F.struct(F.abs(F.col("_t") - F.col("_t0")), F.col("_t"), F.col("ord"))).alias(out))


def parameterized_concept(d: M.ParameterizedConcept, sources: DataFrame) -> DataFrame:
    """The parent's rows with functions applied to elements of their value; rows with an unresolved parameter or a null result are left out."""
    rows = sources.where(F.col("concept") == d.parent.name)
    static = {}
    for i, p in enumerate(d.parameters):
        own, out = sources.where(F.col("concept") == p.name), f"_param{i}"
        if p.dynamic:
            rows = resolve_dynamic(rows, own, p, out)
            continue
        if p.name == d.parent.name and p.how == "before":
            # baseline: the first row of the parent, which is not itself given out
            place = F.struct("start", "ord")
            first = rows.groupBy("patient_id").agg(F.min_by(element(p.idx), place).alias(out), F.min(place).alias("_place"))
            rows = rows.join(first, "patient_id").where(place > F.col("_place")).drop("_place")
            continue
        if p.default is None and p.name != d.parent.name:
            first = own.groupBy("patient_id").agg(F.min("start").alias("_first"))
            rows = rows.join(first, "patient_id", "left").where(F.col("_first").isNull() | (F.col("start") > F.col("_first"))).drop("_first")
        times = rows.groupBy("patient_id").agg(F.min(micros("start")).alias("_t0"))
        static[out] = _nearest_at(times, own, p, out)
        rows = rows.join(static[out], "patient_id", "left").withColumn(out, F.coalesce(F.col(out), _default(p)))
    values = {p.ref: F.col(f"_param{i}") for i, p in enumerate(d.parameters)}
    for p in values.values():
        rows = rows.where(p.isNotNull())
    value = F.col("value")
    for c in d.calls:
        x = number(F.get(value, F.lit(c.idx)))
        args = [number(values[r]) for r in c.parameters] + [_literal(t) for t in c.literals]
        result = call(c.function, x, *args).cast("string")
        value = _replaced(value, c.idx, result)
        rows = rows.withColumn("value", value).where(F.get("value", F.lit(c.idx)).isNotNull())
        value = F.col("value")
    return frame(rows, d.name, F.col("value"), d.family)


def _replaced(value: Column, idx: int, result: Column) -> Column:
    """The list with element idx replaced."""
    return F.transform(value, lambda v, k: F.when(k == idx, result).otherwise(v))


def _literal(text: str) -> Column:
    try:
        return F.lit(float(text))
    except ValueError:
        return F.lit(text)


# --- events ----------------------------------------------------------------------------------------------------------


def _refs(derived: Sequence[M.Source]) -> dict[str, tuple[str, int]]:
    return {s.ref: (s.name, s.idx) for s in derived}


def event(d: M.Event, sources: DataFrame) -> DataFrame:
    """Rows that meet a rule, labelled by the first one; of several rows of one source at one instant the first rule wins, then the first row."""
    refs = _refs(d.derived)
    rank = None
    for i, r in enumerate(d.rules):
        test = event_label([r], refs).isNotNull()
        rank = F.when(test, i) if rank is None else rank.when(test, i)
    labelled = sources.where(F.col("concept").isin([s.name for s in d.derived])).withColumn("_label", event_label(d.rules, refs)).where(F.col("_label").isNotNull()).withColumn("_rank", rank)
    first = W.partitionBy("patient_id", "concept", "start").orderBy("_rank", "ord")
    kept = labelled.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return frame(kept, d.name, F.array("_label"), d.family)


# --- states ----------------------------------------------------------------------------------------------------------


def state(d: M.State, source: DataFrame) -> DataFrame:
    """Labelled samples merged to intervals whose window is anchored at their first sample.

    A sample joins the open interval if its label is the same and it starts within good_after of the interval's start. With
    interpolation one differing sample is passed over if the next one joins. The interval ends good_after after its last
    sample, or where the next sample starts. The fold goes through runs of samples that can touch each other (cut at gaps
    over good_after and, without interpolation, at changes of label); each run is read in order, none is held in memory.
    """
    reach = round(d.good_after * MICRO)
    smooth = d.interpolate and d.max_skip >= 1
    samples = source.where(F.col("concept") == d.parent.name).select("patient_id", micros("start").alias("s"), "ord", state_label(d.rules).alias("label")).where(F.col("label").isNotNull())
    near, w = with_halo(samples, F.col("s"), reach, reach), own_window("s", "ord")
    near = near.withColumn("ns", F.lead("s").over(w)).withColumn("nl", F.lead("label").over(w)).withColumn("_ps", F.lag("s").over(w)).withColumn("_pl", F.lag("label").over(w)).where("_own")
    new = F.col("_ps").isNull() | (F.col("s") - F.col("_ps") > reach)
    if not smooth:
        new = new | (F.col("label") != F.col("_pl"))
    runs = run_starts(near, new, "s").select("patient_id", F.col("_run.t").alias("run_s"), F.col("_run.ord").alias("run_ord"), "s", "ord", "label", F.coalesce("ns", F.lit(FAR)).alias("ns"), "nl")
    keys = ["patient_id", "run_s", "run_ord"]
    folded = runs.repartition(*keys).sortWithinPartitions(*keys, "s", "ord").mapInPandas(_fold_states(reach, smooth), "patient_id long, s long, e long, label string, ord long")
    return frame(folded, d.name, F.array("label"), d.family, instant(F.col("s")), instant(F.col("e")))


def _fold_states(reach: int, smooth: bool):
    """The anchored merge over rows sorted by run and time; one open interval is all that is kept."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = open_ = None  # open_: start, last sample, label, ord; next_: start of the sample after the last one read
        patient, next_ = 0, FAR
        for part in batches:
            out: list[tuple] = []
            rows = zip(*[part[c].tolist() for c in ("patient_id", "run_s", "run_ord", "s", "ord", "label", "ns", "nl")])
            for p, run_s, run_ord, s, ord_, label, after, after_label in rows:
                if (p, run_s, run_ord) != key:
                    if key is not None:
                        out.append((patient, open_[0], min(open_[1] + reach, next_), open_[2], open_[3]))
                    key, patient, open_ = (p, run_s, run_ord), p, (s, s, label, ord_)
                elif s <= open_[0] + reach and label == open_[2]:
                    open_ = (open_[0], s, label, open_[3])
                elif not (smooth and s <= open_[0] + reach and after_label == open_[2] and after <= open_[0] + reach):
                    out.append((p, open_[0], min(open_[1] + reach, s), open_[2], open_[3]))
                    open_ = (s, s, label, ord_)
                next_ = after
            yield pd.DataFrame(out, columns=["patient_id", "s", "e", "label", "ord"])
        if key is not None:
            yield pd.DataFrame([(patient, open_[0], min(open_[1] + reach, next_), open_[2], open_[3])], columns=["patient_id", "s", "e", "label", "ord"])

    return run


# --- trends ----------------------------------------------------------------------------------------------------------


def _points(d: M.Trend, source: DataFrame, halo: int) -> DataFrame:
    """The samples with t, y, slope and label in slices that see `halo` and time_steady before them; see trend_points()."""
    rows = source.where(F.col("concept") == d.parent.name).select("patient_id", micros("start").alias("t"), "ord", number(element(d.parent.idx)).alias("y")).where(F.col("y").isNotNull())
    steady = round(d.time_steady * MICRO)
    began = rows.groupBy("patient_id").agg(F.min("t").alias("_began"))
    rows = with_halo(rows.join(began, "patient_id"), F.col("t"), steady + halo)
    whole = own_window("t", "ord")
    rows = rows.withColumn("_t0", F.first("t").over(whole)).withColumn("_y0", F.first("y").over(whole))
    second = lambda t: F.floor((F.col(t) - F.col("_began")) / MICRO)
    x, y = (second("t") - second("_t0")).cast("double"), F.col("y") - F.col("_y0")
    w = own_window("t").rangeBetween(-steady, 0)
    rows = rows.withColumn("_x", x).withColumn("_y", y)
    spread = F.regr_sxx("_y", "_x").over(w)
    slope = F.when((F.count("_x").over(w) >= 2) & (spread > 1e-10), F.regr_slope("_y", "_x").over(w)).otherwise(0.0)
    change = F.round(F.col("slope") * d.time_steady, 9)
    label = F.when(change >= d.significant, "Increasing").when(change <= -d.significant, "Decreasing").otherwise("Steady")
    return rows.withColumn("slope", slope).withColumn("label", label)


def trend_points(d: M.Trend, source: DataFrame) -> DataFrame:
    """(patient_id, t, ord, slope, label) of each sample: least squares over the trailing time_steady, then the class.

    Time counts in whole seconds from the patient's first sample; both axes are centred for precision. Fewer than two
    samples, or samples at one time only, are Steady. Samples at the same instant see each other.
    """
    return _points(d, source, 0).where("_own").select("patient_id", "t", "ord", "slope", "label")


def trend(d: M.Trend, source: DataFrame) -> DataFrame:
    """Intervals between successive samples not over good_after apart, labelled by the later one; equal neighbours merge."""
    reach = round(d.good_after * MICRO)
    w = own_window("t", "ord")
    rows = _points(d, source, 2 * reach).withColumn("_from", F.lag("t").over(w)).withColumn("_before", F.lag("t", 2).over(w)).withColumn("_label", F.lag("label").over(w))
    pieces = rows.where("_own").where(F.col("t") - F.col("_from") <= reach)
    new = ~F.coalesce((F.col("_from") - F.col("_before") <= reach) & (F.col("_label") == F.col("label")), F.lit(False))
    runs = run_starts(pieces, new, "t")
    merged = runs.groupBy("patient_id", "_run").agg(F.min("_from").alias("s"), F.max("t").alias("e"), F.first("label").alias("label"), F.min("ord").alias("ord"))
    return frame(merged, d.name, F.array("label"), d.family, instant(F.col("s")), instant(F.col("e")))


# --- contexts --------------------------------------------------------------------------------------------------------


def context_windows(d: M.Context, sources: DataFrame) -> DataFrame:
    """Labelled source rows stretched by the window of their label, or the common window."""
    refs = _refs(d.derived)
    rows = sources.where(F.col("concept").isin([s.name for s in d.derived])).withColumn("_label", event_label(d.rules, refs)).where(F.col("_label").isNotNull())

    def side(get) -> Column:
        common = d.windows.get(None)
        out = F.lit(round(get(common) * MICRO) if common else 0)
        for value, w in d.windows.items():
            if value is not None:
                out = F.when(F.col("_label") == value, F.lit(round(get(w) * MICRO))).otherwise(out)
        return out

    return frame(rows, d.name, F.array("_label"), d.family, instant(micros("start") - side(lambda w: w.before)), instant(micros("end") + side(lambda w: w.after)))


def self_clip(contexts: DataFrame) -> DataFrame:
    """Each interval ends where the next of its patient and concept starts; empty ones are dropped."""
    keys = ("patient_id", "concept")
    rows = carried(with_slices(contexts, micros("start"), DAY, keys), {}, {"_later": F.min("start")}, keys)
    after = F.coalesce(F.lead("start").over(own_window("start", "ord", keys=keys)), F.col("_later"))
    return rows.withColumn("end", F.least("end", after)).where(F.col("start") < F.col("end")).select(*contexts.columns)


def clip_by(contexts: DataFrame, clippers: DataFrame, before: float | None, after: float | None) -> DataFrame:
    """Contexts trimmed by the clipper rows whose zone [start - before, end + after] touches them, in order of time.

    A clipper that starts inside trims the end to its left border; one that started before moves the start to its right border.
    """
    left, right = round((before or 0) * MICRO), round((after or 0) * MICRO)
    zones = clippers.select(F.col("patient_id").alias("_rp"), micros("start").alias("_cs"), micros("end").alias("_ce"), F.col("ord").alias("_co"))
    rows = contexts.withColumn("_s", micros("start")).withColumn("_e", micros("end"))
    keys = ["patient_id", "concept", "start", "end", "value", "kind", "ord", "_s", "_e"]
    touched = overlap_join(rows, zones, (F.col("_s"), F.col("_e")), (F.col("_cs") - left, F.col("_ce") + right), WIDE, "left")
    hits = touched.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_cs").isNotNull(), F.struct("_cs", "_co", "_ce")))).alias("_z"))

    def step(acc: Column, z: Column) -> Column:
        inside = acc["s"] < z["_cs"]
        return F.struct(F.when(inside, acc["s"]).otherwise(F.greatest(acc["s"], z["_ce"] + right)).alias("s"), F.when(inside, F.least(acc["e"], z["_cs"] - left)).otherwise(acc["e"]).alias("e"))

    cut = hits.withColumn("_c", F.aggregate("_z", F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")), step))
    return cut.withColumn("start", instant(F.col("_c.s"))).withColumn("end", instant(F.col("_c.e"))).where(F.col("_c.s") < F.col("_c.e")).select(*FRAME)


def context(d: M.Context, sources: DataFrame) -> DataFrame:
    """Windows around source rows, clipped by each other and by the definition's clippers."""
    out = self_clip(context_windows(d, sources))
    for c in d.clippers:
        out = clip_by(out, sources.where(F.col("concept") == c.name), c.before, c.after)
    return out


# --- interval sets ---------------------------------------------------------------------------------------------------


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """(patient_id, start, end) of the common parts of two interval sets; touching intervals share an instant."""
    l, r = a.select("patient_id", "start", "end"), b.select(F.col("patient_id").alias("_rp"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = overlap_join(l, r, (micros("start"), micros("end")), (micros("_s"), micros("_e")), WIDE)
    return both.select("patient_id", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end")).distinct()


# --- global clipping -------------------------------------------------------------------------------------------------


def clip_bounds(records: DataFrame, clippers: Sequence[M.GlobalClipper]) -> DataFrame:
    """(patient_id, floor, ceiling): first start of START clippers, last end of END clippers; either may be null."""
    of = lambda how: [c.name for c in clippers if c.how == how]
    starts, ends = F.col("concept").isin(of("START")), F.col("concept").isin(of("END"))
    return records.where(starts | ends).groupBy("patient_id").agg(F.min(F.when(starts, F.col("start"))).alias("floor"), F.max(F.when(ends, F.col("end"))).alias("ceiling"))


def clip_globally(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Intervals cut to the bounds of their patient, empty ones dropped; patients without bounds pass as they are."""
    both = rows.join(bounds, "patient_id", "left")
    free = F.col("floor").isNull() & F.col("ceiling").isNull()
    cut = both.withColumns({"start": F.greatest("start", "floor"), "end": F.least("end", "ceiling")})
    return cut.where(free | (F.col("start") < F.col("end"))).select(*rows.columns)
