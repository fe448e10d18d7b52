"""Families over streams: raw concepts and events need no state; states and trends keep one small automaton per patient.

Samples may come late within the watermark's delay: they are held until the watermark has passed them and then taken in
order of time, so a stream gives the same intervals as the batch operators over the same rows. State is bounded by the
samples within the delay (and, for trends, within time_steady).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from intervallum.functions.exprs import element, micros, number, state_label
from intervallum.plans import model as M

MICRO = 1_000_000
OUT = "patient_id long, start_us long, end_us long, label string"


def stream_states(d: M.State, source: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Intervals (patient_id, start_us, end_us, label) of a state, each as soon as it is closed for certain. `source`: a streaming frame."""
    reach, smooth = round(d.good_after * MICRO), d.interpolate and d.max_skip >= 1
    rows = source.where(F.col("concept") == d.parent.name).select("patient_id", F.col("start").cast("timestamp").alias("at"), micros("start").alias("t"), "ord", state_label(d.rules).alias("label")).where(F.col("label").isNotNull())

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, cur = ([], None)
        if state.exists:
            got = state.get
            held, cur = [tuple(x) for x in zip(got[0], got[1], got[2])], (got[3], got[4], got[5]) if got[5] is not None else None
        for part in parts:
            held += list(zip(part.t.tolist(), part.ord.tolist(), part.label.tolist()))
        mark = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda x: x[:2])
        ready = sum(t <= mark for t, _, _ in held)
        out = []
        for i in range(ready):
            t, _, label = held[i]
            if cur is None:
                cur = (t, t, label)
            elif label == cur[2] and t <= cur[0] + reach:
                cur = (cur[0], t, label)
            else:
                if smooth and t <= cur[0] + reach:
                    if i + 1 >= ready and mark < cur[0] + reach:
                        ready = i  # the next sample decides, and it may still come
                        break
                    if i + 1 < len(held) and held[i + 1][2] == cur[2] and held[i + 1][0] <= cur[0] + reach:
                        continue
                out.append((cur[0], min(cur[1] + reach, t), cur[2]))
                cur = (t, t, label)
        held = held[ready:]
        if cur is not None and not held and mark > cur[1] + reach:
            out.append((cur[0], cur[1] + reach, cur[2]))
            cur = None
        if held or cur is not None:
            state.update(([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], cur[0] if cur else None, cur[1] if cur else None, cur[2] if cur else None))
            later = (min(h[0] for h in held) if held else cur[1] + reach) // 1000 + 1
            state.setTimeoutTimestamp(max(later, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["patient_id", "start_us", "end_us", "label"])

    kept = "ts array<long>, ords array<long>, labels array<string>, s long, last long, label string"
    return rows.withWatermark("at", delay).groupBy("patient_id").applyInPandasWithState(run, OUT, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_trend_points(d: M.Trend, source: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(patient_id, start_us, end_us, label): from sample to sample not over good_after apart, the class of the later one."""
    steady, reach = round(d.time_steady * MICRO), round(d.good_after * MICRO)
    rows = source.where(F.col("concept") == d.parent.name).select("patient_id", F.col("start").cast("timestamp").alias("at"), micros("start").alias("t"), "ord", number(element(d.parent.idx)).alias("y")).where(F.col("y").isNotNull())

    def label(window: list[tuple]) -> str:
        n = len(window)
        xs, ys = [float((t - window[0][0]) // MICRO) for t, _, _ in window], [y for _, _, y in window]
        mx, my = sum(xs) / n, sum(ys) / n
        spread = sum((x - mx) ** 2 for x in xs)
        if n < 2 or spread <= 1e-10:
            return "Steady"
        change = round(sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / spread * d.time_steady, 9)
        return "Increasing" if change >= d.significant else "Decreasing" if change <= -d.significant else "Steady"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, past = ([], [])
        if state.exists:
            got = state.get
            held, past = list(zip(got[0], got[1], got[2])), list(zip(got[3], got[4], got[5]))
        for part in parts:
            held += list(zip(part.t.tolist(), part.ord.tolist(), part.y.tolist()))
        mark = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda x: x[:2])
        out = []
        while held and held[0][0] <= mark:
            now = held.pop(0)
            before = past[-1] if past else None
            past = [p for p in past if p[0] >= now[0] - steady] + [now]
            if before is not None and now[0] - before[0] <= reach:
                out.append((before[0], now[0], label(past)))
        past = past if past and past[-1][0] + max(reach, steady) >= mark else []
        if held or past:
            state.update((*[[h[i] for h in held] for i in range(3)], *[[p[i] for p in past] for i in range(3)]))
            later = (held[0][0] if held else past[-1][0] + max(reach, steady)) // 1000 + 1
            state.setTimeoutTimestamp(max(later, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["patient_id", "start_us", "end_us", "label"])

    kept = "ts array<long>, ords array<long>, ys array<double>, pt array<long>, po array<long>, py array<double>"
    return rows.withWatermark("at", delay).groupBy("patient_id").applyInPandasWithState(run, OUT, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily_scores(scores: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean score and number per patient, pattern, type and day of a stream of scores; late rows within the delay count."""
    at = scores.where("compliance_score is not null").withColumn("at", F.col("start_date_time").cast("timestamp")).withWatermark("at", delay)
    day = at.groupBy(F.window("at", "1 day").alias("w"), "patient_id", "pattern_name", "compliance_type").agg(F.avg("compliance_score").alias("day_score"), F.count("*").alias("n"))
    return day.select("patient_id", "pattern_name", "compliance_type", F.to_date("w.start").alias("day"), "day_score", "n")
