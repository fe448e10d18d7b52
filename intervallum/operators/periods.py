"""Problem 6: intervals that overlap, nest or leave gaps, merged into periods, with the gaps between them.

Time is discretised exactly: cell 2t is the instant t (in microseconds), cell 2t+1 the open time until the next. An interval
from s to e sets the cells 2s..2e, so touching intervals join and one second between two leaves clear cells. Bitmaps are
kept compressed as runs (first cell, last cell) in binary, one per entity and time shard. Each task unites what it reads
before the shuffle, the shuffle brings the bitmaps of a shard together, set and clear runs are extracted, and only the first
and last run of each shard are stitched to those of the neighbouring shards. No task sees more of an entity than one shard
or its shard edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.tables import cut

SHARD_DAYS, BLOCK = 7, 200_000


def unite(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs of cells per group; neighbouring cells join. Out: group, low, high, in order."""
    if not len(group):
        return group, low, high
    order = np.lexsort((low, group))
    g, a, b = group[order], low[order], high[order]
    rank = np.cumsum(np.r_[False, g[1:] != g[:-1]])
    # running maximum of `high` within a group: each group is lifted above the one before
    base = a.min()
    span = int(b.max() - base) + 2
    lifted = (b - base) + rank * span if int(rank[-1] + 1) * span < 2**62 else None
    if lifted is not None:
        reach = np.maximum.accumulate(lifted) - rank * span + base
    else:
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(b, np.flatnonzero(np.diff(rank)) + 1)])
    new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] > reach[:-1] + 1)]
    start = np.flatnonzero(new)
    return g[start], a[start], reach[np.r_[start[1:] - 1, len(g) - 1]]


def _pack(keys: pd.DataFrame, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    """One row per group: its keys and its runs as bytes."""
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)] if len(group) else np.zeros(1, int)
    runs = np.column_stack([low, high]).astype("<i8")
    out = keys.iloc[group[cuts[:-1]]].reset_index(drop=True)
    out["runs"] = [runs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _runs(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = np.array([len(b) // 16 for b in blobs])
    flat = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    return np.repeat(np.arange(len(count)), count), flat[:, 0], flat[:, 1]


def _united(part: pd.DataFrame) -> pd.DataFrame:
    """(entity, shard, runs) united per (entity, shard)."""
    row, low, high = _runs(part.runs)
    keys = part[["entity", "shard"]]
    code = pd.MultiIndex.from_frame(keys).factorize()[0]
    first = keys[~pd.Series(code).duplicated().to_numpy()].reset_index(drop=True)
    return _pack(first, *unite(code[row], low, high))


def _first_union(width: int):
    """Intervals united per entity, cut into shards, and packed; `BLOCK` pieces at a time, however long the intervals are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            low, high = 2 * np.minimum(part.s, part.e).to_numpy(), 2 * np.maximum(part.s, part.e).to_numpy()
            code, names = part.entity.factorize()
            who, low, high = unite(code, low, high)
            first, last = low // width, high // width
            total = np.cumsum(last - first + 1)
            at = 0
            while at < len(who):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, side="right")))
                count = (last - first + 1)[at:end].astype(int)
                row = np.repeat(np.arange(at, end), count)
                shard = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo, hi = np.maximum(low[row], shard * width), np.minimum(high[row], (shard + 1) * width - 1)
                new = np.r_[True, (who[row][1:] != who[row][:-1]) | (shard[1:] != shard[:-1])]  # in order of entity and time
                keys = pd.DataFrame({"entity": names.to_numpy()[who[row[new]]], "shard": shard[new]})
                yield _pack(keys, np.cumsum(new) - 1, lo, hi)
                at = end

    return run


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Set and clear runs of each (entity, shard); the partition is sorted by them. kind: run, gap or edge."""

    def out(part: pd.DataFrame) -> pd.DataFrame:
        whole = _united(part)
        row, low, high = _runs(whole.runs)
        if not len(row):
            return pd.DataFrame(columns=["entity", "shard", "kind", "low", "high"])
        head, tail = np.r_[True, row[1:] != row[:-1]], np.r_[row[1:] != row[:-1], True]
        kind = np.where(head | tail, "edge", "run")
        next_ = np.flatnonzero(~tail)
        at = np.r_[row, row[next_]]
        return pd.DataFrame(
            {
                "entity": whole.entity.to_numpy()[at],
                "shard": whole.shard.to_numpy()[at],
                "kind": np.r_[kind, np.full(len(next_), "gap")],
                "low": np.r_[low, high[next_]],
                "high": np.r_[high, low[next_ + 1]],
            }
        )

    held: list[pd.DataFrame] = []
    rows = 0
    for part in batches:
        held.append(part)
        rows += len(part)
        if rows >= BLOCK:
            whole = pd.concat(held, ignore_index=True)
            last = (whole.entity == whole.entity.iloc[-1]) & (whole.shard == whole.shard.iloc[-1])
            yield out(whole[~last])
            held = [_united(whole[last])]  # a long shard is united as it comes
            rows = len(held[0])
    if held:
        yield out(pd.concat(held, ignore_index=True))


def periods_and_gaps(intervals: DataFrame, entity: str, start: str, end: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """(entity, kind, start, end) with kind `period` or `gap`.

    Rows with a null entity, start or end are left out; reversed ones are swapped; zero-length ones count; repeated ones
    change nothing. An entity with one period has no gap. Other columns are ignored.
    """
    width = 2 * shard_days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = intervals.select(F.col(entity).alias("entity"), micros(start).alias("s"), micros(end).alias("e")).dropna()
    kind = rows.schema["entity"].dataType.simpleString()
    bitmaps = rows.mapInPandas(_first_union(width), f"entity {kind}, shard long, runs binary")
    parts = bitmaps.repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    found = cut(parts.mapInPandas(_extract, f"entity {kind}, shard long, kind string, low long, high long"))
    edges = found.where("kind = 'edge'")
    w = W.partitionBy("entity").orderBy("low")
    linked = edges.withColumn("_prev", F.lag("high").over(w)).withColumn("_shard", F.lag("shard").over(w))
    linked = linked.withColumn("_new", F.when(F.col("low") == F.col("_prev") + 1, 0).otherwise(1)).withColumn("_id", F.sum("_new").over(w))
    joined = linked.groupBy("entity", "_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("entity", F.lit("period").alias("kind"), "low", "high")
    between = linked.where((F.col("_new") == 1) & (F.col("shard") != F.col("_shard"))).select("entity", F.lit("gap").alias("kind"), F.col("_prev").alias("low"), F.col("low").alias("high"))
    inside = found.where("kind <> 'edge'").select("entity", F.when(F.col("kind") == "run", "period").otherwise("gap").alias("kind"), "low", "high")
    whole = inside.unionByName(joined).unionByName(between)
    # a run is closed at cells 2s and 2e; cells at shard borders are even or odd, both belong to the instant below
    stamp = lambda c: F.timestamp_micros(F.expr(f"{c} div 2")).cast("timestamp_ntz")
    return whole.select(F.col("entity").alias(entity), "kind", stamp("low").alias(start), stamp("high").alias(end))
