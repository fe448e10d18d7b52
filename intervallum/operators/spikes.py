"""Problem 2: implausible readings, flagged against what their series (patient, concept, source) normally shows.

One shuffle brings each series together, sorted by time; numpy then works on whole blocks of series at once. Phase-space
thresholding: with robust scales (median absolute deviations) of the value u, its first difference and its second difference,
readings outside the ellipse of the universal threshold sqrt(2 ln n) in any of the phase planes are candidates (the ellipse of
value and second difference is turned by their correlation); they are replaced by the middle of the nearest readings before
and after that are not flagged, and the rest is judged again, until nothing is new. An exact check follows:
a candidate is a spike if it, alone or with one neighbour, lies more than `SPIKE_AT` times the series' ordinary scatter from
the readings before and after. Runs of zero difference are `stuck`, readings out of bounds `impossible`.

Ordinary scatter: the median absolute first difference over 0.954 (that of unit noise), drawn towards the usual relative
scatter of the concept with the weight of `PRIOR` readings, since the median of a handful of differences is worth little.

A series of more than `SHARD_ROWS` rows is cut by the rank of its instants into shards that see the `HALO` instants before
and after them; medians, correlation and number of readings are taken over the whole series first, round by round, and given
to its shards (`whole`; one entry for each such series). A round looks `LOOK` + 1 instants far, so shards flag as the whole
series would for HALO / (LOOK + 1) rounds of changes that move on from instant to instant. All rows of one instant lie in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.tables import cut

SPIKE_AT, STUCK_RUN, PRIOR, LOOK = 8.0, 6, 12, 3
SHARD_ROWS, HALO, BLOCK = 200_000, 64, 250_000
SERIES = ["patient_id", "concept_key", "source_key"]


def _group_median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the finite values of each group (NaN where there are none). Groups lie together and ascend."""
    ok = np.isfinite(values)
    v, g = values[ok], group[ok]
    order = np.lexsort((v, g))
    v, g = v[order], g[order]
    count = np.bincount(g, minlength=groups)
    start = np.r_[0, np.cumsum(count)[:-1]]
    out = np.full(groups, np.nan)
    has = count > 0
    low, high = start[has] + (count[has] - 1) // 2, start[has] + count[has] // 2
    out[has] = (v[low] + v[high]) / 2
    return out


def _shift(a: np.ndarray, group: np.ndarray, by: int) -> np.ndarray:
    """a[i + by] within the same group, else NaN."""
    out = np.full(len(a), np.nan)
    if abs(by) >= len(a):
        return out
    if by > 0:
        out[:-by] = np.where(group[by:] == group[:-by], a[by:], np.nan)
    else:
        out[-by:] = np.where(group[:by] == group[-by:], a[:by], np.nan)
    return out


def _differences(clean: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, second and central difference of each reading, 0 at the ends of a series."""
    before, after = _shift(clean, group, -1), _shift(clean, group, 1)
    return np.nan_to_num(clean - before), np.nan_to_num(after - 2 * clean + before), np.nan_to_num((after - before) / 2)


def _or_own(whole: np.ndarray | None, own: np.ndarray) -> np.ndarray:
    """The figures of the whole series where they are given, else those of the group."""
    return own if whole is None else np.where(np.isnan(whole), own, whole)


def _nearest_clean(u: np.ndarray, group: np.ndarray, flagged: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For the flagged readings `at` the middle of the nearest ones before and after, at most `LOOK` away, that are not; `other` if there is none."""
    sides = []
    for way in (-1, 1):
        found = np.full(len(at), np.nan)
        for k in range(LOOK, 0, -1):
            near = np.clip(at + way * k, 0, len(u) - 1)
            ok = (near == at + way * k) & (group[near] == group[at]) & ~flagged[near]
            found[ok] = u[near[ok]]
        sides.append(found)
    a, b = sides
    fill = np.where(np.isnan(a), b, np.where(np.isnan(b), a, (a + b) / 2))
    return np.where(np.isnan(fill), other, fill)


def _correlation(a: np.ndarray, b: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Of each group, about zero."""
    total = lambda x: np.bincount(group, x, groups)
    return total(a * b) / np.maximum(np.sqrt(total(a * a) * total(b * b)), 1e-300)


def phase_space(u: np.ndarray, group: np.ndarray, groups: int, rounds: int | None = None, size: np.ndarray | None = None, medians: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Readings with the outer ones replaced, and which lie outside the ellipses of their series, found until nothing is new (or for `rounds`).

    `size` and `medians` (for each round: groups x (value, off it, first, second, central difference, correlation)): figures of
    whole series, NaN where the group is one. Rounds past the last find nothing new in those series.
    """
    clean, flagged = u.copy(), np.zeros(len(u), bool)
    n = _or_own(size, np.bincount(group, minlength=groups))
    reach = np.sqrt(2 * np.log(np.maximum(n, 2)))
    usual = _or_own(medians[0][:, 0] if medians else None, _group_median(u, group, groups))
    rows, active, r = np.arange(len(u)), np.arange(groups), 0  # only series in which the last round found something go on
    while len(rows) and (rounds is None or r < rounds):
        x, g, k = clean[rows], np.searchsorted(active, group[rows]), len(active)
        given = lambda c: medians[min(r, len(medians) - 1)][active, c] if medians else None  # noqa: E731, B023
        step, bend, du = _differences(x, g)
        off = x - _or_own(given(0), _group_median(x, g, k))[g]
        axes = []
        for c, a in enumerate((off, step, bend, du)):
            scale = 1.4826 * _or_own(given(c + 1), _group_median(np.abs(a), g, k))[g]
            axes.append(a / np.maximum(scale, 1e-12 + 1e-9 * np.abs(x)))
        value, first, second, central = axes
        turn = np.clip(_or_own(given(5), _correlation(off, bend, g, k)), -0.95, 0.95)[g]
        limit = reach[active][g] ** 2
        outside = value**2 - 2 * turn * value * second + second**2 > (1 - turn**2) * limit
        for a, b in ((value, first), (first, second), (value, central)):
            outside |= a**2 + b**2 > limit
        new = outside & ~flagged[rows]
        flagged[rows[new]] = True
        hit = np.zeros(k, bool)
        hit[g[new]] = True
        rows, active = rows[hit[g]], active[hit]
        at = rows[flagged[rows]]
        clean[at] = _nearest_clean(u, group, flagged, at, usual[group[at]])
        r += 1
    return clean, flagged


def phase_space_candidates(u: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Readings outside the ellipses of their series, found iteratively."""
    return phase_space(u, group, groups)[1]


def excursion(u: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each reading lies, alone or with one neighbour, from the readings before and after (0 if on no one side of both)."""

    def off(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(np.sign(value - a) == np.sign(value - b), np.minimum(np.abs(value - a), np.abs(value - b)), 0.0)

    p2, p1, n1, n2 = (_shift(u, group, k) for k in (-2, -1, 1, 2))
    alone = np.nan_to_num(off(u, p1, n1))
    side = np.sign(u - p1)
    with_next = np.where((np.sign(u - p1) == np.sign(n1 - n2)) & (np.sign(n1 - p1) == side), np.minimum(np.minimum(off(u, p1, n2), off(n1, p1, n2)), np.inf), 0.0)
    side = np.sign(u - n1)
    with_last = np.where((np.sign(u - n1) == np.sign(p1 - p2)) & (np.sign(p1 - n1) == side), np.minimum(off(u, p2, n1), off(p1, p2, n1)), 0.0)
    return np.maximum(alone, np.maximum(np.nan_to_num(with_next), np.nan_to_num(with_last)))


class Whole(dict):
    """Series -> figures taken over all of it: n, scatter, and for each round the medians that `phase_space` takes."""

    def arrays(self, block: pd.DataFrame, first: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, list[np.ndarray]]:
        """n, scatter and medians of the groups that begin at rows `first`; NaN for other series."""
        if not self:
            return None, None, []
        rounds = max(len(x["medians"]) for x in self.values())
        none = {"n": np.nan, "scatter": np.nan, "medians": [(np.nan,) * 6] * rounds}
        own = [self.get(key, none) for key in block.iloc[first][SERIES].itertuples(index=False, name=None)]
        return np.array([x["n"] for x in own], float), np.array([x["scatter"] for x in own], float), [np.array([x["medians"][r] for x in own], float).reshape(-1, 6) for r in range(rounds)]


def judge(block: pd.DataFrame, whole: Whole | None = None, rounds: int | None = None) -> pd.DataFrame:
    """Candidates and statistics of whole series; `block` is sorted by patient_id, concept_key, source_key, shard, t, row_id.

    Out: row_id (null: a statistics row), kind, the series, n, scatter, centre, away (excursion). With `rounds`, instead the
    readings after so many rounds: the series, value, first, second, central (differences), plain (absolute first difference as
    read, null in runs), flagged.
    """
    new = np.r_[True, _changes(block)] if len(block) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    groups = int(new.sum())
    y, t, tol, ok = (block[c].to_numpy() for c in ("y", "t", "tol", "possible"))
    unit, halo = block.unit.to_numpy(), block.halo.to_numpy()
    # stuck: runs over instants; where an instant has several readings, the one that goes on with the last instant counts
    head = np.r_[True, (group[1:] != group[:-1]) | (t[1:] != t[:-1])] if len(y) else np.zeros(0, bool)
    at = np.cumsum(head) - 1
    first = np.flatnonzero(head)

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = np.abs(y[i] - y[j])
        return np.where(unit[i] == unit[j], gap <= 1e-9 * np.abs(y[i]), gap <= tol[i] + tol[j])

    chosen = first.copy()
    rows = np.arange(len(y))
    extra = rows[~head]
    extra = extra[(at[extra] > 0) & (group[extra] == group[first[at[extra]] - 1])]
    if len(extra):
        goes_on = extra[equal(extra, first[at[extra] - 1])]
        chosen[at[goes_on[::-1]]] = goes_on[::-1]
    g = group[chosen]
    linked = np.r_[False, (g[1:] == g[:-1]) & equal(chosen[1:], chosen[:-1])]
    run = np.cumsum(~linked) - 1
    length = np.bincount(run)[run] if len(run) else run
    stuck = (length[at] >= STUCK_RUN) & equal(rows, chosen[at])
    # spikes: series of possible readings, one per instant
    keep = ok[chosen]
    rep, rg = chosen[keep], g[keep]
    u = y[rep]
    still = (length >= STUCK_RUN)[keep]
    size, whole_scatter, medians = (whole or Whole()).arrays(block, np.flatnonzero(new))
    step = u - _shift(u, rg, -1)
    step[still] = np.nan
    if rounds is not None:
        clean, flagged = phase_space(u, rg, groups, rounds, size, medians)
        one, two, central = _differences(clean, rg)
        out = block.iloc[rep][SERIES].reset_index(drop=True)
        out["value"], out["first"], out["second"], out["central"] = clean, one, two, central
        out["plain"], out["flagged"] = np.abs(step), flagged
        return out[~halo[rep]]
    flagged = phase_space(u, rg, groups, None, size, medians)[1]
    away = excursion(u, rg)
    scatter = _or_own(whole_scatter, _group_median(np.abs(step), rg, groups) / 0.954)
    centre = np.abs(_or_own(medians[0][:, 0] if medians else None, _group_median(u, rg, groups)))
    n = _or_own(size, np.bincount(rg, minlength=groups)).astype(int)
    # other readings at the instant of a candidate are judged in its place
    spot = np.full(len(first), -1)
    spot[np.flatnonzero(keep)] = np.arange(len(rep))
    mine = spot[at]
    dist = np.where(mine >= 0, away[mine], 0.0) if len(away) else np.zeros(len(y))
    hit = np.where(mine >= 0, flagged[mine], False) if len(away) else np.zeros(len(y), bool)
    other = (mine >= 0) & (rows != chosen[at]) & ok
    if other.any():
        o = np.flatnonzero(other)
        before, after = _shift(u, rg, -1)[mine[o]], _shift(u, rg, 1)[mine[o]]
        a, b = y[o] - before, y[o] - after
        alone = np.nan_to_num(np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0))
        near = np.abs(y[o] - u[mine[o]]) < 0.5 * dist[o]
        dist[o] = np.where(near, np.maximum(alone, dist[o] - np.abs(y[o] - u[mine[o]])), alone)
        hit[o] = True
    kind = np.where(~ok, "impossible", np.where(stuck, "stuck", np.where(hit & (dist > 0), "spike", "")))
    take = np.flatnonzero((kind != "") & ~halo)
    some = np.flatnonzero(new)
    big = np.concatenate([take, some])
    where = group[big]
    out = block.iloc[big][SERIES].reset_index(drop=True)
    out["row_id"] = pd.array(np.r_[block.row_id.to_numpy()[take], np.zeros(len(some), int)], dtype="Int64")
    out.loc[len(take) :, "row_id"] = pd.NA
    out["kind"] = np.r_[kind[take], np.full(len(some), "")]
    out["n"], out["scatter"], out["centre"] = n[where], scatter[where], centre[where]
    out["away"] = np.r_[dist[take], np.zeros(len(some))]
    # a candidate under the least possible threshold can never be a spike
    return out[(out.kind != "spike") | (out.away > 0)]


def _changes(block: pd.DataFrame) -> np.ndarray:
    """Where a row is of another series or shard than the row before."""
    out = np.zeros(len(block) - 1, bool)
    for c in (*SERIES, "shard"):
        v = block[c].to_numpy()
        out |= v[1:] != v[:-1]
    return out


def _blocks(batches: Iterator[pd.DataFrame], whole: Whole | None = None, rounds: int | None = None) -> Iterator[pd.DataFrame]:
    """Arrow batches joined to blocks that end where a series ends, judged."""
    held: list[pd.DataFrame] = []
    rows = 0
    for part in batches:
        held.append(part)
        rows += len(part)
        if rows >= BLOCK:
            joined = pd.concat(held, ignore_index=True)
            change = np.flatnonzero(_changes(joined))
            if len(change):
                end = int(change[-1]) + 1
                yield judge(joined.iloc[:end], whole, rounds)
                held, rows = [joined.iloc[end:]], len(joined) - end
            else:
                held = [joined]
    joined = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(joined):
        yield judge(joined, whole, rounds)


def sharded(rows: DataFrame, shard_rows: int = SHARD_ROWS, halo: int = HALO) -> tuple[DataFrame, DataFrame | None]:
    """`rows` with shard and halo (the row only gives context there), and those of them in series over `shard_rows` rows (None if
    there are none), which alone have several shards: by the rank of their instant, found from counts of coarse time slices."""
    plain = rows.withColumn("shard", F.lit(0).cast("long")).withColumn("halo", F.lit(False))
    hot = cut(rows.groupBy(*SERIES).agg(F.count("*").alias("_rows")).where(F.col("_rows") > shard_rows))
    if hot.isEmpty():
        return plain, None
    mine = rows.join(hot.select(*SERIES), SERIES)
    cuts = mine.groupBy(*SERIES).agg(F.array_distinct(F.percentile_approx("t", [k / 1024 for k in range(1, 1024)], 10_000)).alias("_cuts"))
    sliced = mine.join(cuts, SERIES).withColumn("_slice", F.expr("size(filter(_cuts, c -> c <= t))")).drop("_cuts")
    counts = sliced.groupBy(*SERIES, "_slice").agg(F.countDistinct("t").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*SERIES).orderBy("_slice")) - F.col("_n")).drop("_n")  # 1,024 slices a series at most
    ranked = sliced.withColumn("_at", F.dense_rank().over(W.partitionBy(*SERIES, "_slice").orderBy("t"))).join(before, [*SERIES, "_slice"])
    at = F.col("_before") + F.col("_at") - 1
    home = lambda c: F.floor(c / F.lit(shard_rows)).cast("long")
    copies = ranked.withColumn("_home", home(at)).withColumn("shard", F.explode(F.sequence(F.greatest(home(at - halo), F.lit(0).cast("long")), home(at + halo))))
    cold = plain.join(hot.select(*SERIES), SERIES, "left_anti")
    copies = cut(copies.withColumn("halo", F.col("shard") != F.col("_home")).select(*cold.columns))
    return cold.unionByName(copies), copies


def whole_series(hot: DataFrame) -> Whole:
    """Figures of the series in `hot` (all their shards, sorted) over all of each: exact medians, gathered round by round until no reading is new."""
    whole, flagged, r = Whole(), -1, 0
    schema = "patient_id long, concept_key long, source_key long, value double, first double, second double, central double, plain double, flagged boolean"
    middle = lambda c: F.percentile(F.nanvl(c, F.lit(None).cast("double")), 0.5)
    while True:
        read = cut(hot.mapInPandas(lambda batches, r=r: _blocks(batches, whole, r), schema))
        got = read.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("long")).alias("flagged"), middle(F.col("plain")).alias("plain"), middle(F.col("value")).alias("value"), *[middle(F.abs(c)).alias(c) for c in ("first", "second", "central")])
        got = cut(got)
        off = F.col("value") - F.col("_centre")
        turn = F.sum(off * F.col("second")) / F.greatest(F.sqrt(F.sum(off * off) * F.sum(F.col("second") * F.col("second"))), F.lit(1e-300))
        about = read.join(got.select(*SERIES, F.col("value").alias("_centre")), SERIES).groupBy(*SERIES).agg(middle(F.abs(off)).alias("off"), turn.alias("turn"))
        now = got.join(about, SERIES).collect()  # as many rows as there are series over `SHARD_ROWS` rows
        if sum(x.flagged for x in now) == flagged:
            break
        flagged, r = sum(x.flagged for x in now), r + 1
        for x in now:
            own = whole.setdefault(tuple(x[c] for c in SERIES), {"n": x.n, "scatter": np.nan if x.plain is None else x.plain / 0.954, "medians": []})
            own["medians"].append((x.value, x.off, x.first, x.second, x.central, x.turn))
    return whole


def implausible(harmonised: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(row_id, kind) of implausible readings; `harmonised`: units.harmonise() with row_id, patient_id, start_date_time.

    Rows without a start_date_time or patient lie in no series: only `impossible` can be said of them. Equal rows are judged
    each. A reading equal to its neighbours in another unit counts as the same within the rounding of both. Rows whose unit is
    unknown have no reading (y is null) and are in no series.
    """
    y = F.col("y")
    possible = F.coalesce(y >= F.col("min_possible"), F.lit(True)) & F.coalesce(y <= F.col("max_possible"), F.lit(True))
    rows = harmonised.where("y is not null").select(
        "row_id",
        "patient_id",
        F.xxhash64("concept_name").alias("concept_key"),
        F.xxhash64("source_id").alias("source_key"),
        F.unix_micros(F.col("start_date_time").cast("timestamp")).alias("t"),
        "y",
        (F.abs("factor") * F.pow(F.lit(10.0), -F.col("decimals")) / 2).alias("tol"),
        F.hash("unit_code").alias("unit"),
        possible.alias("possible"),
    )
    timed = F.col("t").isNotNull() & F.col("patient_id").isNotNull() & F.col("row_id").isNotNull()
    lone = rows.where(~timed & ~F.col("possible")).select("row_id", F.lit("impossible").alias("kind"))
    order = [*SERIES, "shard", "t", "row_id"]
    ordered = lambda df: df.repartition(*SERIES, "shard").sortWithinPartitions(*order)
    placed, hot = sharded(rows.where(timed), shard_rows)
    whole = whole_series(cut(ordered(hot))) if hot is not None else None
    schema = "patient_id long, concept_key long, source_key long, row_id long, kind string, n long, scatter double, centre double, away double"
    found = cut(ordered(placed).mapInPandas(lambda batches: _blocks(batches, whole), schema))
    series = found.where("row_id is null").groupBy(*SERIES).agg(*[F.max(c).alias(c) for c in ("n", "scatter", "centre")])  # shards of a series say the same
    usual = series.where("n >= 10 and centre > 0").groupBy("concept_key").agg(F.percentile_approx(F.col("scatter") / F.col("centre"), 0.5, 10_000).alias("usual"))
    flagged = found.where("row_id is not null")
    spikes = flagged.where("kind = 'spike'").select(*SERIES, "row_id", "away").join(series, SERIES).join(usual, "concept_key", "left")
    own, prior = F.coalesce("scatter", F.col("usual") * F.col("centre"), F.lit(0.0)), F.coalesce(F.col("usual") * F.col("centre"), "scatter", F.lit(0.0))
    scatter = F.sqrt((F.col("n") * own * own + PRIOR * prior * prior) / (F.col("n") + PRIOR))
    real = spikes.where((F.col("away") > SPIKE_AT * scatter) & (scatter > 0)).select("row_id", F.lit("spike").alias("kind"))
    return flagged.where("kind <> 'spike'").select("row_id", "kind").unionByName(real).unionByName(lone)
