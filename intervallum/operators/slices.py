"""Work along a patient's time without gathering the patient.

Time is cut into slices of fixed width, and rows are brought together by (keys, slice), so a patient with a third of all rows is
spread over as many tasks as there are slices. What an operator needs from beyond its slice comes in one of two ways: rows within a bounded
reach are copied to the neighbouring slice (`with_halo`), and running values (the last, the largest so far, the next) are
carried from slice to slice through a summary with one row per slice (`carried`). Intervals meet in slices as well
(`overlap_join`), so that no join compares all rows of a patient.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.tables import cut

DAY = 86_400_000_000
PATIENT = ("patient_id",)


def slice_of(t: Column, width: int) -> Column:
    """Start of the slice of `t` (microseconds)."""
    return t - F.pmod(t, F.lit(width))


def with_slices(rows: DataFrame, t: Column, width: int = DAY, keys: Sequence[str] = PATIENT) -> DataFrame:
    """`rows` with `_slice`, brought together by keys and slice."""
    return rows.withColumn("_slice", slice_of(t, width)).repartition(*keys, "_slice")


def with_halo(rows: DataFrame, t: Column, before: int, after: int = 0) -> DataFrame:
    """The same with copies of the rows that lie up to `before` in front of a slice or `after` behind it; `_own`: no copy."""
    width = max(DAY, 8 * (before + after))
    own = slice_of(t, width)
    copies = F.array_distinct(F.array(own, slice_of(t + before, width), slice_of(t - after, width)))
    out = rows.withColumn("_home", own).withColumn("_slice", F.explode(copies))
    return out.withColumn("_own", F.col("_slice") == F.col("_home")).drop("_home").repartition(*PATIENT, "_slice")


def own_window(*order: str | Column, keys: Sequence[str] = PATIENT):
    return W.partitionBy(*keys, "_slice").orderBy(*order)


def carried(rows: DataFrame, before: Mapping[str, Column], after: Mapping[str, Column] | None = None, keys: Sequence[str] = PATIENT, before_pick=F.last, after_pick=F.first) -> DataFrame:
    """`rows` of with_slices() and, by name, what the slices before (after) say: `before` and `after` are aggregates over a slice.

    Of several slices with a value the last before (first after) counts, or what `before_pick` (`after_pick`) makes of them.
    The rows are stored once: they are read for the summary and again beside it, and chains of operators must not double each time.
    """
    after = after or {}
    rows = cut(rows)
    per = rows.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in {**before, **after}.items()])
    w = W.partitionBy(*keys).orderBy("_slice")  # one row for each slice
    pick = lambda f, n: f(n, ignorenulls=True) if f in (F.last, F.first) else f(n)
    got = per.select(
        *keys, "_slice", *[pick(before_pick, n).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(n) for n in before], *[pick(after_pick, n).over(w.rowsBetween(1, W.unboundedFollowing)).alias(n) for n in after]
    )
    return rows.join(got, [*keys, "_slice"])


def run_starts(rows: DataFrame, new: Column, t: str, out: str = "_run") -> DataFrame:
    """`rows` of with_slices() or with_halo() (own rows) with the (t, ord) of the last row up to each where `new` is true."""
    mark = F.when(new, F.struct(F.col(t).alias("t"), F.col("ord").alias("ord")))
    marked = rows.withColumn("_mark", mark)
    w = own_window(t, "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = carried(marked, {"_last": F.max("_mark")})
    return both.withColumn(out, F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.col("_last"))).drop("_mark", "_last")


def reached(rows: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column, out: str = "_reach") -> DataFrame:
    """`rows` with the largest `high` (microseconds) of the patient's intervals whose `low` is not after `at`; null if there is none."""
    known = intervals.select("patient_id", low.alias("_t"), high.alias("_high"))
    both = with_slices(rows.withColumn("_t", at).withColumn("_row", F.lit(True)).unionByName(known, allowMissingColumns=True), F.col("_t"))
    w = own_window("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    full = carried(both, {"_before": F.max("_high")}, before_pick=F.max)
    return full.withColumn(out, F.greatest(F.max("_high").over(w), "_before")).where("_row").select(*rows.columns, out)


def next_at(rows: DataFrame, at: Column, points: DataFrame, point: Column, out: str) -> DataFrame:
    """`rows` with the first of the patient's points (microseconds) not before `at`."""
    known = points.select("patient_id", point.alias("_t"), point.alias("_point"))
    both = with_slices(rows.withColumn("_t", at).withColumn("_row", F.lit(True)).unionByName(known, allowMissingColumns=True), F.col("_t"))
    w = own_window("_t").rangeBetween(W.currentRow, W.unboundedFollowing)
    full = carried(both, {}, {"_after": F.min("_point")}, after_pick=F.min)
    return full.withColumn(out, F.coalesce(F.min("_point").over(w), "_after")).where("_row").select(*rows.columns, out)


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column], width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of a patient whose closed intervals `a` and `b` (microseconds) share an instant; `right` names its patient `_rp`.

    Both sides are put into every slice they touch; a pair meets in the first slice that both have. Empty intervals meet none.
    how: inner, or left (then a left row comes once per slice without a partner, too).
    """

    def placed(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
        spans = F.when(low <= high, F.sequence(slice_of(low, width), slice_of(high, width), F.lit(width)))
        first = df.withColumn(f"{name}_lo", low).withColumn(f"{name}_hi", high)
        return first.withColumn(f"{name}_at", F.explode_outer(spans) if name == "_a" and how == "left" else F.explode(spans))

    l, r = placed(left, *a, "_a"), placed(right, *b, "_b")
    both = (F.col("patient_id") == F.col("_rp")) & (F.col("_a_at") == F.col("_b_at")) & (F.col("_a_lo") <= F.col("_b_hi")) & (F.col("_b_lo") <= F.col("_a_hi"))
    first = F.col("_a_at") == F.greatest(slice_of(F.col("_a_lo"), width), slice_of(F.col("_b_lo"), width))
    return l.join(r, both & first, how).drop("_a_lo", "_a_hi", "_a_at", "_b_lo", "_b_hi", "_b_at", "_rp")


def with_stretches(rows: DataFrame, reach: int) -> DataFrame:
    """`rows` (`_s`, `_e` in microseconds) with `stretch`: rows of different stretches are more than `reach` apart. Cuts lie between slices."""
    placed = cut(with_slices(rows, F.col("_s")))  # read twice
    per = placed.groupBy("patient_id", "_slice").agg(F.min("_s").alias("_low"), F.max("_e").alias("_high"))
    w = W.partitionBy("patient_id").orderBy("_slice")
    ended = F.max("_high").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = per.withColumn("_cut", F.when(F.coalesce(F.col("_low") > ended + reach, F.lit(True)), F.col("_slice")))
    found = marked.select("patient_id", "_slice", F.last("_cut", ignorenulls=True).over(w).alias("stretch"))
    return placed.join(found, ["patient_id", "_slice"]).drop("_slice")
