"""Problem 4: fill missing cells from similar records, marking every filled cell.

Functional dependencies (a set of columns determines the target) are mined level by level from the complete records: sets of
one column first, then sets of two out of columns that don't hold alone, and so on. All sets of a level are verified together,
in one pass over all complete records, after a cheap one that needs no shuffle: sketches of all records count the different
determinants of each set and the different pairs of determinant and value; every pair more than a determinant is a record that disagrees,
so a set with too many of them, beyond the sketches' error, can't hold. A set holds if, among its groups of two or more records, the share of records that
agree with the group's commonest value is at least `HOLDS`, over at least `SUPPORT` such records. A set that holds is a minimal
determinant, so no superset of it is tried; neither is a superset of a set with too little support. What is still missing
comes from group fallbacks (most frequent value, or median), ever wider groups up to the whole table.

The determinant dictionaries of all rules form one table (rule, determinant, value), made in one aggregate that combines before
its shuffle. The incomplete rows are exploded into their determinants, left-joined with it and brought back to one row by
the first rule that has a value. So the number of stages doesn't depend on the number of rules. A dictionary of few
determinants goes by broadcast, its size checked; the others by shuffle. Each filled cell carries the rule that filled it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervallum.tables import free_name, store

HOLDS, SUPPORT, LEVELS = 0.9, 50, 3
#: Size of the sketches (log of the registers) and five times their relative error.
SKETCH, SKETCH_ERROR = 13, 5 * 0.0115
#: Dictionaries of so few determinants are broadcast.
SMALL_KEYS = 10_000


@dataclass(frozen=True)
class Dependency:
    """`by` determines `target`; `holds`: share of agreeing records, `support`: records in groups of two or more."""

    by: tuple[str, ...]
    target: str
    holds: float
    support: int


def _determinants(sets: Sequence[Sequence[str]], hashed: bool = False) -> Column:
    """For each set of columns a struct of its number and its values as text, or their hash; sets with a null are left out."""
    det = lambda by: F.xxhash64(*by) if by and hashed else F.lit(0).cast("long") if hashed else F.array(*[F.col(c) for c in by]).cast("array<string>")
    known = [F.when(sum((F.col(c).isNull().cast("int") for c in by), F.lit(0)) == 0, F.struct(F.lit(i).alias("rule"), det(by).alias("det"))) for i, by in enumerate(sets)]
    return F.array_compact(F.array(*known))


def _as_text(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in columns})


def verify(complete: DataFrame, target: str, candidates: Sequence[Sequence[str]], holds: float = HOLDS, support: int = SUPPORT) -> list[Dependency]:
    """The candidates with enough support, best first, whether or not they hold. One pass for all of them; two numbers of each reach the driver.

    Values are counted by 64-bit hashes: only shares are wanted here.
    """
    if not candidates:
        return []
    each = complete.where(F.col(target).isNotNull()).select(F.xxhash64(target).alias("v"), F.inline(_determinants(candidates, hashed=True)))
    cells = each.groupBy("rule", "det", "v").agg(F.count("*").alias("n"))
    groups = cells.groupBy("rule", "det").agg(F.sum("n").alias("all"), F.max("n").alias("top")).where("all > 1")
    got = groups.groupBy("rule").agg(F.sum("all").alias("support"), F.sum("top").alias("agree")).collect()
    found = [Dependency(tuple(candidates[r.rule]), target, r.agree / r.support, r.support) for r in got if r.support >= support]
    return sorted(found, key=lambda d: (-d.holds, len(d.by), d.by))


def possible(complete: DataFrame, target: str, candidates: Sequence[Sequence[str]], holds: float = HOLDS) -> list[tuple[str, ...]]:
    """The candidates that may hold: not those whose records surely disagree more often. One aggregate over all records, no shuffle of them."""
    if not candidates:
        return []
    got = complete.where(F.col(target).isNotNull())
    there = lambda by: sum((F.col(c).isNull().cast("int") for c in by), F.lit(0)) == 0
    sketch = lambda by, *more: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(there(by), F.xxhash64(*by, *more)), SKETCH))
    r = got.agg(*[x for i, by in enumerate(candidates) for x in (sketch(by).alias(f"d{i}"), sketch(by, target).alias(f"p{i}"), F.count_if(there(by)).alias(f"n{i}"))]).first()
    more = lambda i: r[f"p{i}"] - r[f"d{i}"] - SKETCH_ERROR * (r[f"p{i}"] + r[f"d{i}"])
    return [tuple(by) for i, by in enumerate(candidates) if r[f"n{i}"] and more(i) <= (1 - holds) * r[f"n{i}"]]


def mine(complete: DataFrame, target: str, columns: Sequence[str], holds: float = HOLDS, support: int = SUPPORT, levels: int = LEVELS) -> list[Dependency]:
    """The minimal determinants of `target` among sets of up to `levels` of `columns` that hold, best first."""
    found: list[Dependency] = []
    open_ = {frozenset()}  # sets with enough support that don't hold
    for size in range(1, min(levels, len(columns)) + 1):
        tried = [c for c in combinations(columns, size) if all(frozenset(s) in open_ for s in combinations(c, size - 1))]
        if not tried:
            break
        likely = possible(complete, target, tried, holds)
        checked = verify(complete, target, likely, holds, support)
        found += [d for d in checked if d.holds >= holds]
        open_ = {frozenset(d.by) for d in checked if d.holds < holds} | {frozenset(c) for c in tried if c not in likely}
    return sorted(found, key=lambda d: (-d.holds, len(d.by), d.by))


def dictionary(complete: DataFrame, target: str, rules: Sequence[tuple[Sequence[str], bool]]) -> DataFrame:
    """(rule, det, value): of each determinant the commonest value (ties: the smallest), or the median where the rule says so."""
    each = complete.where(F.col(target).isNotNull()).select(F.col(target).alias("v"), F.inline(_determinants([by for by, _ in rules])))
    medians = [i for i, (_, as_number) in enumerate(rules) if as_number]
    cells = each.where(~F.col("rule").isin(medians)).groupBy("rule", "det", "v").agg(F.count("*").alias("n"))
    out = cells.groupBy("rule", "det").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("value"))
    if medians:
        out = out.unionByName(each.where(F.col("rule").isin(medians)).groupBy("rule", "det").agg(F.percentile_approx("v", 0.5, 10_000).alias("value")))
    return out


def fill(
    rows: DataFrame,
    target: str,
    columns: Sequence[str],
    fallbacks: Sequence[Sequence[str]],
    numeric: bool = False,
    holds: float = HOLDS,
    support: int = SUPPORT,
    learn: Column | None = None,
) -> DataFrame:
    """`rows` with null cells of `target` filled, and `<target>_from`: null for given cells, else `fd:...` or `group:...`.

    Determinants are mined among `columns`, from the rows that meet `learn` (default: all) and have the target. A row whose
    determinants are null takes the next rule. If no row of the table has a value, cells stay null with the mark `none`. Rows
    are never dropped or doubled; an empty table stays empty. If `rows` has a column named `<target>_from`, the mark gets
    leading underscores until its name is free.
    """
    mark = free_name(rows, f"{target}_from")
    complete = rows.where(F.col(target).isNotNull())
    if learn is not None:
        complete = complete.where(learn)
    needed = list(dict.fromkeys([*columns, *[c for by in fallbacks for c in by]]))
    complete = store(_as_text(complete.select(*needed, F.col(target).alias("__target")), needed).withColumnRenamed("__target", target))
    found = mine(complete, target, columns, holds, support)
    names = [f"fd:{'+'.join(d.by)}" for d in found] + [f"group:{'+'.join(by) or 'all'}" for by in fallbacks]
    rules = [(d.by, False) for d in found] + [(tuple(by), numeric) for by in fallbacks]
    given = rows.where(F.col(target).isNotNull()).withColumn(mark, F.lit(None).cast("string"))
    row = free_name(rows, "__row")
    open_ = rows.where(F.col(target).isNull()).withColumn(row, F.monotonically_increasing_id())
    if not rules:
        return given.unionByName(open_.drop(row).withColumn(mark, F.lit("none")))
    open_ = store(open_)  # fixes the row numbers
    held = store(dictionary(complete, target, rules))
    keys = {r.rule: r.n for r in held.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    few, total = [], 0
    for i in sorted(keys, key=keys.get):  # the smallest dictionaries, together up to SMALL_KEYS rows
        if total + keys[i] <= SMALL_KEYS:
            few.append(i)
            total += keys[i]
    asked = _as_text(open_.select(row, *needed), needed).select(row, F.inline(_determinants([by for by, _ in rules])))
    parts = [asked.where(F.col("rule").isin(few)).join(F.broadcast(held.where(F.col("rule").isin(few))), ["rule", "det"])]
    if many := [i for i in keys if i not in few]:
        parts.append(asked.where(F.col("rule").isin(many)).join(held.where(F.col("rule").isin(many)), ["rule", "det"]))
    answers = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = answers.groupBy(row).agg(F.min_by("value", "rule").alias("__value"), F.min("rule").alias("__rule"))
    name = F.when(F.col("__rule").isNotNull(), F.get(F.array(*[F.lit(n) for n in names]), F.col("__rule")))
    filled = open_.join(best, row, "left").withColumn(target, F.col("__value")).withColumn(mark, F.coalesce(name, F.lit("none")))
    return given.unionByName(filled.select(*rows.columns, mark))


def repaired_scores(scores: DataFrame, concept_catalog: DataFrame) -> DataFrame:
    """patient_qa_scores with every missing pattern_name and compliance_score filled, and both marks.

    A pattern_name is missing unless the catalogue has it with family `pattern`; a score unless it is a number from 0 to 1.
    Scores are learned from rows with a given name only; a filled name still serves as determinant of its own row.
    """
    known = concept_catalog.where("family = 'pattern'").select(F.col("concept_name").alias("_known")).distinct()
    score = F.col("compliance_score")
    span, mark = free_name(scores, "_span"), free_name(scores, "pattern_name_from")
    rows = (
        scores.join(known, scores.pattern_name == F.col("_known"), "left")
        .withColumn("pattern_name", F.col("_known"))
        .drop("_known")
        .withColumn("compliance_score", F.when(score.between(0, 1) & ~F.isnan(score), score))
        .withColumn(span, F.timestamp_diff("SECOND", F.col("start_date_time"), F.col("end_date_time")))
    )
    times = ["start_date_time", "end_date_time"]
    named = fill(store(rows), "pattern_name", ["patient_id", *times, "compliance_type", span], [("patient_id", "compliance_type"), ("patient_id",), ("compliance_type",), ()])
    groups = [("patient_id", "pattern_name", "start_date_time"), ("patient_id", "pattern_name", "compliance_type"), ("patient_id", "pattern_name"), ("pattern_name", "compliance_type"), ("pattern_name",), ()]
    scored = fill(store(named), "compliance_score", ["patient_id", "pattern_name", *times, "compliance_type"], groups, numeric=True, learn=F.col(mark).isNull())
    return scored.drop(span)


def filled_cells(repaired: DataFrame) -> DataFrame:
    """(row_id, field_name) of the cells that a rule filled; cells that stayed empty (mark `none`) are none."""
    was = lambda c: F.col(f"{c}_from").isNotNull() & (F.col(f"{c}_from") != "none")
    cell = F.explode(F.array_compact(F.array(*[F.when(was(c), F.lit(c)) for c in ("pattern_name", "compliance_score")])))
    return repaired.select("row_id", cell.alias("field_name"))
