"""Problem 3: one measured quantity, many units. Every readable value comes out in the common unit of its concept.

1. `readings` reads the number and the unit that a row names (within value, else in unit) on the JVM; they are stored once.
2. Rows that name no unit get one from a calibrated tree ensemble. It sees magnitude, source, category (concept) and
   neighbouring fields (decimals written, the level of the rows of the same source and kind). Its training rows are a
   histogram of ALL rows: (concept, source, named unit, magnitude bin, decimals) with counts, so the shuffle is tiny. Fitting
   takes at most `FIT_CELLS` cells of each (concept, unit), chosen by hash with their counts as weights, so no unit and no
   concept falls out of training. A unit that nobody names is trained on the cells of the named ones, converted to it.
3. The calibrated probabilities of all unnamed rows of a (source, concept) are averaged: a source uses one unit for a
   concept whenever it names none. Averages under `CONFIDENT` go to review and are not converted; so do the unnamed rows of
   a concept of which no row names a unit (probability null), and rows that name a unit that the concept doesn't have.

Units with the same factor and shift (mmol/L and mEq/L of sodium) can't be told apart by any number; an unnamed row of such
a class counts as recorded in the common unit if that is in the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.tables import cut, store

#: Spellings that equal a unit code after lower case, no blanks, "per" as "/" and micro as "u".
EQUAL_UNITS = {
    "mmol/l": ("mm", "mmol/liter", "mmol/litre"),
    "umol/l": ("um", "micromol/l", "mcmol/l"),
    "ng/l": ("pg/ml",),
    "ng/ml": ("ug/l", "mcg/l"),
    "g/l": ("gr/l", "gm/l"),
    "g/dl": ("gr/dl", "gm/dl"),
    "mmhg": ("torr",),
    "kpa": ("kilopascal",),
    "/min": ("bpm", "beats/min", "beats/minute", "1/min", "min-1"),
    "hz": ("1/s", "/s", "s-1"),
    "degc": ("c", "cel", "celsius", "°c", "degreec", "degreesc"),
    "degf": ("f", "fahrenheit", "°f", "degreef", "degreesf"),
    "10^9/l": ("x10e9/l", "10*9/l", "g/l", "giga/l", "10e9/l", "x10^9/l", "k/ul"),
    "/ul": ("cells/ul", "1/ul", "/mm3"),
    "kg": ("kilos", "kilo", "kilogram", "kilograms", "kgs"),
    "g": ("grams", "gram", "gr", "gm"),
    "lb": ("lbs", "pounds", "pound"),
    "meq/l": ("meq/liter", "meq/litre"),
}
#: Texts in `unit` that name no unit (as unit keys).
NO_UNIT = ("", "seevalue", "n/a", "na", "none", "null", "unknown", "-", "?")
NUMBER_TEXT = r"^\s*([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+(?![\d^*/]))?)\s*(.*?)\s*$"
#: Width of a magnitude bin (decades), cells of each (concept, unit) used for fitting, trees, depth, and the mean probability from which a unit is taken.
BIN, FIT_CELLS, TREES, DEPTH, CONFIDENT = 0.02, 2_500, 24, 5, 0.8
#: The table of inferred units is broadcast up to so many rows (a few MB), else joined by shuffle.
BROADCAST_ROWS = 50_000


def unit_key(text: Column) -> Column:
    """A unit text without differences of case, blanks, micro sign and "per"."""
    t = F.regexp_replace(F.lower(text), "[µμ]", "u")
    return F.regexp_replace(F.regexp_replace(t, r"(^|\s)per\s", "/"), r"\s+", "")


def _key(text: str) -> str:
    return text.lower().replace("µ", "u").replace("μ", "u").replace(" ", "")


def spellings(unit_catalog: DataFrame) -> DataFrame:
    """(concept_name, unit_key, unit_ix, unit_code, factor, shift); as small as the unit catalogue, which one driver holds."""
    rows = unit_catalog.select("concept_name", "unit_code", "factor", "shift").dropna(subset=["concept_name", "unit_code"]).distinct().orderBy("concept_name", "unit_code").collect()
    codes: dict[str, dict[str, tuple]] = {}
    for r in rows:
        codes.setdefault(r.concept_name, {})[_key(r.unit_code)] = (r.unit_code, float(r.factor), float(r.shift or 0.0))
    out = []
    for concept, by_key in codes.items():
        known = dict(by_key)
        for key, unit in by_key.items():
            for other in EQUAL_UNITS.get(key, ()):
                known.setdefault(other, unit)
        out += [(concept, k, *v) for k, v in known.items()]
    return unit_catalog.sparkSession.createDataFrame(out, "concept_name string, unit_key string, unit_code string, factor double, shift double")


def readings(rows: DataFrame, spelled: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, concept_name, source_id, x (the number as written, null if none), decimals, unit_code (null if none is named), factor, shift, unknown.

    unknown: the row names a unit that its concept doesn't have, within value or else in unit; its number can't be converted.
    A unit text of `NO_UNIT` names none. Nulls stay nulls.
    """
    number, rest = F.regexp_extract("value", NUMBER_TEXT, 1), F.regexp_extract("value", NUMBER_TEXT, 2)
    named = rows.select(
        *keep,
        *[c for c in ("concept_name", "source_id") if c not in keep],
        F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("_x"),
        F.length(F.regexp_extract(number, r"[.,](\d+)", 1)).alias("decimals"),
        unit_key(rest).alias("_rest"),
        unit_key(F.col("unit")).alias("_unit"),
    )
    small = spelled.select(F.col("concept_name").alias("_concept"), F.col("unit_key").alias("_key"), "unit_code", "factor", "shift")
    text = F.when(F.col("_rest") != "", F.col("_rest")).otherwise(F.col("_unit"))
    found = named.withColumn("_text", F.when(~text.isin(*NO_UNIT), text)).join(F.broadcast(small), (F.col("concept_name") == F.col("_concept")) & (F.col("_text") == F.col("_key")), "left")
    x = F.when(F.abs("_x") < float("inf"), F.col("_x"))
    return found.withColumn("x", x).withColumn("unknown", F.col("_text").isNotNull() & F.col("_key").isNull()).drop("_x", "_rest", "_unit", "_text", "_concept", "_key")


# --- the tree ensemble -----------------------------------------------------------------------------------------------


class Forest:
    """Randomised trees over a few numeric features, fitted to weighted rows; probabilities are calibrated on held-out sources."""

    def __init__(self, classes: int, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.classes, self.trees, self.depth, self.seed = classes, trees, depth, seed
        self.roots: list = []
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        one_hot = np.zeros((len(y), self.classes))
        one_hot[np.arange(len(y)), y] = w
        for _ in range(self.trees):
            weight = one_hot * rng.gamma(1.0, 1.0, len(y))[:, None]
            self.roots.append(self._grow(x, weight, np.arange(len(y)), self.depth, rng))
        return self

    def _grow(self, x: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, rng: np.random.Generator):
        total = weight[at].sum(0)
        leaf = (total + 0.5 / self.classes) / (total.sum() + 0.5)
        if depth == 0 or len(at) < 2 or (total > 0).sum() < 2:
            return leaf
        best = (np.inf, 0, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] - 1)]:
            values = x[at, f]
            low, high = values.min(), values.max()
            if low == high:
                continue
            cuts = np.unique(np.r_[rng.uniform(low, high, 12), np.quantile(values, rng.uniform(0, 1, 4))])
            order = np.argsort(values, kind="stable")
            left = np.cumsum(weight[at][order], 0)
            k = np.searchsorted(values[order], cuts, side="right")
            for c, i in zip(cuts, k):
                if 0 < i < len(at):
                    a, b = left[i - 1], total - left[i - 1]
                    impurity = a.sum() - (a**2).sum() / max(a.sum(), 1e-12) + b.sum() - (b**2).sum() / max(b.sum(), 1e-12)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(c))
        if not np.isfinite(best[0]):
            return leaf
        go = x[at, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, weight, at[go], depth - 1, rng), self._grow(x, weight, at[~go], depth - 1, rng)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))

        def walk(node, at: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                out[at] += node
            elif len(at):
                go = x[at, node[0]] <= node[1]
                walk(node[2], at[go])
                walk(node[3], at[~go])

        for root in self.roots:
            walk(root, np.arange(len(x)))
        return out / max(1, len(self.roots))

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Forest:
        """Monotone map from raw to observed frequency, by pooling adjacent violators over the held-out rows."""
        p = self.raw(x)
        hit = np.zeros_like(p)
        hit[np.arange(len(y)), y] = 1
        score, hit, weight = p.ravel(), hit.ravel(), np.repeat(w, self.classes)
        bins = np.minimum((score * 20).astype(int), 19)
        mass = np.bincount(bins, weight, 20)
        level = [[(np.bincount(bins, weight * hit, 20)[b] + 0.5 * (b + 0.5) / 20) / (mass[b] + 0.5), mass[b] + 0.5, 1] for b in range(20)]
        pooled: list[list[float]] = []
        for item in level:
            pooled.append(list(item))
            while len(pooled) > 1 and pooled[-2][0] > pooled[-1][0]:
                b, a = pooled.pop(), pooled.pop()
                pooled.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        self.knots = (np.arange(20) / 20 + 0.025, np.repeat([p[0] for p in pooled], [int(p[2]) for p in pooled]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.raw(x)
        if self.knots:
            p = np.interp(p, *self.knots) + 1e-9
        return p / p.sum(1, keepdims=True)


def _converted(magnitude: pd.Series, a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """Magnitudes (decades) of readings in unit `a` (factor, shift), as they were in unit `b`."""
    y = 10.0 ** magnitude.to_numpy(float) * a[0] + a[1]
    return np.log10(np.maximum(np.abs((y - b[1]) / b[0]), 1e-9))


def fit_forests(cells: pd.DataFrame, classes: dict[str, dict[str, tuple[float, float]]]) -> dict[str, Forest]:
    """A calibrated forest for each concept with a named unit, from cells (concept_name, source_id, unit_code, level, magnitude, decimals, n).

    A class that no cell names gets the cells of the named ones, converted. A concept with one class needs no forest.
    """
    forests = {}
    for concept, factors in classes.items():
        units = list(factors)
        own = cells[(cells.concept_name == concept) & cells.unit_code.isin(units)]
        if len(units) < 2 or not len(own):
            continue
        made = [
            own[own.unit_code == a].assign(unit_code=b, magnitude=lambda d, a=a, b=b: _converted(d.magnitude, factors[a], factors[b]), level=lambda d, a=a, b=b: _converted(d.level, factors[a], factors[b]))
            for b in units if b not in set(own.unit_code) for a in own.unit_code.unique()
        ]
        own = pd.concat([own, *made], ignore_index=True)
        x, w = own[["magnitude", "level", "decimals"]].to_numpy(float), own.n.to_numpy(float)
        y = own.unit_code.map({u: i for i, u in enumerate(units)}).to_numpy(int)
        w = w / np.bincount(y, w, len(units))[y] * w.sum() / len(units)  # no unit is likelier because more rows name it
        held = pd.util.hash_array(own.source_id.fillna("").to_numpy(object)) % 4 == 0
        if held.all() or not held.any() or len(np.unique(y[~held])) < len(np.unique(y)):
            held = np.arange(len(own)) % 4 == 0
        probe = Forest(len(units)).fit(x[~held], y[~held], w[~held])
        forest = Forest(len(units)).fit(x, y, w)
        forest.knots = probe.calibrate(x[held], y[held], w[held]).knots
        forests[concept] = forest
    return forests


def conversion_classes(unit_catalog: DataFrame, concept_catalog: DataFrame) -> tuple[dict[str, dict[str, tuple[float, float]]], dict[str, dict[str, str]]]:
    """For each concept one unit of every (factor, shift), with them, the common unit first; and each unit's representative."""
    common = {r.concept_name: r.common_unit for r in concept_catalog.select("concept_name", "common_unit").where("common_unit is not null").collect()}
    classes: dict[str, dict[tuple, str]] = {}
    member: dict[str, dict[str, str]] = {}
    rows = sorted(unit_catalog.dropna(subset=["concept_name", "unit_code"]).collect(), key=lambda r: (r.concept_name, r.unit_code != common.get(r.concept_name), r.unit_code))
    for r in rows:
        unit = classes.setdefault(r.concept_name, {}).setdefault((float(r.factor), float(r.shift or 0.0)), r.unit_code)
        member.setdefault(r.concept_name, {})[r.unit_code] = unit
    return {c: {unit: way for way, unit in x.items()} for c, x in classes.items()}, member


def source_units(read: DataFrame, unit_catalog: DataFrame, concept_catalog: DataFrame) -> DataFrame:
    """(concept_name, source_id, unit_code, probability): the unit of the rows of each source that name none. `read`: see readings().

    A (concept, source) has no row if no row of the concept names a unit and its units convert differently.
    """
    classes, member = conversion_classes(unit_catalog, concept_catalog)
    keys = ["concept_name", "source_id", "unit_code"]
    magnitude = F.round(F.log10(F.greatest(F.abs("x"), F.lit(1e-9))) / BIN) * BIN
    cells = cut(read.where("x is not null and not unknown").groupBy(*keys, magnitude.alias("magnitude"), "decimals").agg(F.count("*").alias("n")))
    group = W.partitionBy(*keys)
    cells = cells.withColumn("level", F.sum(F.col("magnitude") * F.col("n")).over(group) / F.sum("n").over(group))
    spread = W.partitionBy("concept_name", "unit_code").orderBy(F.xxhash64(*keys, "magnitude", "decimals"), "source_id", "magnitude", "decimals")
    bounded = cells.where("unit_code is not null").withColumn("_k", F.row_number().over(spread)).where(F.col("_k") <= FIT_CELLS).drop("_k")
    known = bounded.toPandas()  # at most FIT_CELLS of each row of the unit catalogue
    known["unit_code"] = [member.get(c, {}).get(u) for c, u in zip(known.concept_name, known.unit_code)]
    forests = fit_forests(known, classes)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for concept, own in part.groupby("concept_name"):
                units = list(classes.get(concept, {}))
                if concept in forests:
                    p = forests[concept].predict(own[["magnitude", "level", "decimals"]].to_numpy(float))
                elif len(units) == 1:  # every unit of the concept converts in the same way
                    p = np.ones((len(own), 1))
                else:
                    continue
                for i, unit in enumerate(units):
                    yield pd.DataFrame({"concept_name": concept, "source_id": own.source_id, "unit_code": unit, "p": p[:, i] * own.n, "n": own.n.astype(float)})

    each = cells.where("unit_code is null").drop("unit_code").mapInPandas(predict, "concept_name string, source_id string, unit_code string, p double, n double")
    mean = each.groupBy("concept_name", "source_id", "unit_code").agg((F.sum("p") / F.sum("n")).alias("p"))
    top = mean.groupBy("concept_name", "source_id").agg(F.max_by("unit_code", F.struct("p", "unit_code")).alias("unit_code"), F.max("p").alias("probability"))
    return cut(top)


def harmonise(rows: DataFrame, concept_catalog: DataFrame, unit_catalog: DataFrame, keep: list[str]) -> DataFrame:
    """Every row of a `measure` concept whose value holds a number, in common units. The readings are stored once.

    Columns: `keep`, concept_name, source_id, x, decimals, unit_code, y (in common_unit), factor, common_unit, min_possible,
    max_possible, named (the row named its unit), probability (of an inferred unit), review (the unit is unknown, or inferred
    but not sure enough: unit_code and y are the best guess, null if there is none). Rows without a number are left out.
    Repeated rows are kept each.
    """
    measures = concept_catalog.where("family = 'measure'").select("concept_name", "common_unit", "min_possible", "max_possible")
    spelled = spellings(unit_catalog)
    names = [r.concept_name for r in measures.collect()]
    read = store(readings(rows.where(F.col("concept_name").isin(names)), spelled, keep).where("x is not null"))
    inferred = source_units(read, unit_catalog, concept_catalog)
    units = spelled.groupBy("concept_name", "unit_code").agg(F.first("factor").alias("factor"), F.first("shift").alias("shift"))
    guess = inferred.join(F.broadcast(units), ["concept_name", "unit_code"]).select(
        F.col("concept_name").alias("_c"), F.col("source_id").alias("_s"), F.col("unit_code").alias("_u"), F.col("factor").alias("_f"), F.col("shift").alias("_h"), "probability"
    )
    on = F.col("unit_code").isNull() & ~F.col("unknown") & (F.col("concept_name") == F.col("_c")) & F.col("source_id").eqNullSafe(F.col("_s"))
    if inferred.count() <= BROADCAST_ROWS:
        guess = F.broadcast(guess)
    full = read.join(guess, on, "left").join(F.broadcast(measures), "concept_name")
    factor, shift = F.coalesce("factor", "_f"), F.coalesce("shift", "_h")
    return full.select(
        *keep,
        *[c for c in ("concept_name", "source_id") if c not in keep],
        "x",
        "decimals",
        F.coalesce("unit_code", "_u").alias("unit_code"),
        (F.col("x") * factor + shift).alias("y"),
        factor.alias("factor"),
        "common_unit",
        "min_possible",
        "max_possible",
        F.col("unit_code").isNotNull().alias("named"),
        F.when(F.col("unit_code").isNull(), F.col("probability")).alias("probability"),
        (F.col("unit_code").isNull() & (F.coalesce("probability", F.lit(0.0)) < CONFIDENT)).alias("review"),
    )


def foreign_units(rows: DataFrame, concept_catalog: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """(row_id, unit_code) of possible readings recorded in another unit than the common one; unsure rows are in review instead."""
    y = harmonise(rows, concept_catalog, unit_catalog, ["row_id"])
    possible = F.coalesce(F.col("y") >= F.col("min_possible"), F.lit(True)) & F.coalesce(F.col("y") <= F.col("max_possible"), F.lit(True))
    return y.where(possible & ~F.col("review") & (F.col("unit_code") != F.col("common_unit"))).select("row_id", "unit_code")
