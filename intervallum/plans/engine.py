"""From records and a knowledge base to lazy frames of every definition, over all patients at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.operators import families, patterns
from intervallum.plans import model as M
from intervallum.plans.knowledge import KnowledgeBase
from intervallum.tables import cut


def records_of(df: DataFrame, patient: str = "patient_id", concept: str = "concept_name", start: str = "start_date_time", end: str = "end_date_time", value: str = "value", ordinal: str | None = None) -> DataFrame:
    """Input records in the engine's form. Rows without patient, concept or start are left out; a null end is one second after the start.

    The ordinal is the given column, or `ord` (as the loader writes it); without either a hash of the row breaks ties of time.
    Records of no length are kept, but clipping by global clippers drops them, as it drops every empty interval.
    """
    ordinal = ordinal or ("ord" if "ord" in df.columns else None)
    ord_ = F.col(ordinal).cast("long") if ordinal else F.xxhash64(patient, concept, start, end, value)
    return df.select(F.col(patient).cast("long").alias("patient_id"), F.col(concept).alias("concept"), F.col(start).alias("start"), F.coalesce(F.col(end), F.col(start) + F.expr("interval 1 second")).alias("end"), F.col(value).cast("string").alias("value"), ord_.alias("ord")).dropna(subset=["patient_id", "concept", "start"])


class Abstraction:
    """The frames of a knowledge base over one record table. Frames are made when asked for, each once."""

    def __init__(self, records: DataFrame, kb: KnowledgeBase, cut_after: int = 0):
        """cut_after: store a frame in the shared folder when its chain of definitions is so long (0: never)."""
        self.records, self.kb, self.cut_after = records, kb, cut_after
        self.made: dict[str, DataFrame] = {}
        self.raw_scores: dict[str, DataFrame] = {}
        self.depth: dict[str, int] = {}
        self.bounds = families.clip_bounds(records, kb.clippers) if kb.clippers else None
        self.kept: list[DataFrame] = []

    def __getitem__(self, name: str) -> DataFrame:
        for n in [x for x in self.kb.order() if x in self.kb.closure([name])]:
            if n not in self.made:
                self._make(self.kb.by_name[n])
        return self.made[name]

    def _inputs(self, d: M.Definition) -> DataFrame:
        """Union of the frames a definition needs; a parameter that is not defined has no rows."""
        names = [n for n in d.needs() if n in self.made]
        same = [self.made[n].select(*families.FRAME) for n in names]
        return reduce(DataFrame.unionByName, same)

    def _make(self, d: M.Definition) -> None:
        if isinstance(d, M.RawConcept):
            out = families.raw_concept(d, self.records)
        else:
            sources = self._inputs(d)
            build = {
                M.ParameterizedConcept: families.parameterized_concept, M.Event: families.event, M.State: families.state, M.Trend: families.trend,
                M.Context: families.context, M.LocalPattern: patterns.local_pattern, M.GlobalPattern: patterns.global_pattern,
            }[type(d)]
            out = build(d, sources)
        if self.cut_after and isinstance(d, M.Pattern):
            out = cut(out)  # outputs and scores both read it
        if isinstance(d, M.Pattern):
            self.raw_scores[d.name] = out
        if self.bounds is not None:
            out = families.clip_globally(out, self.bounds)
        depth = 1 + max((self.depth.get(n, 0) for n in d.needs() if n != d.name), default=0)
        if self.cut_after and depth > self.cut_after:
            out, depth = cut(out), 0
        self.depth[d.name] = depth
        self.made[d.name] = out

    def keep(self, names: Iterable[str]) -> None:
        """Cache frames that several others use (memory and disk)."""
        for n in names:
            self.made[n] = self[n].persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(self.made[n])

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def trace(self, name: str) -> dict[str, DataFrame]:
        """Every frame that `name` is made from, and its own."""
        out = self[name]
        return {n: self.made[n] for n in self.kb.order() if n in self.kb.closure([name])} | {name: out}

    def outputs(self, names: Iterable[str] | None = None) -> DataFrame:
        """Intervals of all but the raw concepts (or of `names`), in the form of the output table, first of each key."""
        wanted = [n for n in self.kb.order() if (names is None or n in set(names)) and self.kb.by_name[n].family not in ("raw-concept", "parameterized-raw-concept")]
        if not wanted:
            raise ValueError("no definition with output is asked for")
        return output_rows(reduce(DataFrame.unionByName, [self[n].select(*families.FRAME) for n in wanted]))

    def scores(self, names: Iterable[str] | None = None) -> DataFrame:
        """Compliance scores of all patterns (or of `names`), one row per score. They are not clipped."""
        wanted = [n for n in self.kb.order() if (names is None or n in set(names)) and isinstance(self.kb.by_name[n], M.Pattern)]
        for n in wanted:
            self[n]
        return reduce(DataFrame.unionByName, [score_rows(self.raw_scores[n]) for n in wanted])

    def summary(self) -> DataFrame:
        """(concept, rows) of every definition asked for so far; definitions without rows have 0."""
        parts = [df.select(F.lit(n).alias("concept"), "patient_id") for n, df in self.made.items()]
        counted = reduce(DataFrame.unionByName, parts).groupBy("concept").agg(F.count("*").alias("rows"))
        names = self.records.sparkSession.createDataFrame([(n,) for n in self.made], "concept string")
        return names.join(counted, "concept", "left").select("concept", F.coalesce("rows", F.lit(0)).alias("rows"))


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (insert or ignore)."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def output_rows(frames: DataFrame) -> DataFrame:
    """patient_id, concept_name, start_date_time, end_date_time, value, abstraction_type; a tuple's value is a JSON list."""
    value = F.when(F.size("value") == 1, F.get("value", F.lit(0))).otherwise(F.to_json("value"))
    first = first_of_key(frames, ["patient_id", "concept", "start"], ["ord", "end"])
    return first.select("patient_id", F.col("concept").alias("concept_name"), F.col("start").alias("start_date_time"), F.col("end").alias("end_date_time"), value.alias("value"), F.col("kind").alias("abstraction_type"))


def score_rows(pattern_rows: DataFrame) -> DataFrame:
    """patient_id, pattern_name, start_date_time, end_date_time, compliance_type, compliance_score: one row per score that is not null."""
    long = pattern_rows.select(
        "patient_id", F.col("concept").alias("pattern_name"), F.col("start").alias("start_date_time"), F.col("end").alias("end_date_time"),
        F.expr("stack(3, 'TimeConstraint', time_score, 'ValueConstraint', value_score, 'CyclicConstraint', cyclic_score) as (compliance_type, compliance_score)"),
    )
    return long.where("compliance_score is not null")
