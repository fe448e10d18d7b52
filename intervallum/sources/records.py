"""Loading delivered files strictly, and looking at record tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Names under which each column may come, in any letter case.
COLUMN_NAMES = {
    "patient_id": ("PatientId", "patient_id", "Patient Id"),
    "concept_name": ("ConceptName", "concept name"),
    "start_date_time": ("StartDateTime", "Start", "StartTime"),
    "end_date_time": ("EndDateTime", "End", "EndTime"),
    "value": ("Value", "Result"),
    "unit": ("Unit", "Units"),
}
SANE_YEARS = 100


class LoadError(ValueError):
    """A delivery that is refused as a whole."""


def map_columns(columns: Sequence[str], mapping: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Our name -> name in the file. All but unit must be found."""
    there = {c.strip().lower(): c for c in columns}
    out = {}
    for name, variants in COLUMN_NAMES.items():
        wanted = (mapping or {}).get(name, variants)
        found = next((there[v.lower()] for v in wanted if v.lower() in there), None)
        if found is None and name != "unit":
            raise LoadError(f"column {name} is missing; expected one of {', '.join(wanted)}")
        if found is not None:
            out[name] = found
    return out


def utc_seconds(text: Column) -> Column:
    """A time text, with or without offset, as timestamp_ntz in UTC, whole seconds; null if it can't be read."""
    t = F.trim(text)
    zone = F.regexp_extract(t, r"(Z|[+-]\d\d:?\d\d)$", 1)
    local = F.try_to_timestamp(F.regexp_replace(F.replace(t, F.lit("T"), F.lit(" ")), r"\s*(Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.right(zone, F.lit(2)).try_cast("int")
    shift = F.when(zone.rlike(r"\d"), F.when(zone.startswith("-"), 1).otherwise(-1) * (hours * 60 + minutes)).otherwise(0)
    return F.date_trunc("second", local + F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))).cast("timestamp_ntz")


def parsed(raw: DataFrame, mapping: Mapping[str, Sequence[str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns, and those of `keep`, beside `ok_...` flags of what each row must meet."""
    names = map_columns(raw.columns, mapping)
    c = {k: F.col(f"`{v}`").cast("string") for k, v in names.items()}
    number = F.trim(c["patient_id"]).try_cast("decimal(38,6)")
    pid = F.when(number == F.floor(number), number.try_cast("long"))
    filled = lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))
    start, end = utc_seconds(c["start_date_time"]), utc_seconds(c["end_date_time"])
    return raw.select(
        pid.alias("patient_id"), F.trim(c["concept_name"]).alias("concept_name"), start.alias("start_date_time"), end.alias("end_date_time"), c["value"].alias("value"), c.get("unit", F.lit(None).cast("string")).alias("unit"),
        pid.isNotNull().alias("ok_patient"), filled(c["concept_name"]).alias("ok_concept"), filled(c["value"]).alias("ok_value"), start.isNotNull().alias("ok_start"), end.isNotNull().alias("ok_end"), *keep,
    )


def checked(rows: DataFrame) -> DataFrame:
    """`rows` of parsed() if all are valid; else LoadError with the counts. Times far from now give a warning. One aggregate."""
    flags = [c for c in rows.columns if c.startswith("ok_")]
    far = lambda c: F.count_if(F.abs(F.months_between(F.col(c).cast("timestamp"), F.current_timestamp())) > 12 * SANE_YEARS)
    got = rows.agg(*[F.count_if(~F.col(f)).alias(f) for f in flags], far("start_date_time").alias("far_start"), far("end_date_time").alias("far_end"), F.min("start_date_time").alias("first"), F.max("end_date_time").alias("last")).first()
    bad = {f[3:]: got[f] for f in flags if got[f]}
    if bad:
        raise LoadError(f"invalid rows: {bad}; nothing is loaded")
    if got.far_start or got.far_end:
        warnings.warn(f"{got.far_start} starts and {got.far_end} ends lie over {SANE_YEARS} years away ({got['first']} to {got['last']})", stacklevel=2)
    return rows.drop(*flags)


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key; rows that come later are ignored."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def read_csv(spark: SparkSession, path: str, mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All records of CSV files with a header, strictly validated, first of each (patient, concept, start). `ord` grows in order of file and line."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    placed = raw.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    rows = checked(parsed(placed, mapping, keep=("__file", "__block", "__row")))
    return first_rows(rows, ["patient_id", "concept_name", "start_date_time"], ["__file", "__block", "__row"]).drop("__file", "__block").withColumnRenamed("__row", "ord")


def load_csv(spark: SparkSession, path: str, target: str, if_exists: str = "append", mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Load CSV files into the parquet table `target`, all or nothing. if_exists: append (keys that are there stay) or replace.

    `ord` of appended rows goes on after that of the rows that are there, so ties of time keep the order of arrival.
    """
    if if_exists not in ("append", "replace"):
        raise ValueError("if_exists is append or replace")
    rows = read_csv(spark, path, mapping)
    key = ["patient_id", "concept_name", "start_date_time"]
    if if_exists == "append" and table_exists(spark, target):
        there = spark.read.parquet(target)
        rows = rows.join(there.select(*key), key, "left_anti")
        if "ord" in there.columns:
            rows = rows.withColumn("ord", F.col("ord") + F.lit((there.agg(F.max("ord")).first()[0] or 0) + 1))
        else:
            rows = rows.drop("ord")
    rows.write.mode("append" if if_exists == "append" else "overwrite").parquet(target)
    return spark.read.parquet(target)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def patients(records: DataFrame, subset: Iterable[int] | None = None) -> DataFrame:
    """Distinct patients; `subset` None means all, an empty one none. Warns of those that are not there."""
    all_ = records.select("patient_id").where("patient_id is not null").distinct()
    if subset is None:
        return all_
    wanted = sorted(set(subset))
    asked = records.sparkSession.createDataFrame([(p,) for p in wanted], "patient_id long")
    if wanted and (missing := [r.patient_id for r in asked.join(all_, "patient_id", "left_anti").orderBy("patient_id").limit(20).collect()]):
        warnings.warn(f"patients not found: {missing}", stacklevel=2)
    return all_.join(asked, "patient_id", "left_semi")


def scan(records: DataFrame, concepts: Sequence[str], patient_ids: DataFrame | None = None) -> DataFrame:
    """Rows of the concepts (pushed to the file scan), of the given patients."""
    rows = records.where(F.col("concept_name").isin(list(concepts)))
    return rows if patient_ids is None else rows.join(patient_ids, "patient_id", "left_semi")


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_patients) of each table."""
    parts = [df.agg(F.count("*").alias("n_rows"), F.countDistinct("patient_id").alias("n_patients")).select(F.lit(n).alias("table_name"), "n_rows", "n_patients") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(records: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(concept_name, in_data, in_definitions): which concepts are on one side only."""
    there = records.select("concept_name").where("concept_name is not null").distinct().withColumn("in_data", F.lit(True))
    named = records.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "concept_name string").withColumn("in_definitions", F.lit(True))
    return there.join(named, "concept_name", "full").select("concept_name", F.coalesce("in_data", F.lit(False)).alias("in_data"), F.coalesce("in_definitions", F.lit(False)).alias("in_definitions"))


def id_coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per patient id with a flag for each table that has it."""
    out = None
    for n, df in tables.items():
        ids = df.select("patient_id").where("patient_id is not null").distinct().withColumn(f"in_{n}", F.lit(True))
        out = ids if out is None else out.join(ids, "patient_id", "full")
    return out.select("patient_id", *[F.coalesce(f"in_{n}", F.lit(False)).alias(f"in_{n}") for n in tables])
