"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intervallum.llm import encode, leaks, nearest, subjects
from intervallum.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "input_patient_data", ["row_id", "patient_id", "concept_name", "start_date_time"])
    return nearest.pair_doses(table(spark, sf_dir, "pharmacy_doses"), inputs, table(spark, sf_dir, "concept_catalog"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))


QUERIES = {f.__name__: f for f in (p7_found, p8_ids, p9_found, p10_found)}

SQL = {
    "p7_found": """
with d as (select dose_id, patient_id, paired_concept, tolerance_minutes, start_date_time as t from pharmacy_doses join concept_catalog using (concept_name)
 where patient_id is not null and start_date_time is not null and paired_concept is not null and tolerance_minutes is not null),
m as (select d.dose_id, i.row_id, row_number() over (partition by d.dose_id order by abs(epoch_us(i.start_date_time) - epoch_us(d.t)), i.row_id) as k
 from d join input_patient_data i on i.patient_id = d.patient_id and i.concept_name = d.paired_concept
 and i.start_date_time between d.t - to_minutes(d.tolerance_minutes) and d.t + to_minutes(d.tolerance_minutes))
select dose_id, row_id from m where k = 1""",
}
