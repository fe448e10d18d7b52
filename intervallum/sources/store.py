"""Writing results: the output and score tables, partial re-runs, exports and a report of failures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervallum.plans.engine import Abstraction, first_of_key
from intervallum.plans.knowledge import KnowledgeBase
from intervallum.sources.records import table_exists
from intervallum.tables import store

OUTPUT_KEY = ["patient_id", "concept_name", "start_date_time"]
SCORE_KEY = ["patient_id", "pattern_name", "start_date_time", "compliance_type"]


def write_outputs(rows: DataFrame, path: str) -> None:
    """Replace the partitions (concepts) that `rows` has; others stay. Files are partitioned by concept."""
    _replace(rows, path, "concept_name")


def write_scores(rows: DataFrame, path: str) -> None:
    """Replace the scores of the patterns that `rows` has; first of each key."""
    _replace(first_of_key(rows, SCORE_KEY, ["end_date_time", "compliance_score"]), path, "pattern_name")


def _replace(rows: DataFrame, path: str, by: str) -> None:
    (rows.repartition(F.col(by), F.pmod(F.xxhash64("patient_id"), F.lit(32))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def drop_stale(spark: SparkSession, path: str, by: str, names: Iterable[str]) -> None:
    """Delete the partitions of the given concepts or patterns."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in names:
        p = hadoop.Path(f"{path}/{by}={n}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)


def rerun(records: DataFrame, kb: KnowledgeBase, changed: Iterable[str], outputs: str, scores: str) -> list[str]:
    """Recompute the changed definitions and all that depend on them. Returns what was recomputed.

    New rows are computed and stored first, then they replace the old ones; only then old rows of definitions without new ones
    are deleted. So a run that fails leaves the tables as they were.
    """
    spark = records.sparkSession
    names = sorted(n for n in kb.dependants(changed) if n in kb.by_name)
    run = Abstraction(records, kb, cut_after=1)
    written = [n for n in names if kb.by_name[n].family not in ("raw-concept", "parameterized-raw-concept")]
    found = [n for n in written if kb.by_name[n].family.endswith("pattern")]
    new_rows = store(run.outputs(written)) if written else None
    new_scores = store(run.scores(found)) if found else None
    for new, path, by, write in ((new_rows, outputs, "concept_name", write_outputs), (new_scores, scores, "pattern_name", write_scores)):
        there = set()
        if new is not None:
            write(new, path)
            there = {r[0] for r in new.select(by).distinct().collect()}  # as many as definitions
        drop_stale(spark, path, by, [n for n in names if n not in there])
    return names


def export_csv(table: DataFrame, path: str) -> None:
    """CSV files with a header; quotes doubled."""
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_first(rows: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """Append rows whose key is not in the table yet; of several new ones the first."""
    spark = rows.sparkSession
    new = first_of_key(rows, key, order)
    if table_exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def failure_report(records: DataFrame, run: Abstraction) -> DataFrame:
    """(concept, rows_in, rows_out): how many input rows of each raw concept could not be used; expressions never fail a job."""
    raw = [d for d in run.kb.by_name.values() if d.family == "raw-concept" and d.concept_type != "raw"]
    names = [(d.name, a.name) for d in raw for a in d.attributes]
    of = records.sparkSession.createDataFrame(names, "definition string, concept string")
    rows_in = records.join(F.broadcast(of), "concept").groupBy("definition").agg(F.count("*").alias("rows_in"))
    out = None
    for d in raw:
        part = run[d.name].select(F.lit(d.name).alias("definition"))
        out = part if out is None else out.unionByName(part)
    rows_out = out.groupBy("definition").agg(F.count("*").alias("rows_out"))
    both = rows_in.join(rows_out, "definition", "left")
    return both.select(F.col("definition").alias("concept"), "rows_in", F.coalesce("rows_out", F.lit(0)).alias("rows_out")).where("rows_in > rows_out")
