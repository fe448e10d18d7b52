"""Command line: load files, run a knowledge base, look at tables, re-run what changed, export.

python -m intervallum load CSV --to RECORDS [--replace]
python -m intervallum run --kb FOLDER --records RECORDS --outputs OUT --scores SCORES [--only NAME ...] [--patients ID ...]
python -m intervallum rerun --kb FOLDER --records RECORDS --outputs OUT --scores SCORES --changed NAME ...
python -m intervallum stats TABLE ... | coverage --kb FOLDER --records RECORDS | export TABLE --to CSV
python -m intervallum kb FOLDER [--json FILE]
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from intervallum.plans import model as M
from intervallum.plans.engine import Abstraction, records_of
from intervallum.plans.knowledge import KnowledgeBase
from intervallum.sources import records, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="intervallum", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load")
    load.add_argument("csv")
    load.add_argument("--to", required=True)
    load.add_argument("--replace", action="store_true")
    for name in ("run", "rerun"):
        run = sub.add_parser(name)
        for flag in ("--kb", "--records", "--outputs", "--scores"):
            run.add_argument(flag, required=True)
        run.add_argument("--only" if name == "run" else "--changed", nargs="+", required=name == "rerun")
        if name == "run":
            run.add_argument("--patients", nargs="+", type=int)
    sub.add_parser("stats").add_argument("tables", nargs="+")
    cover = sub.add_parser("coverage")
    cover.add_argument("--kb", required=True)
    cover.add_argument("--records", required=True)
    export = sub.add_parser("export")
    export.add_argument("table")
    export.add_argument("--to", required=True)
    kb = sub.add_parser("kb")
    kb.add_argument("folder")
    kb.add_argument("--json")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("intervallum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "load":
        print(records.load_csv(spark, a.csv, a.to, "replace" if a.replace else "append").count(), "records")
    elif a.command == "run":
        kb, rows = KnowledgeBase.read(a.kb), spark.read.parquet(a.records)
        if a.patients is not None:
            rows = rows.join(records.patients(rows, a.patients), "patient_id", "left_semi")
        run = Abstraction(records_of(rows), kb, cut_after=1)  # outputs, scores and summary read the stored frames
        names = sorted(kb.closure(a.only)) if a.only else list(kb.by_name)
        written = [n for n in names if kb.by_name[n].family not in ("raw-concept", "parameterized-raw-concept")]
        store.write_outputs(run.outputs(written), a.outputs)
        if patterns := [n for n in written if isinstance(kb.by_name[n], M.Pattern)]:
            store.write_scores(run.scores(patterns), a.scores)
        run.summary().orderBy("concept").show(1000, False)
        store.failure_report(run.records, run).show(1000, False)
    elif a.command == "rerun":
        print("recomputed:", *store.rerun(records_of(spark.read.parquet(a.records)), KnowledgeBase.read(a.kb), a.changed, a.outputs, a.scores))
    elif a.command == "stats":
        records.table_stats({t: spark.read.parquet(t) for t in a.tables}).show(100, False)
    elif a.command == "coverage":
        kb = KnowledgeBase.read(a.kb)
        wanted = [x.name for d in kb.by_name.values() if isinstance(d, M.RawConcept) for x in d.attributes]
        records.coverage(spark.read.parquet(a.records), wanted).where("not (in_data and in_definitions)").orderBy("concept_name").show(1000, False)
    elif a.command == "export":
        store.export_csv(spark.read.parquet(a.table), a.to)
    else:
        kb = KnowledgeBase.read(a.folder)
        kb.metadata(spark).select("name", "family", "needs").show(1000, False)
        if a.json:
            Path(a.json).write_text(kb.to_json(), encoding="utf-8")


if __name__ == "__main__":
    main()
