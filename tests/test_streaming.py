"""Streams give what the batch operators give over the same rows."""

import pytest
from pyspark.sql import functions as F

from intervallum.functions.exprs import micros
from intervallum.operators import families
from intervallum.plans import model as M
from intervallum.queries import abstraction as Q
from intervallum.streaming import states


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    """The clicks and views of the event table, delivered in four files out of order within half a day; at the end a mark a year later."""
    rows = Q.event_records(spark, sf_dir).where("concept in ('view', 'click')")
    frame = families.frame(rows, F.upper("concept"), F.array("value"), "raw-concept")
    late = frame.withColumn("_k", micros("start") + F.pmod("ord", F.lit(5)) * 8_640_000_000)
    batch = frame.cache()
    cuts = [r[0] for r in late.selectExpr("percentile(_k, array(0.3, 0.6, 0.8)) as p").select(F.explode("p")).collect()]
    bounds = [float("-inf"), *cuts, float("inf")]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        late.where((F.col("_k") > lo) & (F.col("_k") <= hi)).drop("_k").coalesce(1).write.parquet(str(tmp_path / f"s/{i}"))
    for i in (4, 5):  # nothing but time: lets everything close
        batch.limit(1).withColumns({"patient_id": F.lit(-1).cast("long"), "start": F.col("start") + F.expr(f"interval {300 + i} days"), "concept": F.explode(F.array(F.lit("VIEW"), F.lit("CLICK")))}).select(*batch.columns).coalesce(1).write.parquet(str(tmp_path / f"s/{i}"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "s/*"))
    return batch, source, tmp_path


def finish(spark, df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return sorted((tuple(r) for r in spark.table(name).where("patient_id <> -1").collect()), key=str)


@pytest.mark.parametrize("name", ["VIEW_STATE", "VIEW_STATE_SMOOTH"])
def test_states(spark, stream, name):
    batch, source, tmp = stream
    d = Q.KB.by_name[name]
    got = finish(spark, states.stream_states(d, source, "20 days"), name.lower(), tmp)
    assert got == sorted((tuple(r) for r in Q.label_rows(families.state(d, batch)).collect()), key=str)


def test_trend(spark, stream):
    batch, source, tmp = stream
    d = Q.KB.by_name["CLICK_TREND"]
    got = finish(spark, states.stream_trend_points(d, source, "20 days"), "trend", tmp)
    points = families.trend_points(d, batch).orderBy("patient_id", "t", "ord").collect()
    expected = sorted(((a.patient_id, a.t, b.t, b.label) for a, b in zip(points, points[1:]) if a.patient_id == b.patient_id and b.t - a.t <= 3 * 86_400_000_000), key=str)
    assert got == expected


def test_daily_scores(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/patient_qa_scores.parquet").where("start_date_time is not null")
    rows.coalesce(1).write.parquet(str(tmp_path / "q/0"))
    rows.limit(1).withColumn("start_date_time", F.col("start_date_time") + F.expr("interval 900 days")).withColumn("patient_id", F.lit(-1).cast("long")).coalesce(1).write.parquet(str(tmp_path / "q/1"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "q/*"))
    got = finish(spark, states.stream_daily_scores(source, "60 days"), "daily", tmp_path)
    days = rows.where("compliance_score is not null").groupBy("patient_id", "pattern_name", "compliance_type", F.to_date("start_date_time").alias("day")).count()
    assert len(got) == days.count() and sum(r[5] for r in got) == rows.where("compliance_score is not null").count()


def test_stateless_families_take_streams(spark, stream):
    batch, source, tmp = stream
    d = M.Context("C", derived=(M.Source("VIEW", "raw-concept", 0, "A"),), rules=(M.Rule("Seen", (M.Condition("A", (M.Bound(None, 10),)),)),), windows={None: M.Window(60, 60)})
    got = finish(spark, families.context_windows(d, source).select("patient_id", "start"), "ctx", tmp)
    assert len(got) == families.context_windows(d, batch).count()
