"""Problem 7: pair each record with the nearest record in time of the same entity, within a tolerance.

Both sides are cut by entity, concept and time shard and hash-partitioned into groups of bounded size. Inside each Arrow group
DuckDB joins backward and forward (ASOF), and the nearer candidate within the tolerance is taken; ties go to the smallest
id. Before the shuffle each side is reduced to its distinct instants (the right side with its smallest id), so re-sent or repeated records
of a hot entity cost nothing, and a time shard of one entity can't grow without bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS, SHARD_SECONDS = 150_000, 86_400
_MATCH = """
with back as (select l.entity, l.concept, l.t, l.tol, r.id, l.t - r.t as gap from l asof join r on l.entity = r.entity and l.concept = r.concept and l.t >= r.t),
ahead as (select l.entity, l.concept, l.t, l.tol, r.id, r.t - l.t as gap from l asof join r on l.entity = r.entity and l.concept = r.concept and l.t <= r.t),
near as (select * from back where gap <= tol union all select * from ahead where gap <= tol)
select entity, concept, t, tol, min(gap) as gap, arg_min(id, {'gap': gap, 'id': id}) as id from near group by entity, concept, t, tol
"""
_connection = None


def _duckdb():
    """One in-memory DuckDB per worker process; one thread, nothing on disk."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    return _connection


def _match(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("entity", pa.int64()), ("concept", pa.string()), ("t", pa.int64()), ("tol", pa.int64()), ("gap", pa.int64()), ("id", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    con = _duckdb()
    con.register("l", left)
    con.register("r", right)
    try:
        found = con.execute(_MATCH).to_arrow_table()
    finally:
        con.unregister("l")
        con.unregister("r")
    return found.cast(schema)


def nearest(left: DataFrame, right: DataFrame, group_rows: int = GROUP_ROWS, shard_seconds: int = SHARD_SECONDS) -> DataFrame:
    """`left` (entity long, concept string, t, tol in microseconds, any other columns) with gap and id of its partner.

    `right`: (entity, concept, t, id); other columns are ignored. Rows without a partner within tol (inclusive), or with a
    null in entity, concept, t or tol, are left out. Equal left rows are kept each; among right rows of one instant, and
    between the one before and the one after at equal distance, the smallest id wins. Columns `gap` and `id` of `left` are
    replaced.
    """
    width = shard_seconds * 1_000_000
    keys = ["entity", "concept", "t", "tol"]
    left = left.drop("gap", "id")
    wanted = left.select(*keys).dropna().where("tol >= 0").distinct()
    offered = right.select("entity", "concept", "t", "id").dropna().groupBy("entity", "concept", "t").agg(F.min("id").alias("id"))
    size = right.count() + left.count()
    groups = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // group_rows))
    shard = lambda c: F.floor(c / F.lit(width))
    group = F.pmod(F.xxhash64("entity", "concept", "shard"), F.lit(groups)).cast("int")
    l = wanted.withColumn("shard", F.explode(F.sequence(shard(F.col("t") - F.col("tol")), shard(F.col("t") + F.col("tol"))))).select(*keys, group.alias("part"))
    r = offered.withColumn("shard", shard(F.col("t"))).select("entity", "concept", "t", "id", group.alias("part"))
    found = l.groupBy("part").cogroup(r.groupBy("part")).applyInArrow(
        lambda a, b: _match(a.drop_columns(["part"]), b.drop_columns(["part"])), "entity long, concept string, t long, tol long, gap long, id long"
    )
    # an instant near a shard's border was asked in both shards
    best = found.groupBy(*keys).agg(F.min_by(F.struct("gap", "id"), F.struct("gap", "id")).alias("best"))
    return left.join(best, keys).select(*left.columns, "best.gap", "best.id")


def pair_doses(doses: DataFrame, inputs: DataFrame, concept_catalog: DataFrame) -> DataFrame:
    """(dose_id, row_id): the nearest row of the dose concept's paired concept, same patient, within its tolerance."""
    pairs = concept_catalog.where("paired_concept is not null and tolerance_minutes is not null").select("concept_name", F.col("paired_concept").alias("concept"), (F.col("tolerance_minutes").cast("long") * 60_000_000).alias("tol"))
    wanted = [r.concept for r in pairs.select("concept").distinct().collect()]  # as many as the catalogue pairs
    micros = F.unix_micros(F.col("start_date_time").cast("timestamp")).alias("t")
    left = doses.join(F.broadcast(pairs), "concept_name").select("dose_id", F.col("patient_id").alias("entity"), "concept", micros, "tol")
    right = inputs.where(F.col("concept_name").isin(wanted)).select(F.col("patient_id").alias("entity"), F.col("concept_name").alias("concept"), micros, F.col("row_id").alias("id"))
    return nearest(left, right).select("dose_id", F.col("id").alias("row_id"))
