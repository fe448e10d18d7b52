"""Problem 5: attribute-value rows into one row per entity with typed columns.

The latest readable value of each (entity, attribute) is found by an aggregate that combines before its shuffle, and stored
once. One further shuffle co-partitions the cells by entity. Inside a partition, blocks of whole entities are split by
attribute into typed narrow tables (entity, value), and the narrow tables are combined by full outer joins in a balanced tree:
neighbours first, then the results, and so on. The work grows with the number of cells, not with attributes times cells. An
entity has at most one cell per attribute here, so no block can grow beyond `BLOCK_ROWS` and one entity more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervallum.tables import store

BLOCK_ROWS, MOST_COLUMNS = 100_000, 5_000
#: Texts that stand for no value, and the texts of both truth values.
NO_VALUE = ("", "n/a", "?", "pending", "not done", "nan")
TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
NUMBER = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"
STAMP = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?Z?$"
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "double": "double", "timestamp": "timestamp_ntz", "string": "string"}
KINDS = {"boolean": 0, "integer": 1, "double": 2, "score": 2, "timestamp": 3, "string": 4}


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table."""

    name: str
    kind: str


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def readable(value: Column, kind: Column) -> Column:
    """The value as canonical text of its kind, null if it can't be read."""
    v = trimmed(value)
    low = F.lower(v)
    number = F.when(v.rlike(NUMBER), F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e18), F.coalesce(F.regexp_replace(v, r"[.,]0*$", "").try_cast("bigint"), number.cast("bigint")))
    stamp = F.when(v.rlike(STAMP), F.try_to_timestamp(F.replace(F.regexp_replace(v, "Z$", ""), F.lit("T"), F.lit(" "))).cast("timestamp_ntz"))
    return (
        F.when(kind == "boolean", F.when(low.isin(*TRUE_TEXTS), "true").when(low.isin(*FALSE_TEXTS), "false"))
        .when(kind == "integer", whole.cast("string"))
        .when(kind == "double", number.cast("string"))
        .when(kind == "timestamp", stamp.cast("string"))
        .when(kind == "string", F.when(~low.isin(*NO_VALUE), v))
    )


def attribute_rows(output: DataFrame, scores: DataFrame, concept_catalog: DataFrame) -> DataFrame:
    """(patient_id, attribute, kind, cell text, start_date_time, row_id) of all readable attribute rows and scores."""
    catalog = concept_catalog.select(F.col("concept_name").alias("_name"), "family", F.col("value_type").alias("kind"))
    attributes = output.where(F.col("abstraction_type").isin("event", "context")).join(F.broadcast(catalog), F.col("concept_name") == F.col("_name"))
    facts = attributes.select("patient_id", F.col("concept_name").alias("attribute"), "kind", readable(F.col("value"), F.col("kind")).alias("cell"), "start_date_time", "row_id")
    score = F.col("compliance_score")
    patterns = catalog.where("family = 'pattern'")
    marks = scores.where(score.between(0, 1) & ~F.isnan(score)).join(F.broadcast(patterns), F.col("pattern_name") == F.col("_name"))
    marks = marks.select("patient_id", F.concat_ws("|", "pattern_name", "compliance_type").alias("attribute"), F.lit("score").alias("kind"), score.cast("string").alias("cell"), "start_date_time", "row_id")
    return facts.unionByName(marks).where(F.col("cell").isNotNull() & F.col("patient_id").isNotNull())


def latest(rows: DataFrame) -> DataFrame:
    """(patient_id, attribute, kind, cell): of each the row with the latest start (null oldest), then the smallest row_id."""
    rank = F.struct(F.coalesce(F.unix_micros(F.col("start_date_time").cast("timestamp")), F.lit(-(2**63))).alias("t"), (-F.col("row_id")).alias("r"))
    return rows.groupBy("patient_id", "attribute", "kind").agg(F.max_by("cell", rank).alias("cell"))


def attributes_of(rows: DataFrame, most: int = MOST_COLUMNS) -> list[Attribute]:
    """The columns that the wide table needs; their number is the width of a schema, not of the data, and is checked."""
    found = rows.select("attribute", "kind").distinct().orderBy("attribute", "kind").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} attributes: no wide table")
    kinds: dict[str, str] = {}
    for r in found:
        if kinds.setdefault(r.attribute, r.kind) != r.kind:
            raise ValueError(f"attribute {r.attribute} has two kinds")
    return [Attribute(a, k) for a, k in kinds.items()]


def _outer(a: tuple[np.ndarray, list[pa.Array]], b: tuple[np.ndarray, list[pa.Array]]) -> tuple[np.ndarray, list[pa.Array]]:
    """Full outer join of two tables (ascending keys, columns); columns of a side without the key are null."""
    keys = np.union1d(a[0], b[0])
    columns = []
    for own, values in (a, b):
        at = np.searchsorted(own, keys)
        there = own[np.minimum(at, len(own) - 1)] == keys
        columns += values if there.all() else [v.take(pa.array(at, mask=~there)) for v in values]
    return keys, columns


def _wide_block(part: pa.Table, kinds: Sequence[int]) -> list[pa.Array]:
    """Entity and one array per attribute from cells sorted by entity: e, a (number of the attribute), one column per kind."""
    part = part.combine_chunks()
    array = lambda name: part.column(name).chunk(0)
    e, a = array("e"), array("a").to_numpy()
    new = np.r_[True, pc.not_equal(e.slice(1), e.slice(0, len(e) - 1)).to_numpy(zero_copy_only=False)]
    entity = np.cumsum(new) - 1
    order = np.argsort(a, kind="stable")
    edge = np.searchsorted(a[order], np.arange(len(kinds) + 1))
    values = [array(f"v{k}") for k in range(5)]
    narrow = {}
    for i in np.unique(a).tolist():
        rows = order[edge[i] : edge[i + 1]]
        narrow[i] = (entity[rows], [values[kinds[i]].take(pa.array(rows))])
    tables, place = list(narrow.values()), list(narrow)
    while len(tables) > 1:
        tables = [_outer(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    found = dict(zip(place, tables[0][1]))
    size = int(new.sum())
    return [e.filter(pa.array(new)), *[found[i] if i in found else pa.nulls(size, values[k].type) for i, k in enumerate(kinds)]]


def pivot_balanced(cells: DataFrame, attributes: Sequence[Attribute], entity: str = "patient_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`entity` and one typed column per attribute; `cells`: (entity, attribute, cell) with one row per pair, no nulls.

    Entities without any cell have no row. Attributes keep their names, even if one is named like the entity column
    (then it gets leading underscores). Other columns of `cells` are ignored. No attributes or no rows give an empty table.
    """
    kind_of = cells.schema[entity].dataType.simpleString()
    kinds = [KINDS[a.kind] for a in attributes]
    names, taken = [], {entity.lower()}
    for a in attributes:
        name = a.name
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    if not attributes:
        return cells.select(entity).limit(0)
    known = cells.sparkSession.createDataFrame([(a.name, i, k) for i, (a, k) in enumerate(zip(attributes, kinds))], "__name string, a int, k int")  # as many rows as columns
    types = ["boolean", "bigint", "double", "timestamp_ntz", "string"]
    typed = [F.when(F.col("k") == k, F.col("cell").cast(t)).alias(f"v{k}") for k, t in enumerate(types)]
    rows = cells.join(F.broadcast(known), F.col("attribute") == F.col("__name")).select(F.col(entity).alias("e"), "a", *typed)
    schema = ", ".join([f"e {kind_of}", *[f"c{i} {types[k]}" for i, k in enumerate(kinds)]])
    columns = ["e", *[f"c{i}" for i in range(len(kinds))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in batches:
            if not part.num_rows:
                continue
            held.append(part)
            if sum(b.num_rows for b in held) >= block_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                e = whole.column("e").chunk(0)
                last = np.flatnonzero(pc.not_equal(e, e[-1]).to_numpy(zero_copy_only=False))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield pa.RecordBatch.from_arrays(_wide_block(whole.slice(0, end), kinds), columns)
                held = whole.slice(end).to_batches()
        if held:
            yield pa.RecordBatch.from_arrays(_wide_block(pa.Table.from_batches(held), kinds), columns)

    wide = rows.repartition("e").sortWithinPartitions("e").mapInArrow(run, schema)
    return wide.select(F.col("e").alias(entity), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def cell_text(cell: Column, kind: str) -> Column:
    if kind == "double":
        return F.format_string("%.1f", F.round(cell, 1) + F.lit(0.0))
    if kind == "score":
        return F.format_string("%.3f", F.round(cell, 3) + F.lit(0.0))
    if kind == "timestamp":
        return F.date_format(cell, "yyyy-MM-dd HH:mm:ss")
    return cell.cast("string")


def cells_of(wide: DataFrame, attributes: Sequence[Attribute], entity: str = "patient_id") -> DataFrame:
    """(entity, attribute, cell) of the non-null cells of a wide table, as text."""
    columns = [c for c in wide.columns if c != entity]
    each = F.array(*[F.struct(F.lit(a.name).alias("attribute"), F.when(F.col(f"`{c}`").isNotNull(), cell_text(F.col(f"`{c}`"), a.kind)).alias("cell")) for a, c in zip(attributes, columns)])
    if not columns:
        return wide.select(entity, F.lit("").alias("attribute"), F.lit("").alias("cell")).limit(0)
    return wide.select(entity, F.inline(each)).where(F.col("cell").isNotNull())


def wide_patients(output: DataFrame, scores: DataFrame, concept_catalog: DataFrame) -> tuple[DataFrame, list[Attribute]]:
    """The wide table of all patients, and its attributes in the order of its columns."""
    # stored once: the attributes are found in it, and the plan of each narrow table stays short
    cells = store(latest(attribute_rows(output, scores, concept_catalog)))
    attributes = attributes_of(cells)
    return pivot_balanced(cells, attributes), attributes
