"""Compares a query with its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def canonical(df: pd.DataFrame) -> tuple[list[str], Counter]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return repr(round(float(v), 8) + 0.0)
        if isinstance(v, (list, np.ndarray)):
            return str([cell(x) for x in v])
        return str(v)

    names = sorted(df.columns)
    return names, Counter(tuple(cell(v) for v in row) for row in df[names].itertuples(index=False, name=None))


def compare(spark, sf_dir: str, query, sql: str) -> None:
    names, rows = canonical(query(spark, sf_dir).toPandas())
    expected_names, expected = canonical(connection(sf_dir).execute(sql).df())
    assert names == expected_names
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])
