"""Every core query against its SQL on the smallest tables, and those without SQL for rows."""

import pytest

import __spark_entry__
from intervallum.queries import abstraction, analytics, cleaning
from tests.oracle import compare

CORE = {k: v for m in (cleaning, abstraction, analytics) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (cleaning, abstraction, analytics) for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, CORE[name], SQL[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert CORE[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_contract(spark, sf_dir):
    assert set(CORE) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
