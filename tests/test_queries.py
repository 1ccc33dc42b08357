"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from smudgeline.plans import registered
from tools.check import TABLES, rows_of

QUERIES, SQL = registered.QUERIES, spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_names():
    assert set(SQL) <= set(spark_entry.queries())
    assert set(QUERIES) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["steps", "n_rows", "accuracy"]
