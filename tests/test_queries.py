"""Queries with SQL give the rows of the SQL; the others give rows with a stable schema."""

import os

import pytest

from coursemill.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(data):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted([tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in frame.values.tolist()])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, data, name):
    mine = catalog.QUERIES[name](spark, data)
    theirs = db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.toPandas()) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
