"""The queries of the problems have the columns that are asked for."""

import pytest

from coursemill.llm import queries as q

COLUMNS = {
    "p1_found": [("tbl", "string"), ("key_a", "string"), ("key_b", "string")],
    "p2_found": [("id", "string"), ("cut", "string")],
    "p3_found": [("tbl", "string"), ("row_key", "string"), ("noise", "string")],
    "p4_found": [("request_id", "bigint"), ("defect", "string")],
    "p5_found": [("page_id", "string"), ("line_no", "int")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("kind", "string")],
}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, data, name):
    df = q.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(data):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{data}/{table}'")
    theirs = con.sql(q.ORACLE_SQL[name])
    mine = q.QUERIES[name](spark, data)
    assert sorted(mine.columns) == sorted(theirs.columns)
    order = sorted(mine.columns)
    at = [theirs.columns.index(c) for c in order]
    assert sorted(map(tuple, mine.select(*order).collect())) == sorted(tuple(r[i] for i in at) for r in theirs.fetchall())
