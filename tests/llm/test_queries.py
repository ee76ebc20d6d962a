"""Queries of the operators that SQL can express, against it."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op1_pq", "op9_substring"])
def test_query_equals_sql(spark, name):
    import duckdb

    from shelfmark.llm import queries as q

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    want = c.execute(q.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())
