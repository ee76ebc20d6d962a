"""Every query against its SQL on the smallest tables; all of them through the entry module's contract."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    from shelfmark.plans import catalogue

    return sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, duck, name):
    from shelfmark.plans import catalogue

    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got or name
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["folder", "files", "size", "packed", "ratio_known", "packed_known"]
    assert set(e.oracle_sql()) <= set(e.queries())
