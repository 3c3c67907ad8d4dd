"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.catalog.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == cols
    want = sorted((tuple(rounded(r[order.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
