"""The driver contract: every query answers, and those with an oracle agree with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "%.6g" % x
    return str([plain(i) for i in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def second():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, second, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        cursor = second.execute(sql)
        there = [d[0] for d in cursor.description]
        assert sorted(there) == columns
        assert got == sorted(tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
