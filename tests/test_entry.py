"""Every registered query runs at the smallest scale; those with SQL equal DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
