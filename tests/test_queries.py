"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime as dt
import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from chronofold.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql, folder=DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    return len(got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["user", "state", "purchases", "spent", "valid_from", "valid_to"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
