"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.oracle_sql() if n.startswith("kv_")]


def values(rows):
    return sorted([tuple(repr(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert values(tuple(r[c] for c in names) for r in got.collect()) == values(want.fetchall())


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.k for r in rows] == sorted(r.k for r in rows)


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) >= {n for n in entry.queries() if n.startswith("kv_")}
