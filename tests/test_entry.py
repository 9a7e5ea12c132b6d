"""Registered queries against their SQL, over small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(name for name in entry.plans.queries())


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.10g}") + 0.0
    return float(value) if hasattr(value, "is_finite") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_flagship_has_rows(spark):
    assert entry.entry(spark).columns == ["doc_id", "lines", "verdict"]
    assert not entry.entry(spark).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    made = entry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    rows = [tuple(map(plain, r)) for r in made.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    order = [found.columns.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(wanted, key=key)
