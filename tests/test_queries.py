"""Every core query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from voxframe.plans import artifacts, core

QUERIES, SQL = core.queries() | artifacts.queries(), core.oracle_sql() | artifacts.oracle_sql()

DATA = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert _table(df.columns, df.collect()) == _table(columns, expected)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("voxframe.llm"):
        assert {f"p{n}_found" for n in (1, 2, 3, 5, 7, 8)} <= set(entry.queries())
