"""The queries of this package that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from voxframe.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.queries()[name](spark, str(DATA))
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns) and expected
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(expected)
