"""Every registered query against DuckDB on the smallest dataset."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from busnet.plans import oracles, queries

SF = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, SF).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _plain(found) == _plain(expected)
    assert len(found) > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4009
