"""Queries of the llm package that SQL can express, against DuckDB on the smallest dataset."""

import glob
import os

import duckdb
import pytest

from busnet.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, SF).toPandas()
    wanted = duck.execute(oracles.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert plain(found) == plain(wanted)
