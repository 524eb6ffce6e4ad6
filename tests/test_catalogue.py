"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quire.plans import books, catalogue, layout
from quire.streaming import sync

QUERIES = catalogue.QUERIES | layout.QUERIES | books.QUERIES | sync.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | layout.ORACLE_SQL | books.ORACLE_SQL | sync.ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_oracle(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.project(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns and QUERIES[name](spark, SF).count() >= 0
