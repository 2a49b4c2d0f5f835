"""Every registered retrieval query with SQL against DuckDB."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from ravelin.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def show(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return f"{float(v):.6f}" if isinstance(v, numbers.Number) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(show, r)) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, tables, name):
    names, got = rows(QUERIES[name](spark, tables).toPandas())
    wanted_names, wanted = rows(duck.execute(ORACLES[name]).df())
    assert names == wanted_names
    assert wanted
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark, tables):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
