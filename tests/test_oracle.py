"""Every query with SQL gives that SQL's rows, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

DIR = __spark_entry__.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
NAMES = [n for n in SQL if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        path = f"{DIR}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple("~" if pd.isna(v) else v for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)
