"""Every query with SQL gives the same rows in Spark and in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in e.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = e.queries()[name](spark, SF).toPandas(), duck.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert e.entry(spark).count() > 0
