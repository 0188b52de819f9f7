"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from textquarry.plans import queries as engine

SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def compare(spark, duck, name, found, sql):
    got, want = found[name](spark, SMALL).toPandas(), duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_against_sql(spark, duck, name):
    compare(spark, duck, name, engine.QUERIES, engine.ORACLES)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
