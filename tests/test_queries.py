"""Queries against SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from signalforge import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = [n for n in engine.oracle_sql() if not n.startswith("detect_")]


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = plain(engine.queries()[name](spark, SF).toPandas())
    want = plain(con.sql(engine.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_flagship(spark):
    assert entry.entry(spark).count() == 66
