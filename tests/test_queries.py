"""Every query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest

from chartflow.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return "null"
        if isinstance(x, (pd.Timestamp, datetime.datetime)):
            return str(pd.Timestamp(x).tz_localize(None))
        if isinstance(x, datetime.date):
            return str(pd.Timestamp(x))
        if isinstance(x, (int, float)) or hasattr(x, "item"):
            return repr(round(float(x), 6))
        return str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_python_in_plans(spark):
    for name in ("hourly_gap_fill", "repeat_suppression", "unit_convert", "asof_tolerance"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
