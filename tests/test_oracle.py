"""Every registered query with a SQL twin agrees with DuckDB on sf0.001."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from telewatch.plans.registry import entries
from telewatch.sources.tables import TABLES

from .conftest import SF001

SLOW = {"m12_model_comparison", "r5_model_level"}
NAMES = set(entries())         # the training-data queries have their own tests


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(NAMES & set(E.oracle_sql())))
def test_query_matches_duckdb(spark, con, name):
    got = E.queries()[name](spark, SF001).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"system_id", "total", "anomalies", "healthy_pct"}


@pytest.mark.parametrize("name", sorted(NAMES - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF001).count() >= 0
