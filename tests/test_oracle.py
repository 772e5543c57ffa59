"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import pandas as pd
import pytest

from hibiki.plans import catalog

duckdb = pytest.importorskip("duckdb")


def canonical(df):
    df = df[sorted(df.columns)].copy()

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(list(v)) if hasattr(v, "__iter__") and not isinstance(v, (str, bytes, dict)) else str(v)

    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        src = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def whole(df):
    """Integers that came back as floats because of nulls, as integers again."""
    for c in df.columns:
        if df[c].dtype.kind == "f" and df[c].isna().any() and (df[c].dropna() == df[c].dropna().round()).all():
            df[c] = df[c].astype("Int64")
    return df


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, duck, name):
    ours = catalog.QUERIES[name](spark, data)
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(whole(ours.toPandas())) == canonical(whole(theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
