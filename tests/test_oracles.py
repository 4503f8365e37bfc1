"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from quire.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text or rounded numbers, rows in order."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
        else:
            df[c] = df[c].astype(float).round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, SF).toPandas()), plain(duck.sql(ORACLES[name]).fetchdf()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
