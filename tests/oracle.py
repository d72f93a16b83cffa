"""A query's rows against its SQL's in DuckDB, in any order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def _cell(value):
    if pd.isna(value):
        return ""
    kind = type(value).__name__
    if "bool" in kind:
        return str(bool(value))
    return repr(float(value) + 0.0) if "int" in kind or "float" in kind else str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_cell, row)) for row in frame[columns].astype(object).itertuples(index=False))


def assert_same(df, con, sql):
    found, expected = rows_of(df.toPandas()), rows_of(con.execute(sql).df())
    assert found == expected
