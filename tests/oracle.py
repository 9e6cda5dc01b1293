"""Compares a Spark result with that of DuckDB SQL, as sorted rows of columns sorted by name."""

import numbers
import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def connect(path: str):
    c = duckdb.connect()
    for f in os.listdir(path):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}/{f}'")
    return c


def check(spark, path: str, make, sql: str) -> None:
    got, want = make(spark, path).toPandas(), connect(path).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
