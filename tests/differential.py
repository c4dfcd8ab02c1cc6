"""Runs a query and its oracle SQL on the same tables and compares their rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return "null"
        if isinstance(value, float):
            return f"{value:.9g}"
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return f"{float(value):.9g}" if isinstance(value, (int,)) and not isinstance(value, bool) else str(value)

    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None))


def agree(spark, run, sql: str, folder: str = SMALL) -> None:
    got, wanted = run(spark, folder).toPandas(), oracle(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
