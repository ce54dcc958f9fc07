"""Runs a query's SQL in DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "NaT":
            return None
        return float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(repr([plain(x) for x in row]) for row in frame.astype(object).itertuples(index=False))


def expected(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
