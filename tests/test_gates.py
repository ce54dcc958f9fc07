"""Gates that stop a job, tables replaced whole or not at all, and merged sketches."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewell.operators import gates, lexical
from tidewell.sources import readers


def test_a_broken_table_stops_the_job(spark):
    whole = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    broken = whole.unionByName(spark.createDataFrame([(3, None)], "x int, y string"))
    assert gates.require_values(whole, ["x", "y"]).collect() == whole.collect()
    with pytest.raises(Exception, match="no value in column y"):
        gates.require_values(broken, ["x", "y"]).collect()
    with pytest.raises(gates.GateError, match="missing columns: z"):
        gates.require_columns(whole, ["x", "z"])
    assert gates.require_count(whole.agg(F.count("*").alias("n")), "n", 2).first().n == 2
    with pytest.raises(Exception, match="n is 3, not 2"):
        gates.require_count(broken.agg(F.count("*").alias("n")), "n", 2).collect()


def test_counts_are_seen_on_the_way(spark):
    df, seen = gates.observed(spark.createDataFrame([(1, "a"), (3, None)], "x int, y string"), ["x", "y"])
    df.write.format("noop").mode("overwrite").save()
    assert gates.check_observed(seen, n_rows=2, missing={"y": 1}) == {"n_rows": 2, "no_x": 0, "no_y": 1}
    with pytest.raises(gates.GateError, match="n_rows is 2, not 5; no_y is 1, not 0"):
        gates.check_observed(seen, n_rows=5, missing={"y": 0})


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    readers.replace_table(spark.range(3), path)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        readers.replace_table(bad, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2] and os.listdir(tmp_path) == ["table"]
    readers.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12] and os.listdir(tmp_path) == ["table"]
    readers.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_a_failed_rename_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    readers.replace_table(spark.range(3), path)
    with pytest.raises(Exception):  # noqa: B017  the parent of the new place is a file
        readers.replace_table(spark.range(2), path + "/part/table" if os.path.isfile(path) else str(next(p for p in (tmp_path / "table").iterdir() if p.suffix == ".parquet")) + "/x")
    assert spark.read.parquet(path).count() == 3


def test_sketches_of_parts_unite(spark):
    rows = spark.range(30_000).selectExpr("id % 3 AS part", "concat('w', id % 9000) AS token")
    got = {r.part: r for r in lexical.vocabulary_sketches(rows, ["part"], "token").collect()}
    assert {k: r.n_exact for k, r in got.items()} == {0: 3000, 1: 3000, 2: 3000, None: 9000}
    assert all(abs(r.n_sketch - r.n_exact) <= r.error_bound * r.n_exact for r in got.values())
