"""Streaming forms of the window and gap operators; batch DataFrames work as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_stats(df: DataFrame, key: str, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Count, mean and extremes of each key in fixed time buckets; rows later than ``late`` are dropped."""
    return (
        df.withWatermark(ts, late)
        .groupBy(key, F.window(ts, width).alias("bucket"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def gap_sessions(df: DataFrame, key: str, ts: str, value: str, gap: str, late: str) -> DataFrame:
    """Runs of rows of a key without a gap of over ``gap`` between neighbours."""
    return (
        df.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("session"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    )
