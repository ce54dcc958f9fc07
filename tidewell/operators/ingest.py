"""Cleaning: time windows, coercion, labels and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import present

LOW_N = 300


def numeric(x: Column) -> Column:
    """Text or number to double; malformed values and NaN are NULL."""
    return present(x.try_cast("double"))


def utc_timestamp(text: Column) -> Column:
    """``2026-04-01 10:00:00 UTC`` or ISO-8601 with an offset, as a timestamp; malformed ones are NULL."""
    bare = F.regexp_replace(F.trim(text), "(?i)\\s*UTC$", "")
    return bare.try_cast("timestamp")


def in_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of the half-open window [start, end)."""
    return df.where((F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType)) & (F.col(ts) < F.lit(end).cast(df.schema[ts].dataType)))


def window_counts(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """How many rows lie before, in and after the window, and without a time: one pass."""
    kind = df.schema[ts].dataType
    t, a, b = F.col(ts), F.lit(start).cast(kind), F.lit(end).cast(kind)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(t < a).alias("n_before"),
        F.count_if((t >= a) & (t < b)).alias("n_in"),
        F.count_if(t >= b).alias("n_after"),
        F.count_if(t.isNull()).alias("n_without_time"),
    )


def with_labels(df: DataFrame, ts: str, n_total: str, *, provenance: str = "real", low_n: int = LOW_N) -> DataFrame:
    """Month label, provenance and the low-n flag: n_total there and at most ``low_n`` (flagged, not excluded)."""
    return df.withColumns(
        {
            "month": F.date_format(ts, "yyyy-MM"),
            "metric_provenance": F.lit(provenance),
            "low_n": F.coalesce(F.col(n_total) <= low_n, F.lit(False)),
        }
    )


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Systematic subsample: rows 0, n, 2n, ... of each series."""
    from tidewell.operators.ordered import with_index

    return with_index(df, keys, order).where(F.col("idx") % n == 0)


def overrides(base: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with the patch's non-null values in ``columns`` where the keys agree; nothing is written in place."""
    named = patch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = base.join(named, keys, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def relabelled(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Labels rewritten by regular expressions, one after the other; null labels stay null."""
    label = F.col(column)
    for pattern, to in rules:
        label = F.regexp_replace(label, pattern, to)
    return df.withColumn(column, label)


def numeric_copy(df: DataFrame, column: str, name: str, flag: str) -> DataFrame:
    """A derived copy of a column, with an exclusion flag that is false in all rows: no value is taken out."""
    return df.withColumns({name: F.col(column), flag: F.lit(False)})


def threshold_lists(df: DataFrame, keys: list[str], value: str, order: list[str], low: float, band: tuple[float, float]) -> DataFrame:
    """The rows below ``low`` or within ``band`` (both ends inclusive), each with its ``list``; nulls are in none.

    Sort by value and ``order`` to read a list in its order.
    """
    x = F.col(value)
    lists = F.array(F.when(x < low, F.lit("below")), F.when(x.between(*band), F.lit("between")))
    return df.select(*keys, *order, value, F.explode(F.array_compact(lists)).alias("list"))
