"""Coverage audit and diagnostic flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import safe_corr, safe_div
from tidewell.operators.describe import with_robust_z
from tidewell.operators.ordered import beside, neighbour, quantiles, seconds
from tidewell.sources.shared import kept


def coverage(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per series: rows, repeated times, median and largest gap, gaps of over three medians, days without a row, rows a day."""
    behind = neighbour(df, [key], [ts], [ts], "before", back=True)
    gap = (seconds(F.col(ts)) - seconds(F.col("before")[ts])) / 3600
    gaps = kept(behind.select(key, ts, value, gap.alias("gap_h")), "gaps")
    mid = quantiles(gaps, [key], "gap_h", {"median_gap_h": 0.5})
    audit = gaps.join(mid, key, "left").groupBy(key).agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.countDistinct(ts)).alias("n_repeated_times"),
        F.first("median_gap_h").alias("median_gap_h"),
        F.max("gap_h").alias("max_gap_h"),
        F.count_if(F.col("gap_h") > 3 * F.col("median_gap_h")).alias("n_long_gaps"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
        (F.datediff(F.max(ts), F.min(ts)) + 1).alias("n_span_days"),
    )
    days = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    daily = days.groupBy(key).agg(
        F.count("*").alias("n_days"), F.avg("n").alias("mean_per_day"), F.min("n").alias("min_per_day"), F.max("n").alias("max_per_day")
    )
    return audit.join(daily, key).withColumn("n_empty_days", F.col("n_span_days") - F.col("n_days"))


def diagnostic_flags(df: DataFrame, key: str, value: str, *, least_n: int = 50) -> DataFrame:
    """Per series: nearly constant, wildly spread, share at the maximum, zeros, negatives, outside [0, 1], outliers, few values."""
    x = F.col(value)
    top = df.groupBy(key).agg(F.max(x).alias("top"))
    z = with_robust_z(df, [key], value)
    cv = safe_div(F.stddev_samp(x), F.avg(x))
    return z.join(top, key).groupBy(key).agg(
        F.coalesce(F.abs(cv) < 0.01, F.lit(False)).alias("nearly_constant"),
        F.coalesce(F.abs(cv) > 2, F.lit(False)).alias("wild_spread"),
        safe_div(F.count_if(x == F.col("top")), F.count(x).cast("double")).alias("share_at_max"),
        F.count_if(x == 0).alias("n_zero"),
        F.count_if(x < 0).alias("n_negative"),
        F.count_if((x < 0) | (x > 1)).alias("n_outside_unit"),
        F.count_if(F.abs("rz") > 3.5).alias("n_outliers"),
        (F.count(x) < least_n).alias("few_values"),
    )


def metric_flags(
    df: DataFrame, metrics: list[str], *, shares: list[str] = (), counts: list[str] = (), companions: list[str] = (), least_n: int = 50, limit: float = 0.5
) -> DataFrame:
    """The flags of several columns of one table, a row a metric, from one stored long table.

    Only ``shares`` are held against [0, 1], and negatives are counted of all others; values below ``least_n`` are counted of
    ``counts`` alone, whose own level is the number of observations. ``depends_on_`` a companion: size of r over ``limit`` where both
    have a value; false where r is undefined.
    """
    beside_all = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(companions)]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_x")) for m in metrics])
    rows = kept(df.select(*beside_all, F.inline(each)), "metrics")
    top = rows.groupBy("metric").agg(F.max("_x").alias("_top"))
    placed = with_robust_z(beside(rows, top, ["metric"], ["_top"]), ["metric"], "_x")
    x = F.col("_x")
    own = lambda names: F.col("metric").isin(list(names))
    cv = safe_div(F.stddev_samp(x), F.avg(x))
    r = {c: safe_corr(F.when(F.col(f"_c{i}").isNotNull(), x), F.when(x.isNotNull(), F.col(f"_c{i}"))) for i, c in enumerate(companions)}
    return placed.groupBy("metric").agg(
        F.coalesce(F.abs(cv) < 0.01, F.lit(False)).alias("nearly_constant"),
        F.coalesce(F.abs(cv) > 2, F.lit(False)).alias("wild_spread"),
        (F.count_if(x == F.col("_top")) / F.greatest(F.count(x), F.lit(1))).alias("share_at_max"),
        F.count_if(x == 0).alias("n_zero"),
        F.count_if((x < 0) & ~own(shares)).alias("n_negative"),
        F.count_if(((x < 0) | (x > 1)) & own(shares)).alias("n_outside_unit"),
        F.count_if(F.abs("rz") > 3.5).alias("n_outliers"),
        F.count_if((x < least_n) & own(counts)).alias("n_few"),
        *[v.alias(f"r_with_{c}") for c, v in r.items()],
        *[F.coalesce(F.abs(v) > limit, F.lit(False)).alias(f"depends_on_{c}") for c, v in r.items()],
    )
