"""Descriptive statistics of series, correlations and scopes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import normal_mad_z, robust_z, safe_corr, safe_div
from tidewell.operators.ordered import beside, counted_values, step_quantiles, value_steps
from tidewell.sources.shared import kept


def centres(steps: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Median and MAD of ``counted_values``, and the quantiles asked for. The distances from the median are those of the distinct values."""
    centre = kept(step_quantiles(steps, keys, {"median": 0.5} | shares), "centres")
    far = counted_values(beside(steps, centre, keys, ["median"]), keys, F.abs(F.col("_v") - F.col("median")), F.col("n"))
    return beside(centre, step_quantiles(far, keys, {"mad": 0.5}), keys, ["mad"])


def with_robust_z(df: DataFrame, keys: list[str], value: str, *, normal: bool = False) -> DataFrame:
    """Adds median, mad and rz per series; rz is NULL below four values or where the MAD is 0."""
    centre = centres(counted_values(df, keys, F.col(value)), keys, {})
    z = (normal_mad_z if normal else robust_z)(F.col(value), F.col("median"), F.col("mad"))
    return beside(df, centre, keys, ["median", "mad", F.col("n_values").alias("_n")]).withColumn("rz", F.when(F.col("_n") >= 4, z)).drop("_n")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, missing, mean, median, sample deviation, extremes, quantiles (interpolated), cv, MAD, extreme robust z.

    The rows are read twice: for the moments, and for the table of distinct values that all the rest follows from.
    """
    x = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.count_if(x.isNull()).alias("n_missing"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    shares = {f"q{p:02d}": p / 100 for p in (5, 25, 75, 95)}
    steps = kept(counted_values(df, keys, x), "values")
    centre = kept(centres(steps, keys, shares), "centres")
    z = F.when(F.col("n_values") >= 4, robust_z(F.col("_v"), F.col("median"), F.col("mad")))
    extremes = beside(steps, centre, keys, ["n_values", "median", "mad"]).withColumn("rz", z).groupBy(*keys).agg(
        F.min("rz").alias("rz_min"), F.max("rz").alias("rz_max"), F.coalesce(F.sum(F.when(F.abs("rz") > 3.5, F.col("n"))), F.lit(0)).alias("n_outliers")
    )
    both = beside(beside(base, centre, keys, ["median", "mad", *shares]), extremes, keys, ["rz_min", "rz_max", "n_outliers"])
    return both.select(
        *keys, "n", "n_missing", "mean", "median", "std", "min", *shares, "max", safe_div(F.col("std"), F.col("mean")).alias("cv"), "mad", "rz_min", "rz_max", "n_outliers"
    )


def by_scope(df: DataFrame, key: str, period: str, aggregates: list[Column]) -> DataFrame:
    """One row per key and period, and one over all periods (period NULL becomes ``overall``)."""
    return (
        df.groupingSets([[key], [key, period]], key, period)
        .agg(F.grouping(period).alias("_all"), *aggregates)
        .withColumn(period, F.when(F.col("_all") == 1, "overall").otherwise(F.col(period)))
        .drop("_all")
    )


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlations (col_a, col_b, n, r) of the upper triangle; NULL below three rows or if constant."""
    pairs = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in combinations(columns, 2)])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("a IS NOT NULL AND b IS NOT NULL")
    keys = ["col_a", "col_b"]
    if method == "spearman":
        return rank_correlations(rows, keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, safe_corr(F.col("a"), F.col("b"))).alias("r"))


def rank_correlations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's r of ``a`` and ``b`` per key, from the distinct pairs of values and their numbers.

    The mean of tied ranks is known beforehand, (n + 1) / 2, so one pass of sums is left after the ranks are joined.
    """
    pairs = rows.groupBy(*keys, "a", "b").agg(F.count("*").alias("w"))
    for x in ("a", "b"):
        steps = value_steps(pairs, keys, x, {"w": F.col("w")})
        pairs = beside(pairs, steps.withColumn(f"rank_{x}", F.col("up_to_w") - (F.col("w") - 1) / 2.0), [*keys, x], [f"rank_{x}"])
    sized = beside(pairs, pairs.groupBy(*keys).agg(F.sum("w").alias("n")), keys, ["n"])
    a, b = (F.col(f"rank_{x}") - (F.col("n") + 1) / 2.0 for x in ("a", "b"))
    total = lambda x: F.sum(F.col("w") * x)
    r = total(a * b) / F.nullif(F.sqrt(total(a * a)) * F.sqrt(total(b * b)), F.lit(0.0))
    return sized.groupBy(*keys, "n").agg(r.alias("r")).withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def category_frequencies(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts and shares of a fixed list of categories, zeros kept, in the list's order."""
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, categories))).alias("pos", column))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    full = listed.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", safe_div(F.col("n"), F.sum("n").over(Window.partitionBy()).cast("double")))


def mode(frequencies: DataFrame, column: str) -> DataFrame:
    """The most frequent category; ties go to the one listed first."""
    return frequencies.agg(F.max_by(column, F.struct("n", -F.col("pos"))).alias("mode"), F.max("n").alias("n"))
