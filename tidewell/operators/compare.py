"""Two groups compared: effect sizes, rank tests, distribution distance, false-discovery control."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import exact, tails
from tidewell.functions.stats import cohens_d, safe_div
from tidewell.operators.ordered import beside, quantiles, ranged, running_sums, value_steps
from tidewell.sources.shared import kept


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: tails.normal_two_sided(x) if pd.notna(x) else None)


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(d: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([tails.kolmogorov(x, a, b) if pd.notna(x) and a and b else None for x, a, b in zip(d, n_a, n_b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([exact.rank_sum_two_sided(x, int(a), int(b)) if pd.notna(x) else None for x, a, b in zip(u, n_a, n_b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def distance_p(d: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([exact.distance_tail(x, int(a), int(b)) if pd.notna(x) else None for x, a, b in zip(d, n_a, n_b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([tails.student_two_sided(x, n) if pd.notna(x) and n > 0 else None for x, n in zip(t, dof, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([tails.chi_square(a, n) for a, n in zip(x, dof, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([tails.binomial_at_least(int(a), int(b), c) for a, b, c in zip(k, n, p, strict=True)], dtype="float64")


def two_groups(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Per key: both means, their difference, deviations and three effect sizes. ``side`` is true for group a."""
    x = F.col(value)
    a, b = F.when(side, x), F.when(~side, x)
    stats = df.groupBy(*keys).agg(
        *[f(v).alias(f"{name}_{g}") for g, v in (("a", a), ("b", b)) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("vpop", F.var_pop))],
        F.stddev_samp(F.when(side.isNotNull(), x)).alias("std_all"),
    )
    sides = df.select(*keys, side.alias("_a"), x.alias("_v")).where("_a IS NOT NULL")
    mid = quantiles(sides, [*keys, "_a"], "_v", {"m": 0.5}).groupBy(*keys).agg(F.max(F.when(F.col("_a"), F.col("m"))).alias("median_a"), F.max(F.when(~F.col("_a"), F.col("m"))).alias("median_b"))
    stats = beside(stats, mid, keys, ["median_a", "median_b"])
    c = {n: F.col(n) for n in stats.columns}
    return stats.select(
        *keys,
        "n_a",
        "n_b",
        "mean_a",
        "mean_b",
        (c["mean_a"] - c["mean_b"]).alias("diff"),
        "median_a",
        "median_b",
        cohens_d("pooled", c["n_a"], c["n_b"], c["mean_a"], c["mean_b"], c["var_a"], c["var_b"]).alias("d_pooled"),
        cohens_d("average", c["n_a"], c["n_b"], c["mean_a"], c["mean_b"], c["vpop_a"], c["vpop_b"]).alias("d_average"),
        safe_div(c["mean_a"] - c["mean_b"], c["std_all"]).alias("d_joint"),
    )


def side_steps(df: DataFrame, keys: list[str], side: Column, value: str, weight: Column | None = None) -> DataFrame:
    """Per key and distinct value: rows of both sides (or their weights), ``a`` and ``b``, and of values up to it. Null values and sides count as no row."""
    rows = df.select(*keys, side.alias("_a"), F.col(value).alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    there = F.col("_v").isNotNull()
    amount = lambda own: F.when(own & there, F.col("_w")).otherwise(F.lit(0).cast("long"))
    return value_steps(rows, keys, "_v", {"a": amount(F.col("_a")), "b": amount(~F.col("_a"))})


#: Fewest values on each side for a p value.
LEAST = 3


def mann_whitney(df: DataFrame, keys: list[str], side: Column, value: str, *, least: int = LEAST) -> DataFrame:
    """U of group a, its tie-corrected normal z (continuity-corrected) and two-sided p; p is NULL below ``least`` values on a side.

    p is exact where no values are tied and the smaller side has at most ``exact.SMALL_RANKS``, else normal.
    """
    t = F.col("a") + F.col("b")
    rank = F.col("up_to_a") + F.col("up_to_b") - (t - 1) / 2.0
    cubes = t.cast("double") * t * t - t
    u = side_steps(df, keys, side, value).groupBy(*keys).agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.when(F.col("a") > 0, F.col("a") * rank)).alias("ranks"), F.sum(cubes).alias("ties")
    ).where("n_a + n_b > 0")
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    stat = F.col("ranks") - n_a * (n_a + 1) / 2
    spread = F.sqrt(n_a * n_b / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(stat - n_a * n_b / 2) - 0.5) / F.nullif(spread, F.lit(0.0))
    small = (F.least("n_a", "n_b") <= exact.SMALL_RANKS) & (F.col("ties") == 0)
    tested = u.withColumns({"u": stat, "z": F.greatest(z, F.lit(0.0)), "_few": F.least("n_a", "n_b") < least, "_small": small})
    p = F.coalesce(rank_sum_p(F.when(F.col("_small") & ~F.col("_few"), F.col("u")), "n_a", "n_b"), normal_p(F.when(~F.col("_small") & ~F.col("_few"), F.col("z"))))
    return tested.select(*keys, "n_a", "n_b", "u", "z", p.alias("p"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], side: Column, value: str, *, least: int = LEAST, weight: Column | None = None) -> DataFrame:
    """Largest distance of the two empirical distributions and its p, NULL below ``least`` values on a side. Tied values step together.

    p is exact up to ``exact.SMALL_DISTANCES`` values on the larger side, else asymptotic.
    """
    steps = side_steps(df, keys, side, value, weight)
    sized = beside(steps, steps.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")), keys, ["n_a", "n_b"])
    share = lambda g: F.col(f"up_to_{g}") / F.nullif(F.col(f"n_{g}").cast("double"), F.lit(0.0))
    far = sized.groupBy(*keys, "n_a", "n_b").agg(F.max(F.abs(share("a") - share("b"))).alias("d")).where("n_a + n_b > 0")
    enough, small = F.least("n_a", "n_b") >= least, F.greatest("n_a", "n_b") <= exact.SMALL_DISTANCES
    p = F.coalesce(distance_p(F.when(enough & small, F.col("d")), "n_a", "n_b"), kolmogorov_p(F.when(enough & ~small, F.col("d")), "n_a", "n_b"))
    return far.withColumn("p", p)


def benjamini_hochberg(df: DataFrame, family: list[str], p: str) -> DataFrame:
    """Adds q within each family of tests; null p values are skipped and keep a null q.

    Distinct p values are put in order by ranges; a range takes the least p * size / rank of the ranges above it.
    """
    df = kept(df, "tests")
    steps = kept(df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count("*").alias("_n")), "steps")
    placed = ranged(steps, family, p).withColumnRenamed("_b", "_range")
    sums = running_sums(placed, family, [p], {"_up_to": F.col("_n")}, bucket=F.col("_range"))
    sized = beside(sums, steps.groupBy(*family).agg(F.sum("_n").alias("_size")), family, ["_size"])
    raw = kept(sized.withColumn("_raw", F.col(p) * F.col("_size") / (F.col("_up_to") - F.col("_n") + 1)).select(*family, p, "_range", "_raw"), "raw")
    above = Window.partitionBy(*family).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy(*family, "_range").agg(F.min("_raw").alias("_least")).withColumn("_above", F.min("_least").over(above))
    down = Window.partitionBy(*family, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = beside(raw.withColumn("_own", F.min("_raw").over(down)), least, [*family, "_range"], ["_above"])
    q = own.withColumn("q", F.least(F.lit(1.0), "_own", "_above"))
    return beside(df, q, [*family, p], ["q"])


def sensitivity(df: DataFrame, keys: list[str], flag: Column, value: str) -> DataFrame:
    """Means with and without flagged rows, and the difference in percent of the population deviation."""
    x = F.col(value)
    unflagged = F.when(~flag, x)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.count(unflagged).alias("n_without"),
        F.avg(x).alias("mean_with"),
        F.avg(unflagged).alias("mean_without"),
        (safe_div(F.abs(F.avg(x) - F.avg(unflagged)), F.stddev_pop(x)) * 100).alias("pct_of_std"),
    )


def sensitivity_table(df: DataFrame, keys: list[str], flag: Column, value: str) -> DataFrame:
    """Values with and without flagged rows: counts, means, medians, sample deviations, and the difference of means in percent of the deviation."""
    x = F.col(value)
    rows = df.select(*keys, x.alias("_x"), F.coalesce(flag, F.lit(False)).alias("_f"))
    scopes = F.when(F.col("_f"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without")))
    long = rows.withColumn("_scope", F.explode(scopes))
    stats = long.groupBy(*keys, "_scope").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
    stats = beside(stats, quantiles(long, [*keys, "_scope"], "_x", {"median": 0.5}), [*keys, "_scope"], ["median"])
    side = lambda s, c: F.max(F.when(F.col("_scope") == s, F.col(c))).alias(f"{c}_{s}")
    wide = stats.groupBy(*keys).agg(*[side(s, c) for s in ("all", "without") for c in ("n", "mean", "median", "std")])
    flagged = rows.groupBy(*keys).agg(F.count_if("_f").alias("n_flagged"))
    diff = F.col("mean_without") - F.col("mean_all")
    return beside(wide, flagged, keys, ["n_flagged"]).withColumns({"diff": diff, "pct_of_std": safe_div(F.abs(diff), F.col("std_all")) * 100})


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and R2 of y on x, with the slope's two-sided p."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0)))
    return fit.withColumn("p", student_p(F.when(F.col("n") > 2, t), (F.col("n") - 2).cast("double")))


def correlation_p(matrix: DataFrame) -> DataFrame:
    """Adds t and the two-sided p to a table of correlations r over n rows; NULL below three rows and for r of 1 or -1."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return matrix.withColumn("t", F.when(F.col("n") > 2, t)).withColumn("p", student_p("t", (F.col("n") - 2).cast("double")))


def uniform_tests(frequencies: DataFrame, expected: float) -> DataFrame:
    """Of a table of category counts n: chi-square against uniform, and the top category's one-sided binomial p."""
    one = frequencies.agg(
        F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("k"), F.max("n").cast("double").alias("top"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares")
    )
    chi = F.col("squares") * F.col("k") / F.col("total") - F.col("total")
    return one.where("total > 0").select("total", "top", chi.alias("chi2"), chi_square_p(chi, F.col("k") - 1).alias("p_chi2"), binomial_p("top", "total", F.lit(expected)).alias("p_top"))


def compare_tables(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Two versions of a result table side by side: keys, column, old, new, diff, agrees, found_in.

    Values agree if both are missing or differ by less than the tolerance; rows of one version alone do not agree. Keys may be null.
    """
    a = old.select(*keys, *columns, F.lit(True).alias("_a"))
    b = new.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *columns)], F.lit(True).alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = a.join(b, same, "full")
    place = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "old").otherwise("new")
    each = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("old"), F.col(f"_{c}").cast("double").alias("new")) for c in columns]
    rows = both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], place.alias("found_in"), F.explode(F.array(*each)).alias("x")).select(*keys, "found_in", "x.*")
    near = F.coalesce(F.abs(F.col("old") - F.col("new")) < tolerance, F.col("old").isNull() & F.col("new").isNull())
    return rows.withColumns({"diff": F.col("new") - F.col("old"), "agrees": near & (F.col("found_in") == "both")})


def baseline_stats(df: DataFrame, keys: list[str], baseline: Column, value: str, note: str) -> DataFrame:
    """Per key: count, mean, sample deviation and range of the baseline's rows, with a note where it has none."""
    x = F.when(baseline, F.col(value))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.when(F.count(x) == 0, note).otherwise("").alias("note")
    )


def against_baseline(df: DataFrame, keys: list[str], baseline: Column, value: str) -> DataFrame:
    """Per key: both means, population deviations, difference, effect size, U with z and p, and the percent of
    real values up to the baseline's mean."""
    x = F.col(value)
    real, base = F.when(~baseline, x), F.when(baseline, x)
    level = df.groupBy(*keys).agg(F.avg(base).alias("base_mean"), F.stddev_pop(real).alias("real_std"), F.stddev_pop(base).alias("base_std"))
    up_to = df.where(~baseline & x.isNotNull()).join(level, keys).groupBy(*keys).agg((F.avg((x <= F.col("base_mean")).cast("double")) * 100).alias("percentile"))
    effect = two_groups(df, keys, ~baseline, value).select(*keys, "n_a", "n_b", F.col("mean_a").alias("real_mean"), "diff", "d_pooled")
    u = mann_whitney(df, keys, ~baseline, value).select(*keys, "u", "z", "p")
    return effect.join(level, keys).join(up_to, keys, "left").join(u, keys, "left")


def against_null(df: DataFrame, keys: list[str], observed: Column, value: str) -> DataFrame:
    """Per key: count, mean and population deviation of observed and null values, their distribution distance with p, and whether the
    observed ones are tighter (less than 0.9 of the null's deviation) or displaced (means over 0.05 apart)."""
    x = F.col(value)
    sides = (("obs", F.when(observed, x)), ("null", F.when(~observed, x)))
    stats = df.groupBy(*keys).agg(*[f(v).alias(f"{name}_{g}") for g, v in sides for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))])
    return null_readings(stats, kolmogorov_smirnov(df, keys, observed, value), keys)


def null_readings(stats: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    table = stats.withColumns({"mean_diff": F.col("mean_obs") - F.col("mean_null"), "std_ratio": safe_div(F.col("std_obs"), F.col("std_null"))})
    return beside(table, distances.select(*keys, "d", "p"), keys, ["d", "p"]).withColumns({"tighter": F.col("std_ratio") < 0.9, "displaced": F.abs("mean_diff") > 0.05})


def against_null_sums(seen: DataFrame, sums: DataFrame, null: str, keys: list[str], value: str) -> DataFrame:
    """``against_null`` of observed values (keys, value), against each null of which there are sums by ``null`` and the keys: ``n``, ``mean`` and ``m2``
    (squared distances from it) of parts of its values, and their ``counts`` at ``values``, where those between two observed ones may stand together."""
    own = seen.groupBy(*keys).agg(F.count(value).alias("n_obs"), F.avg(value).alias("mean_obs"), F.stddev_pop(value).alias("std_obs"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean
    nulls = sums.groupBy(null, *keys).agg(n.alias("n_null"), mean.alias("mean_null"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std_null"))
    stats = beside(nulls, own, keys, ["n_obs", "mean_obs", "std_obs"]).select(null, *keys, "n_obs", "mean_obs", "std_obs", "n_null", "mean_null", "std_null")
    counted = sums.select(null, *keys, F.inline(F.arrays_zip("values", "counts"))).select(null, *keys, F.col("values").alias("_x"), F.col("counts").alias("_n"), F.lit(False).alias("_o"))
    both = nulls.select(null, *keys).join(seen, keys).select(null, *keys, F.col(value).alias("_x"), F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_o"))
    return null_readings(stats, kolmogorov_smirnov(both.unionByName(counted), [null, *keys], F.col("_o"), "_x", weight=F.col("_n")), [null, *keys])


def two_largest_periods(df: DataFrame, period: str) -> DataFrame:
    """The two periods with the most rows (ties: the earlier one), in order: ``first`` and ``second``."""
    largest = df.where(F.col(period).isNotNull()).groupBy(period).agg(F.count("*").alias("n")).orderBy(F.desc("n"), period).limit(2)
    return largest.agg(F.min(period).alias("first"), F.max(period).alias("second")).where("first < second")


def period_table(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """The two most populous periods against each other, per key: effect sizes, U and KS tests with p and q over all keys' tests."""
    rows = df.join(F.broadcast(two_largest_periods(df, period))).where(F.col(period).isin(F.col("first"), F.col("second")))
    side = F.col(period) == F.col("first")
    effect = two_groups(rows, [*keys, "first", "second"], side, value)
    u = mann_whitney(rows, keys, side, value).select(*keys, "u", "z", F.col("p").alias("p_u"))
    d = kolmogorov_smirnov(rows, keys, side, value).select(*keys, "d", F.col("p").alias("p_d"))
    tests = u.select(*keys, F.lit("u").alias("test"), F.col("p_u").alias("p")).unionByName(d.select(*keys, F.lit("d").alias("test"), F.col("p_d").alias("p")))
    q = benjamini_hochberg(tests, ["test"], "p").groupBy(*keys).agg(F.max(F.when(F.col("test") == "u", F.col("q"))).alias("q_u"), F.max(F.when(F.col("test") == "d", F.col("q"))).alias("q_d"))
    return effect.join(u, keys, "left").join(d, keys, "left").join(q, keys, "left")
