"""Queries over the events as time series, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import compare, describe, gates, ingest, joins, lags, memory, ordered, quality
from tidewell.plans.tables import first_period, observations, read
from tidewell.sources import readers
from tidewell.sources.shared import kept

KEY = ["event_type"]
METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(describe.describe(observations(spark, sf_dir), KEY, "value"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.window_counts(observations(spark, sf_dir), "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00")


def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.in_window(observations(spark, sf_dir), "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    days = rows.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n_total"))
    flagged = ingest.with_labels(days, "day", "n_total", low_n=60)
    return flagged.groupBy("event_type", "month", "metric_provenance", "low_n").agg(F.count("*").alias("n_days"))


def coverage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.coverage(observations(spark, sf_dir), "event_type", "ts", "value"))


def diagnostic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.diagnostic_flags(observations(spark, sf_dir), "event_type", "value"))


def metric_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the line items' four metrics: discounts and taxes are shares, quantities are counts, and all may hang on quantity or price."""
    found = quality.metric_flags(read(spark, sf_dir, "lineitem"), METRICS, shares=["l_discount", "l_tax"], counts=["l_quantity"], companions=["l_quantity", "l_extendedprice"])
    return rounded(found)


def scope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"), F.max("value").alias("top")]
    return rounded(describe.by_scope(observations(spark, sf_dir), "event_type", "period", aggregates))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in METRICS])
    return rounded(describe.correlation_matrix(rows, METRICS))


def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in METRICS])
    return rounded(describe.correlation_matrix(rows, METRICS, "spearman"))


def correlation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both correlations of each pair with their t."""
    rows = read(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in METRICS])
    each = [compare.correlation_p(describe.correlation_matrix(rows, METRICS, m)).withColumn("method", F.lit(m)) for m in ("pearson", "spearman")]
    return rounded(each[0].unionByName(each[1]).drop("p"), 5)


def correlation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of both correlations of each pair, and q over all of them by method."""
    rows = read(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in METRICS])
    each = [compare.correlation_p(describe.correlation_matrix(rows, METRICS, m)).withColumn("method", F.lit(m)) for m in ("pearson", "spearman")]
    return rounded(compare.benjamini_hochberg(each[0].unionByName(each[1]), ["method"], "p").select("method", "col_a", "col_b", "p", "q"), 7)


def high_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(spark, sf_dir).where(F.abs("r") > 0.5).select("col_a", "col_b", F.round("r", 4).alias("r"))


def high_correlations_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of characters, spaces and line ends of whole texts whose correlation is over a half."""
    n = lambda x: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(x), F.lit("")))).cast("double")
    rows = read(spark, sf_dir, "documents").select(F.length("text").cast("double").alias("chars"), n(" ").alias("spaces"), n("\n").alias("line_ends"))
    return describe.correlation_matrix(rows, ["chars", "spaces", "line_ends"]).where(F.abs("r") > 0.5).select("col_a", "col_b", "n", F.round("r", 4).alias("r"))


def period_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.two_groups(observations(spark, sf_dir), KEY, first_period(), "value"))


def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.mann_whitney(observations(spark, sf_dir), KEY, first_period(), "value").drop("p"))


def kolmogorov_smirnov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.kolmogorov_smirnov(observations(spark, sf_dir), KEY, first_period(), "value").drop("p"))


def period_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and distribution tests of the periods with p and false-discovery q per family of tests."""
    return rounded(both_tests(observations(spark, sf_dir), KEY, first_period()), 8)


def user_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each user's errors against the user's other events: few values, so that most p are exact."""
    return rounded(both_tests(observations(spark, sf_dir), ["user_id"], F.col("event_type") == "error", least=5), 8)


def both_tests(rows: DataFrame, keys: list[str], side: Column, **least: int) -> DataFrame:
    tests = (("mann_whitney", compare.mann_whitney, "u"), ("kolmogorov_smirnov", compare.kolmogorov_smirnov, "d"))
    u, d = (f(rows, keys, side, "value", **least).select(*keys, F.lit(name).alias("test"), F.col(x).alias("statistic"), "p") for name, f, x in tests)
    return compare.benjamini_hochberg(u.unionByName(d), ["test"], "p")


def empirical_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's share of users with an equal or larger mean, as p, and its q within the event type."""
    means = kept(observations(spark, sf_dir).groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "means")
    steps = ordered.value_steps(means, KEY, "mean", {"n": F.lit(1).cast("long")})
    total = means.groupBy(*KEY).agg(F.count("*").alias("total"))
    p = ordered.beside(steps, total, KEY, ["total"]).withColumn("p", (F.col("total") - F.col("up_to_n") + F.col("n")) / F.col("total"))
    return rounded(compare.benjamini_hochberg(ordered.beside(means, p, [*KEY, "mean"], ["p"]), KEY, "p"))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.sensitivity(observations(spark, sf_dir), KEY, F.col("user_id") % 10 == 0, "value"))


def sensitivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.sensitivity_table(observations(spark, sf_dir), KEY, F.col("user_id") % 10 == 0, "value"))


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each series that break the gates on the observations, and whether the gates hold."""
    rows = gates.require_columns(observations(spark, sf_dir), ["ts", "event_type", "value", "user_id"])
    found = {"has_time": (F.col("ts").isNull(), 0), "has_value": (F.col("value").isNull(), 0), "not_above_99": (F.col("value") > 99, 20), "known_user": (F.col("user_id") < 0, 0)}
    return gates.verdicts(rows, KEY, found)


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_index(observations(spark, sf_dir), KEY, ["ts", "event_id"])
    return rounded(compare.trend(rows, KEY, "idx", "value").drop("p"), 8)


def trend_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_index(observations(spark, sf_dir), KEY, ["ts", "event_id"])
    return rounded(compare.trend(rows, KEY, "idx", "value").select(*KEY, "slope", "p"), 7)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_gaps(observations(spark, sf_dir), KEY, "ts", "value", "event_id")
    return rounded(rows.groupBy(*KEY).agg(F.count("gap_h").alias("n"), F.avg("gap_h").alias("mean_gap"), F.max("gap_h").alias("max_gap"), F.avg(F.abs("diff1")).alias("mean_step")))


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.rolling(observations(spark, sf_dir), KEY, ["ts"], "value")
    return rounded(rows.groupBy(*KEY).agg(F.count("roll_mean").alias("n"), F.avg("roll_mean").alias("mean_of_means"), F.avg("roll_std").alias("mean_of_stds"), F.max_by("roll_mean", F.when(F.col("roll_mean").isNotNull(), F.col("ts"))).alias("last_mean")))


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordered.autocorrelation(observations(spark, sf_dir), KEY, ["ts"], "value", [1, 2, 4, 8]))


def outlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = describe.with_robust_z(observations(spark, sf_dir), KEY, "value", normal=True)
    return rounded(ordered.run_summary(ordered.runs(z, KEY, ["ts"], F.abs("rz") > 1), KEY))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("coarse", F.floor("value"))
    ranked = ordered.average_rank(rows, KEY, "coarse")
    return ranked.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("avg_rank").alias("rank_sum"))


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.every_nth(observations(spark, sf_dir), KEY, ["ts", "event_id"], 4).select("event_type", "event_id", "idx")


def first_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.first_by(observations(spark, sf_dir), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")])
    return rows.select("event_type", "user_id", "event_id")


def pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase", "error", "signup"]
    return observations(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).agg(F.min_by("event_id", F.struct("ts", "event_id")))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = observations(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("event_id", "ts")
    right = rows.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return left, right


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    found = joins.nearest(left, right, ordered.seconds(F.col("ts")), ordered.seconds(F.col("error_ts")), "error_id", 300)
    return rounded(found.select("event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"), "delta_s"), 3)


def asof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    found = joins.nearest(left, right, ordered.seconds(F.col("ts")), ordered.seconds(F.col("error_ts")), "error_id", 300)
    return joins.asof_coverage(found, right, "error_id")


def grid_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.grid_resample(observations(spark, sf_dir), KEY, "ts", "value").select("event_type", "g", "value"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    met = joins.within_interval(left, right, ordered.seconds(F.col("ts")), ordered.seconds(F.col("error_ts")), 600)
    return met.select("event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"))


def pairs_of(spark: SparkSession, sf_dir: str, lags: int = 16) -> DataFrame:
    return joins.lag_pairs(observations(spark, sf_dir), KEY, "ts", "value", lags, 1.0, "event_id")


def lag_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.gap_blocks(observations(spark, sf_dir), KEY, ["ts", "event_id"], 1.0)
    return rounded(lags.lag_correlations(rows, KEY, "value", list(range(1, 17))).drop("n_values"))


def lag_same_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    same = (F.col("ts_a") < cut) == (F.col("ts_b") < cut)
    return rounded(pairs_of(spark, sf_dir).groupBy("event_type", "k").agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_straddle"), F.avg(F.when(same, F.col("a") * F.col("b"))).alias("mean_product")))


def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.periodicity_bins(pairs_of(spark, sf_dir, 8), KEY, F.col("a") * F.col("b")))


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.grid_resample(observations(spark, sf_dir), KEY, "ts", "value")


def grid_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 28))


def lag_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 28)
    return rounded(memory.band_means(curve, KEY, "k", "rho", {"mid": (12, 16), "late": (19, 25)}))


def ar1_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 1)
    return rounded(curve.where("k = 1").select("event_type", memory.ar1_time(F.col("rho"), 6.0).alias("tau")))


def detrended_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.detrended(ordered.with_index(observations(spark, sf_dir), KEY, ["ts", "event_id"]), KEY, "idx", "value")
    return rounded(rows.groupBy(*KEY).agg(F.abs(F.round(F.avg("detrended"), 6)).alias("mean"), F.stddev_samp("detrended").alias("std")), 5)


def decay_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 16)
    plain = memory.decay_fits(curve, "event_type", "k", "rho", 6.0).withColumn("model", F.lit("exponential"))
    return plain.unionByName(memory.decay_fits(curve, "event_type", "k", "rho", 6.0, floor=True).withColumn("model", F.lit("floor")))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the pooled r at lags 1 to 16, over 5,000 replicates of blocks of 24."""
    reps = lags.block_replicates(grid_of(spark, sf_dir).withColumnRenamed("g", "idx"), KEY, "value", list(range(1, 17)), block=24, reps=5000, seed=42)
    each = reps.select("event_type", F.posexplode("rho").alias("at", "rho")).withColumn("k", F.col("at") + 1)
    return memory.percentile_interval(each, ["event_type", "k"], "rho")


def interval_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals beside the point estimates, and whether these lie inside."""
    point = memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 16).select("event_type", "k", "rho")
    found = point.join(bootstrap_intervals(spark, sf_dir), ["event_type", "k"])
    return found.withColumn("outside", ~F.col("rho").between(F.col("low"), F.col("high")))


def memory_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lag curve's far band lies above or below its middle one, by series."""
    curve = memory.grid_autocorrelation(grid_of(spark, sf_dir), KEY, "value", 32)
    bands = memory.band_means(curve, KEY, "k", "rho", {"mid": (19, 25), "far": (26, 32)})
    wide = bands.groupBy("event_type").pivot("band", ["mid", "far"]).agg(F.first("mean_rho"))
    return rounded(wide.withColumn("reading", memory.regime(F.col("mid"), F.col("far"))))


def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values within fixed limits (both inclusive) and below the lower one, by series."""
    x = F.col("value")
    return observations(spark, sf_dir).groupBy("event_type").agg(F.count_if(x.between(3, 6)).alias("n_between"), F.count_if(x < 3).alias("n_below"))


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(grid_of(spark, sf_dir))


def changes_of(grid: DataFrame) -> DataFrame:
    """Change points of each series less its trend, over the grid points with readings."""
    flat = memory.detrended(grid, KEY, "g", "value")
    return memory.change_points(flat, "event_type", "g", "detrended", penalties=60)


def change_points_near_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points with the hours of error events up to 12 hours away; the ones without stay."""
    grid = grid_of(spark, sf_dir)
    found = changes_of(grid).where("change_idx IS NOT NULL")
    placed = found.join(grid.select("event_type", F.col("g").alias("change_idx"), "grid_ts"), ["event_type", "change_idx"]).select("event_type", "change_idx", "grid_ts")
    _, errors = sides(spark, sf_dir)
    hours = errors.select(F.date_trunc("hour", F.col("error_ts").cast("timestamp")).alias("error_hour")).distinct()
    return joins.within_interval(placed, hours, ordered.seconds(F.col("grid_ts")), ordered.seconds(F.col("error_hour")), 12 * 3600)


def outlier_clusters(grid: DataFrame, limit: float = 3.5) -> DataFrame:
    """Runs of neighbouring readings of a series' grid (empty points left out) whose robust z exceeds the limit."""
    z = describe.with_robust_z(grid.where("value IS NOT NULL"), KEY, "value", normal=True)
    found = ordered.runs(z, KEY, ["grid_ts"], F.abs("rz") > limit)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return found.withColumn("cluster", F.concat(stamp("start"), F.lit(".."), stamp("end"), F.lit(" (len "), F.col("length").cast("string"), F.lit(")")))


def near_clusters(points: DataFrame, key: str, clusters: DataFrame) -> DataFrame:
    """Points (key, event_type, grid_ts) with the first cluster of their series at most 12 hours away."""
    s = [ordered.seconds(F.col(c)) for c in ("grid_ts", "start", "end")]
    return joins.first_interval(points, clusters, key, *s, "cluster", 12 * 3600, KEY)


def readings_near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each series by the first cluster of grid values beyond a robust z of 1.2 that lies near them."""
    points = observations(spark, sf_dir).select("event_type", "event_id", F.col("ts").cast("timestamp").alias("grid_ts"))
    found = near_clusters(points, "event_id", outlier_clusters(kept(grid_of(spark, sf_dir), "grid"), 1.2))
    return found.groupBy("event_type", "near").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def change_points_near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of each series with the first cluster of its outliers at most 12 hours away; the ones without stay."""
    return changes_near_clusters(kept(grid_of(spark, sf_dir), "grid"))


def changes_near_clusters(grid: DataFrame, limit: float = 3.5) -> DataFrame:
    placed = changes_of(grid).where("change_idx IS NOT NULL").join(grid.select("event_type", F.col("g").alias("change_idx"), "grid_ts"), ["event_type", "change_idx"])
    placed = placed.withColumn("point", F.concat_ws(":", "event_type", "change_idx"))
    return near_clusters(placed, "point", outlier_clusters(grid, limit)).drop("point")


def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", readers.parse_tokens(F.col("props")).alias("m"))
    return rows.groupBy("event_type").agg(F.count("m").alias("n_parsed"), F.sum(F.coalesce(F.try_element_at("m", F.lit("k")), F.lit(0))).alias("k_sum"), F.max(F.size("m")).alias("n_keys"))


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per type and period, with the first period's replaced by medians: a join, not a patch in place."""
    rows = observations(spark, sf_dir)
    base = rows.groupBy("event_type", "period").agg(F.avg("value").alias("level"))
    patch = ordered.quantiles(rows.where("period = 'p1'"), ["event_type", "period"], "value", {"level": 0.5}).drop("n_values")
    return rounded(ingest.overrides(base, patch, ["event_type", "period"], ["level"]))


QUERIES = {
    f.__name__: f
    for f in (
        describe_events, window_counts, labelled_counts, coverage_events, diagnostic_flags, metric_flags, scope_stats, correlations, rank_correlations,
        correlation_tests, correlation_p, high_correlations, high_correlations_of_texts, period_effects, mann_whitney, kolmogorov_smirnov, period_tests, user_tests, empirical_fdr, sensitivity, sensitivity_table, gate_verdicts, trends, trend_p, gaps,
        rolling, autocorrelation, outlier_runs, average_ranks, thinned, first_of_user, pivot_first, asof_nearest, asof_coverage, grid_resample,
        interval_join, lag_curve, lag_same_period, periodicity, grid_autocorrelation, lag_bands, ar1_times, detrended_stats, decay_fits,
        bootstrap_intervals, interval_flags, memory_reading, threshold_scan, change_points, change_points_near_errors, change_points_near_clusters, readings_near_clusters, parsed_props, overridden,
    )
}
