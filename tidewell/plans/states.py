"""Queries over states (vectors with layers), log texts, result tables and period comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.stats import cosine_distance, safe_div
from tidewell.operators import compare, ingest, joins, lags, lexical, memory, ordered, states, vectors
from tidewell.plans.geometry import LAYERS, PAIRS, layers
from tidewell.plans.series import KEY, rounded, sides
from tidewell.plans.tables import midpoint, observations, read, token_maps
from tidewell.plans.tables import vectors as vector_table
from tidewell.sources import logs
from tidewell.sources.shared import kept, shared_dir


def by_halves(column: str, table: DataFrame) -> Column:
    """Period p1 in the first half of the table's range of the column, p2 in the second."""
    return F.when(F.col(column) < midpoint(table, column), "p1").otherwise("p2")


def state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each block of vectors: its mean vector, a vector of each layer, and its period."""
    rows = vector_table(spark, sf_dir)
    layers = vectors.layer_table(rows, "layer", "block", "v", LAYERS)
    return layers.join(vectors.mean_vector(rows, ["block"], "v"), "block").withColumn("period", by_halves("block", rows))


def scoped(df: DataFrame, keys: list[str], values: list[str], also: Column | None = None, digits: int = 6) -> DataFrame:
    """Count, mean and population deviation of the values, overall and by period."""
    rows = df.withColumn("scope", F.explode(states.in_scopes(F.col("period"), also)))
    stats = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))]
    return rounded(rows.groupBy(*keys, "scope").agg(*stats), digits)


def layer_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(states.layer_residuals(state_table(spark, sf_dir), LAYERS, "mean"), ["layer"], ["residual_norm"])


def residual_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(states.residual_separation(state_table(spark, sf_dir), ["period"], LAYERS, "mean"), ["pair"], ["distance"])


def residual_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.drift_steps(state_table(spark, sf_dir), "block", "period", LAYERS, "mean")


def residual_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift per step: the overall scope has all steps, a period's scope not the one into the next period."""
    values = ["residual_drift", "raw_drift", "ratio", "global_drift"]
    return scoped(residual_steps(spark, sf_dir), ["layer"], values, ~F.col("is_boundary"))


def boundary_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residual_steps(spark, sf_dir).where("is_boundary").select("layer", "from", "to", "residual_drift", "raw_drift", "global_drift"))


def vector_lag_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine similarity of vectors of a layer k rows apart, over pairs with no gap of over six ids between them."""
    rows = vector_table(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 3600))
    sums = lags.lag_sums(ordered.gap_blocks(rows, ["layer"], ["ts", "vec_id"], 6.0), ["layer"], "v", list(range(1, 17)))
    return rounded(sums.select("layer", "k", F.col("n").alias("n_pairs"), safe_div(F.col("_s"), F.col("_m")).alias("mean_cosine"), (F.col("n") < 80).alias("low_n")))


def vector_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vectors of each layer beside those less the grand mean, less their period's mean, and less their trend."""
    rows = vector_table(spark, sf_dir)
    rows = rows.withColumn("period", by_halves("block", rows))
    rows = states.centred_vectors(rows, ["layer"], "v", "centred")
    rows = states.centred_vectors(rows, ["layer", "period"], "v", "period_centred")
    rows = states.detrended_vectors(rows, ["layer"], "vec_id", "v")
    table = states.variant_table(rows.withColumnRenamed("v", "raw"), ["layer"], "vec_id", "raw", ["centred", "period_centred", "detrended"])
    return rounded(table)


def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest error of each purchase, however far away, and the seconds between."""
    left, right = sides(spark, sf_dir)
    found = joins.nearest(left, right, ordered.seconds(F.col("ts")), ordered.seconds(F.col("error_ts")), "error_id")
    return rounded(found.select("event_id", "error_id", "delta_s"), 3)


def interval_flags_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the first sign-up hour (from the sign-up on) that it lies in or at most half an hour away from."""
    rows = observations(spark, sf_dir)
    points = rows.where("event_type = 'error'").select("event_id", "ts")
    hours = rows.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), ordered.seconds(F.col("ts")).alias("s"))
    found = joins.first_interval(points, hours, "event_id", ordered.seconds(F.col("ts")), F.col("s"), F.col("s") + 3600, "signup_id", 1800)
    return found.select("event_id", F.coalesce("near", F.lit(-1)).alias("near"))


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per type and period of all readings beside those of all users but every tenth, purchases left out."""
    rows = observations(spark, sf_dir)
    stats = [F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n")]
    old = rows.groupBy("event_type", "period").agg(*stats)
    new = rows.where("user_id % 10 <> 0 AND event_type <> 'purchase'").groupBy("event_type", "period").agg(*stats)
    return rounded(compare.compare_tables(old, new, ["event_type", "period"], ["mean", "n"], 0.5))


def reproduced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means computed in two ways agree to 1e-9 of their size."""
    rows = observations(spark, sf_dir)
    old = rows.groupBy("event_type").agg(F.avg("value").alias("mean"))
    new = rows.groupBy("event_type", "period").agg(F.sum("value").alias("s"), F.count("value").alias("n")).groupBy("event_type").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return compare.compare_tables(old, new, ["event_type"], ["mean"], 1e-6).select("event_type", "column", "found_in", "agrees")


def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth user as the baseline; purchases have none."""
    flag = (F.col("user_id") % 10 == 0) & (F.col("event_type") != "purchase")
    return rounded(compare.baseline_stats(observations(spark, sf_dir), KEY, flag, "value", "no baseline rows"))


def against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.against_baseline(observations(spark, sf_dir), KEY, F.col("user_id") % 10 == 0, "value").drop("p"))


def largest_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of the two most populous months, by priority."""
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("double").alias("price"))
    table = compare.period_table(rows, ["o_orderpriority"], "month", "price")
    return rounded(table.select("o_orderpriority", "first", "second", "n_a", "n_b", "mean_a", "mean_b", "diff", "d_pooled", "u", "z", "d"), 4)


def largest_periods_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("double").alias("price"))
    return compare.period_table(rows, ["o_orderpriority"], "month", "price").select("o_orderpriority", "p_u", "p_d", "q_u", "q_d")


def relabelled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels rewritten, and a numeric copy whose exclusion flag takes no value out."""
    rows = ingest.relabelled(observations(spark, sf_dir), "event_type", [("^click$", "pointer click"), ("e(r+)or", "f$1ault")])
    rows = ingest.numeric_copy(rows, "value", "value_numeric", "init_outlier")
    return rounded(rows.groupBy("event_type", "init_outlier").agg(F.count("value_numeric").alias("n"), F.avg("value_numeric").alias("mean")))


def threshold_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.threshold_lists(observations(spark, sf_dir), KEY, "value", ["event_id"], 3.0, (3.0, 6.0))
    return rounded(found).orderBy("list", "value", "event_id")


def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of values above 80 by type: how many, and the largest gap in hours between two readings of one run."""
    found = ordered.runs(observations(spark, sf_dir), KEY, ["ts", "event_id"], F.col("value") > 80)
    return rounded(found.groupBy(*KEY).agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), (F.max("largest_gap_s") / 3600).alias("largest_gap_h")))


def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each series' six-hour grid that a reading serves, and those that stay empty."""
    grid = joins.grid_resample(observations(spark, sf_dir), KEY, "ts", "value")
    return grid.groupBy(*KEY).agg(F.count("*").alias("n_grid"), F.count("value").alias("n_filled"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def drift_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of tokens between neighbouring documents of a language: all steps, and those inside each half of the ids."""
    cut = midpoint(read(spark, sf_dir, "documents"), "doc_id")
    half = lambda c: F.when(F.col(c) < cut, "p1").otherwise("p2")
    rows = lexical.drift(token_maps(spark, sf_dir), ["lang"], "doc_id").withColumns({"period": half("from"), "later": half("to")})
    return scoped(rows, ["lang"], ["js", "cosine"], F.col("later") == F.col("period"), 4)


def ordering_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of blocks with ordered distances between layers and mean ratios, against the five other labelings of the layers."""
    sm, mr, sr = (cosine_distance(F.col(a), F.col(b)) for _, a, b in PAIRS)
    return rounded(vectors.order_statistics(layers(spark, sf_dir), sm, mr, sr))


def variants_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' six-hour grid as it is, and less its trend."""
    grid = memory.detrended(joins.grid_resample(observations(spark, sf_dir), KEY, "ts", "value"), KEY, "g", "value")
    each = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("value")) for n, c in (("raw", "value"), ("detrended", "detrended"))])
    return grid.select("event_type", "g", F.explode(each).alias("v")).select("event_type", "g", "v.*")


VARIANT = ["event_type", "variant"]


LAGS, LONG_LAGS = list(range(1, 17)), list(range(1, 57))
BANDS = {"floor": (12, 16), "mid": (19, 25), "far": (26, 32)}


def exponential_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the decay time of scalar series, each of 5,000 replicates of blocks of 24 fitted anew."""
    grid = variants_of_grid(spark, sf_dir).withColumnRenamed("g", "idx")
    fits = lags.with_fits(lags.block_replicates(grid, VARIANT, "value", LAGS, block=24, reps=5000, seed=43), LAGS, 6.0)
    return memory.percentile_interval(fits, VARIANT, "tau")


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each layer in order of vec_id, raw and less the grand mean; a block has no gap of over six ids."""
    rows = states.centred_vectors(vector_table(spark, sf_dir), ["layer"], "v", "centred").withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 3600))
    rows = ordered.gap_blocks(rows, ["layer"], ["ts", "vec_id"], 6.0)
    each = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("x")) for n, c in (("raw", "v"), ("centred", "centred"))])
    return kept(rows.select("layer", "idx", "block", F.explode(each).alias("e")).select("layer", "idx", "block", "e.*"), "layers")


LAYER = ["layer", "variant"]


def point_curve(rows: DataFrame, reach: list[int]) -> DataFrame:
    """The series' own mean similarity by lag, as an array in the order of the lags."""
    sums = lags.lag_sums(rows, LAYER, "x", reach).where("_m > 0")
    by_lag = F.map_from_entries(F.collect_list(F.struct("k", F.col("_s") / F.col("_m"))))
    return sums.groupBy(*LAYER).agg(by_lag.alias("_c")).select(*LAYER, F.transform(F.array(*map(F.lit, reach)), lambda k: F.try_element_at("_c", k)).alias("rho"))


def ar1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR(1) times of the vectors' lag-1 similarity: 1,000 replicates of blocks of 8, starts before n - 8, at least four lags with pairs."""
    rows, tau = layer_rows(spark, sf_dir), memory.ar1_time(F.col("rho")[0], 3.0)
    reps = lags.block_replicates(rows, LAYER, "x", LAGS, block=8, reps=1000, seed=42, inclusive=False)
    reps = reps.where(F.size(F.filter("rho", lambda x: x.isNotNull())) >= 4).withColumn("tau", tau)
    point = point_curve(rows, [1]).select(*LAYER, tau.alias("point"))
    found = memory.interval_reading(memory.percentile_interval(reps, LAYER, "tau"), point, LAYER, "point", 24.0)
    return rounded(found.select(*LAYER, "n_ok", "n_failed", "low", "median", "high", "point", "outside", (F.col("point") / 24).alias("days"), F.coalesce(F.col("point") > 24, F.lit(False)).alias("exceeds_24h")))


def floor_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity at lags 12 to 16: 1,000 replicates of blocks of 24, starts before n - 24; the ratio is to the vectors less their grand mean."""
    rows, floor = layer_rows(spark, sf_dir), lags.band_mean(F.col("rho"), LAGS, 12, 16)
    reps = lags.block_replicates(rows, LAYER, "x", LAGS, block=24, reps=1000, seed=5042, inclusive=False).withColumn("floor", floor)
    point = kept(point_curve(rows, LAGS).select(*LAYER, floor.alias("point")), "points")
    base = point.where("variant = 'centred'").select("layer", F.col("point").alias("base"))
    found = memory.percentile_interval(reps.where("floor IS NOT NULL"), LAYER, "floor").join(point, LAYER).join(base, "layer")
    outside = F.coalesce(~F.col("point").between(F.col("low"), F.col("high")), F.lit(False))
    return rounded(found.select(*LAYER, "n_ok", "low", "median", "high", "point", outside.alias("outside"), safe_div(F.col("point"), F.col("base")).alias("ratio")))


def vector_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of each lag's similarity over the complete ones of 1,000 replicates of blocks of 24."""
    reps = lags.complete(lags.block_replicates(layer_rows(spark, sf_dir), LAYER, "x", LAGS, block=24, reps=1000, seed=42))
    each = reps.select(*LAYER, F.posexplode("rho").alias("at", "rho"))
    return rounded(each.groupBy(*LAYER, (F.col("at") + 1).alias("k")).agg(F.count("*").alias("n"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("std")))


def vector_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the decay time of the vectors' mean similarity: 5,000 replicates of blocks of 24, fitted anew where all lags have pairs."""
    reps = lags.complete(lags.block_replicates(layer_rows(spark, sf_dir), LAYER, "x", LAGS, block=24, reps=5000, seed=42))
    return memory.percentile_interval(lags.with_fits(reps, LAGS, 3.0, floor=True), LAYER, "tau")


def long_lag_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity over three bands of lags: 1,000 replicates of blocks of 64, lags 1 to 56, starts before n - 64; and the regime that
    the series' own far band shows against its middle one."""
    rows = layer_rows(spark, sf_dir)
    reps = lags.block_replicates(rows, LAYER, "x", LONG_LAGS, block=64, reps=1000, seed=342, inclusive=False)
    means = {name: lags.band_mean(F.col("rho"), LONG_LAGS, *band) for name, band in BANDS.items()}
    bands = F.array(*[F.struct(F.lit(name).alias("band"), x.alias("mean")) for name, x in means.items()])
    found = memory.percentile_interval(reps.select(*LAYER, F.inline(bands)).where("mean IS NOT NULL"), [*LAYER, "band"], "mean").drop("n_failed")
    point = point_curve(rows, LONG_LAGS)
    point = point.select(*LAYER, memory.regime(means["mid"], means["far"]).alias("regime"), F.inline(bands)).withColumnRenamed("mean", "point")
    return rounded(found.join(point, [*LAYER, "band"]))


def standardised_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean product of standardised values k rows apart, k to 56, with a flag where pairs are few."""
    rows = observations(spark, sf_dir)
    level = rows.groupBy("event_type").agg(F.avg("value").alias("m"), F.nullif(F.stddev_pop("value"), F.lit(0.0)).alias("s"))
    z = rows.join(level, "event_type").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    sums = lags.lag_sums(ordered.gap_blocks(z, KEY, ["ts", "event_id"], 1.0), KEY, "z", LONG_LAGS)
    return rounded(sums.select("event_type", "k", F.col("n").alias("n_pairs"), safe_div(F.col("_ab"), F.col("_m")).alias("product"), (F.col("n") < 80).alias("low_n")))


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log text for each user: sign-ups are block headers, clicks comparisons, views metrics of four kinds, the rest prose."""
    number = F.concat(F.floor(F.col("value") * 1000).cast("string"), F.lit("e-03"))
    kind = F.col("event_id") % 4
    why = F.when(kind == 0, "awaiting data ").when(kind == 1, "First run ").otherwise("")
    h = F.when(kind == 2, "N/A").otherwise(number)
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("## BASELINE-SHUFFLE obs :: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .when(F.col("event_type") == "click", F.concat(F.lit("surface-mid real="), number, F.lit(" | shuffle="), (F.col("event_id") % 7).cast("string"), F.lit(".5 | delta=-1E-1")))
        .when(F.col("event_type") == "view", F.concat(F.lit("**metrics:** "), why, F.lit("H(t) ="), h, F.lit(" phi(t)= "), number))
        .otherwise("prose")
    )
    rows = observations(spark, sf_dir).where("value IS NOT NULL").select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"])
    return rows.groupBy("user_id").agg(F.array_join(lines, "\n").alias("text"))


def observation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation log of the sign-ups and errors with a time of whole minutes, written as text files and read back by entries."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.when(F.col("event_id") % 5 == 0, "").otherwise(" UTC"))
    mood = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("\n**surface mood:** mood "), (F.col("event_id") % 7).cast("string"), F.lit(" of seven"))).otherwise("")
    flag = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\n**anomaly flag:** "), F.col("event_type"), F.lit(" (see below)"))).otherwise("")
    rows = observations(spark, sf_dir).where("event_type IN ('signup', 'error')")
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("## obs :: "), at, mood, flag)).write.text(path)
    found = logs.read_entries(spark, path)
    return found.groupBy("mood", "flag").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def log_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison lines inside blocks, per user."""
    rows = logs.blocks(logs.lines(log_texts(spark, sf_dir), "user_id", "text"), "user_id")
    found = logs.comparisons(rows, "user_id")
    return rounded(found.groupBy("user_id", "pair").agg(F.count("*").alias("n"), F.sum("real").alias("real"), F.sum("shuffle").alias("shuffle"), F.sum("delta").alias("delta"), F.max("block").alias("last_block")), 4)


def log_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined metric lines by reason and position in their block, with the sums of what they say."""
    rows = logs.blocks(logs.lines(log_texts(spark, sf_dir), "user_id", "text"), "user_id")
    kept = logs.quarantined_metrics(rows, "user_id")
    return rounded(kept.groupBy("reason", "position").agg(F.count("*").alias("n"), F.count("h_raw").alias("n_h"), F.sum("h_raw").alias("h"), F.sum("phi_raw").alias("phi"), F.count("d_raw").alias("n_d")), 3)


def log_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.blocks(logs.lines(log_texts(spark, sf_dir), "user_id", "text"), "user_id")
    found = logs.anomalies(logs.quarantined_metrics(rows, "user_id"))
    return rounded(found.groupBy("user_id").agg(F.count("*").alias("n"), F.max("h_raw").alias("top_h")), 4)


QUERIES = {
    f.__name__: f
    for f in (
        layer_residuals, residual_separation, residual_drift, boundary_steps, vector_lag_curve, vector_variants, nearest_any, interval_flags_of_errors,
        table_versions, reproduced_table, baseline_stats, against_baseline, largest_periods, largest_periods_p, relabelled_types, threshold_lists,
        run_gaps, grid_counts, drift_scopes, ordering_shares, ar1_intervals, exponential_intervals, floor_intervals, vector_replicates, vector_intervals, long_lag_intervals, standardised_products, observation_log, log_comparisons, log_reasons, log_anomalies,
    )
}
