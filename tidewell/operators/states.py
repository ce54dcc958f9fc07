"""States: rows with one mean vector and a vector of each layer; their residuals, drift and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import cosine_distance, minus, norm, safe_div
from tidewell.operators.ordered import neighbour
from tidewell.operators.vectors import mean_vector

#: Raw drift up to this counts as none.
NO_DRIFT = 1e-15


def in_scopes(period: Column, also: Column | None = None) -> Column:
    """The scopes of a row: overall, and its period unless ``also`` is false."""
    own = period if also is None else F.when(also, period)
    return F.filter(F.array(F.lit("overall"), own), lambda x: x.isNotNull())


def layer_residuals(states: DataFrame, names: list[str], mean: str) -> DataFrame:
    """Long table of each row's layers: ``layer``, ``v``, ``residual`` from the row's own mean vector and its norm."""
    rest = [c for c in states.columns if c not in names]
    each = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in names])
    long = states.select(*rest, F.explode(each).alias("l")).select(*rest, "l.*")
    return long.withColumn("residual", minus(F.col("v"), F.col(mean))).withColumn("residual_norm", norm(F.col("residual")))


def residual_separation(states: DataFrame, keys: list[str], names: list[str], mean: str) -> DataFrame:
    """Cosine distance of the layers' residuals, for each pair; NULL where one of them is zero."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    gap = lambda n: minus(F.col(n), F.col(mean))
    each = [F.struct(F.lit(f"{a}-{b}").alias("pair"), cosine_distance(gap(a), gap(b)).alias("distance")) for a, b in pairs]
    return states.select(*keys, F.explode(F.array(*each)).alias("p")).select(*keys, "p.*")


def drift_steps(states: DataFrame, order: str, period: str, names: list[str], mean: str) -> DataFrame:
    """Per consecutive pair of rows and layer: residual, raw and global drift (lengths), ratio, and whether periods differ.

    The ratio of residual to raw drift is NULL where a layer did not move.
    """
    ahead = neighbour(states, [], [order], [order, period, mean, *names], "next").where("next IS NOT NULL")
    after = F.col("next")
    moved = lambda a, b: norm(minus(b, a))
    each = [
        F.struct(
            F.lit(n).alias("layer"),
            moved(minus(F.col(n), F.col(mean)), minus(after[n], after[mean])).alias("residual_drift"),
            moved(F.col(n), after[n]).alias("raw_drift"),
        )
        for n in names
    ]
    rows = ahead.select(
        F.col(order).alias("from"),
        after[order].alias("to"),
        F.col(period).alias("period"),
        (F.col(period) != after[period]).alias("is_boundary"),
        moved(F.col(mean), after[mean]).alias("global_drift"),
        F.explode(F.array(*each)).alias("l"),
    )
    rows = rows.select("from", "to", "period", "is_boundary", "global_drift", "l.*")
    return rows.withColumn("ratio", F.when(F.col("raw_drift") > NO_DRIFT, F.col("residual_drift") / F.col("raw_drift")))


def detrended_vectors(df: DataFrame, keys: list[str], x: str, vector: str, name: str = "detrended") -> DataFrame:
    """Adds the vectors less each component's least-squares line on ``x``, fitted per key; constant x: less the mean."""
    parts = df.select(*keys, x, F.posexplode(vector).alias("_i", "_y"))
    line = [F.coalesce(F.regr_slope("_y", x), F.lit(0.0)).alias("s"), F.coalesce(F.regr_intercept("_y", x), F.avg("_y")).alias("c")]
    fits = parts.groupBy(*keys, "_i").agg(*line)
    fits = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "s", "c"))).alias("_f"))
    joined = df.join(fits, keys) if keys else df.join(F.broadcast(fits))  # without keys: one row
    return joined.withColumn(name, F.zip_with(vector, "_f", lambda y, f: y - (f["s"] * F.col(x) + f["c"]))).drop("_f")


def centred_vectors(df: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Adds the vectors less the mean vector of their key."""
    means = mean_vector(df, keys, vector, "_m")
    joined = df.join(means, keys) if keys else df.join(F.broadcast(means))  # without keys: one row
    return joined.withColumn(name, minus(F.col(vector), F.col("_m"))).drop("_m")


def variant_table(df: DataFrame, keys: list[str], order: str, raw: str, variants: list[str]) -> DataFrame:
    """Per key and variant: mean norm, mean ratio of its norm to the raw one, mean cosine of neighbours, and the static share.

    The static share is what of the raw vectors' similarity of neighbours goes with the variant.
    """
    names = [raw, *variants]
    ahead = neighbour(df, keys, [order], names, "next")
    each = [
        F.struct(F.lit(n).alias("variant"), norm(F.col(n)).alias("norm"), safe_div(norm(F.col(n)), norm(F.col(raw))).alias("ratio"), (1 - cosine_distance(F.col(n), F.col("next")[n])).alias("near"))
        for n in names
    ]
    long = ahead.select(*keys, F.explode(F.array(*each)).alias("v")).select(*keys, "v.*")
    found = long.groupBy(*keys, "variant").agg(F.count("*").alias("n"), F.avg("norm").alias("mean_norm"), F.avg("ratio").alias("norm_ratio"), F.avg("near").alias("rho1"))
    base = found.where(F.col("variant") == raw).select(*keys, F.col("rho1").alias("_raw"))
    joined = found.join(base, keys) if keys else found.join(base)
    return joined.withColumn("static_share", safe_div(F.col("_raw") - F.col("rho1"), F.col("_raw"))).drop("_raw")
