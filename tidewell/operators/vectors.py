"""Geometry of vectors: means, residuals, distances, orders, permutations and principal components."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import angle, cosine_distance, minus, norm, safe_div
from tidewell.operators.ordered import neighbour, running_sums, with_index


def as_doubles(vector: Column, size: int | None = None) -> Column:
    """Floats as doubles; NULL if any component is missing or not finite, or the length is not ``size``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~F.coalesce(bad, F.lit(True))
    if size is not None:
        good = good & (F.size(vector) == size)
    return F.when(good, F.transform(vector, lambda x: x.cast("double")))


def mean_vector(df: DataFrame, keys: list[str], vector: str, name: str = "mean") -> DataFrame:
    """Mean of each component by key; one partial sum of whole vectors for each key and task goes over the network."""
    rows = df.where(F.col(vector).isNotNull())
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias(name))


def with_residual(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Adds the residual from the key's mean vector and its length."""
    means = mean_vector(df, keys, vector)
    if keys:
        joined = df.join(means, keys)
    else:
        joined = df.join(F.broadcast(means))  # one row
    return joined.withColumn("residual", minus(F.col(vector), F.col("mean"))).drop("mean").withColumn("residual_norm", norm(F.col("residual")))


def steps(df: DataFrame, order: str, vector: str, keys: list[str]) -> DataFrame:
    """Consecutive rows of a series: cosine distance and length of the step, with the next row's place."""
    paired = neighbour(df, keys, [order], [order, vector], "next").where("next IS NOT NULL")
    ahead = F.col("next")[vector]
    return paired.select(
        *keys,
        F.col(order).alias("from"),
        F.col("next")[order].alias("to"),
        cosine_distance(F.col(vector), ahead).alias("cosine_step"),
        norm(minus(ahead, F.col(vector))).alias("length_step"),
    )


def layer_table(df: DataFrame, layer: str, block: str, vector: str, names: list[str]) -> DataFrame:
    """One row per block that has all layers, with a mean vector for each."""
    means = mean_vector(df, [block, layer], vector, "v")
    wide = means.groupBy(block).agg(*[F.max_by("v", F.when(F.col(layer) == i, 1)).alias(n) for i, n in enumerate(names)])
    return wide.dropna()


def pair_distances(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long table of (pair, distance, angle) for all pairs of the named vector columns."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = [F.struct(F.lit(f"{a}-{b}").alias("pair"), cosine_distance(F.col(a), F.col(b)).alias("distance"), angle(F.col(a), F.col(b)).alias("angle")) for a, b in pairs]
    return df.select(*keys, F.explode(F.array(*each)).alias("p")).select(*keys, "p.*")


def ordering_label(distances: list[tuple[str, Column]]) -> Column:
    """Names by ascending distance, ties in the given order, as ``a<b<c``."""
    items = F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, d) in enumerate(distances)])
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["n"]), "<")


def relabelings(df: DataFrame, names: list[str]) -> DataFrame:
    """Every row under each permutation of the named columns; ``perm`` is 0 for the identity."""
    options = F.array(*[F.struct(F.lit(i).alias("perm"), *[F.col(p).alias(n) for n, p in zip(names, order, strict=True)]) for i, order in enumerate(permutations(names))])
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(options).alias("_o")).select(*rest, "_o.*")


def label_spread(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Per key: mean distance of each named column's vectors from their mean, averaged over the columns."""
    each = F.array(*[F.struct(F.lit(i).alias("_p"), F.col(n).alias("_v")) for i, n in enumerate(names)])
    rows = with_residual(df.select(key, F.inline(each)), [key, "_p"], "_v")
    return rows.groupBy(key, "_p").agg(F.avg("residual_norm").alias("_s")).groupBy(key).agg(F.avg("_s").alias("spread"))


def order_statistics(df: DataFrame, first: Column, second: Column, outer: Column) -> DataFrame:
    """Of three layers' distances (first-second, second-third, first-third): shares of rows with ordered distances and means of row
    ratios, observed and under the five other labelings of the layers: their mean, sample deviation and, for shares, the two-sided tail,
    the part of the five that lie at least as far from their mean. Rows with a missing distance are left out.

    A labeling only swaps the three distances, so one pass takes all means.
    """
    rows = df.select(first.alias("_01"), second.alias("_12"), outer.alias("_02")).na.drop()
    between = lambda a, b: F.col(f"_{min(a, b)}{max(a, b)}")
    views = [(between(p[0], p[1]), between(p[1], p[2]), between(p[0], p[2])) for p in permutations(range(3))]
    share = lambda x: F.avg(x.cast("double"))
    ratio = lambda a, b: F.avg(F.when(b > 1e-15, a / b))
    kinds = {
        "first_lt_second": (0.5, [share(a < b) for a, b, c in views]),
        "outer_largest": (1 / 3, [share((c > a) & (c > b)) for a, b, c in views]),
        "all_in_order": (1 / 6, [share((a < b) & (b < c)) for a, b, c in views]),
        "first_to_second": (None, [ratio(a, b) for a, b, c in views]),
        "outer_to_first": (None, [ratio(c, a) for a, b, c in views]),
    }
    one = rows.agg(F.count("*").alias("n"), *[F.array(*x).alias(name) for name, (_, x) in kinds.items()]).where("n > 0")
    each = [F.struct(F.lit(name).alias("statistic"), F.lit(theory).cast("double").alias("theoretical"), F.col(name).alias("x")) for name, (theory, _) in kinds.items()]
    found = one.select("n", F.inline(F.array(*each))).withColumns({"observed": F.col("x")[0], "_null": F.slice("x", 2, 5)})
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    found = found.withColumn("null_mean", mean(F.col("_null")))
    squares = F.aggregate("_null", F.lit(0.0), lambda s, v: s + (v - F.col("null_mean")) * (v - F.col("null_mean")))
    far = lambda v: F.round(F.abs(v - F.col("null_mean")), 12)  # noqa: E731  ties of equal shares survive rounding errors
    tail = mean(F.transform("_null", lambda v: (far(v) >= far(F.col("observed"))).cast("double")))
    return found.select(
        "statistic", "theoretical", "observed", "null_mean", F.sqrt(squares / 4).alias("null_std"), F.when(F.col("theoretical").isNotNull(), tail).alias("tail"), "n"
    )


def centroid_drift(df: DataFrame, period: str, vector: str) -> DataFrame:
    """First and second period's centroids: L2 and cosine distance, mean spread within periods, and their ratio."""
    spread = with_residual(df, [period], vector).groupBy(period).agg(F.avg("residual_norm").alias("spread"))
    both = mean_vector(df, [period], vector).join(spread, period)
    pair = both.agg(
        F.min_by("mean", period).alias("a"), F.max_by("mean", period).alias("b"), F.avg("spread").alias("within")
    )
    l2 = norm(minus(F.col("a"), F.col("b")))
    ratio = safe_div(l2, F.col("within"))
    return pair.select(
        l2.alias("l2"),
        cosine_distance(F.col("a"), F.col("b")).alias("cosine"),
        "within",
        ratio.alias("ratio"),
        F.when(ratio < 0.5, "small").when(ratio < 1.2, "comparable").otherwise("large").alias("reading"),
    )


def between_within(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean distance of labels' centroids from the grand mean, mean distance of rows from their centroid, and the ratio."""
    centroids = with_residual(mean_vector(df, [label], vector, "c"), [], "c").agg(F.avg("residual_norm").alias("between"))
    within = with_residual(df, [label], vector).groupBy(label).agg(F.avg("residual_norm").alias("w")).agg(F.avg("w").alias("within"))
    return centroids.join(within).withColumn("ratio", safe_div(F.col("between"), F.col("within")))


def standard_normal(*parts: Column) -> Column:
    """A normal draw from the hash of the parts (Box-Muller): the same in any partitioning."""
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *parts), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


def gaussian_angles(df: DataFrame, key: str, names: list[str], reps: int, seed: int) -> DataFrame:
    """Distances and angles of normal vectors of the named vectors' lengths, drawn for each row, vector and replicate."""
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))

    def drawn(i: int, name: str) -> Column:
        raw = F.transform(F.sequence(F.lit(1), F.size(name)), lambda k: standard_normal(F.lit(seed), F.lit(i), F.col(key), F.col("rep"), k))
        scaled = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), (norm(F.col(name)) / norm(v)).alias("by")))
        return F.transform(scaled, lambda s: F.transform(s["v"], lambda x: x * s["by"]))[0]  # draws and lengths once a row

    return pair_distances(rows.select(*[drawn(i, n).alias(n) for i, n in enumerate(names)]), [], names)


def gaussian_angle_null(df: DataFrame, key: str, names: list[str], reps: int, seed: int) -> DataFrame:
    """Per pair of the named vectors: observed angle, and that of normal vectors of the same lengths."""
    null = gaussian_angles(df, key, names, reps, seed)
    null = null.groupBy("pair").agg(F.count("angle").alias("n"), F.avg("angle").alias("null_mean"), F.stddev_pop("angle").alias("null_std"))
    seen = pair_distances(df, [], names).groupBy("pair").agg(F.avg("angle").alias("observed"))
    return seen.join(null, "pair").withColumn("ratio", safe_div(F.col("observed"), F.col("null_mean")))


def principal_shares(df: DataFrame, vector: str, k: int = 3) -> tuple[list[float], DataFrame]:
    """Shares of variance of the first k components, and the scores of each row."""
    fitted = PCA(k=k, inputCol="_x", outputCol="_s").fit(data := df.withColumn("_x", array_to_vector(vector)))
    return list(fitted.explainedVariance), fitted.transform(data).withColumn("scores", vector_to_array("_s")).drop("_x", "_s")


def permuted(df: DataFrame, keys: list[str], order: str, columns: list[str], reps: int, seed: int) -> DataFrame:
    """``reps`` copies in which the named columns are shuffled within each key, by ranks of seeded hashes.

    Only indices are put in order, in two levels; the shuffled columns meet them in the last join.
    """
    rows = with_index(df, keys, [order]).withColumnRenamed("idx", "_i")
    slim = rows.select(*keys, F.col("_i").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    slim = slim.withColumn("_h", F.xxhash64(F.lit(seed), "rep", "_from").cast("double"))
    drawn = running_sums(slim, ["rep", *keys], ["_h", "_from"], {"_i": F.lit(1).cast("long")}).drop("_h").withColumn("_i", F.col("_i") - 1)
    rest = [c for c in df.columns if c not in columns and c not in keys]
    placed = drawn.join(rows.select(*keys, "_i", *rest), [*keys, "_i"]).drop("_i")
    return placed.join(rows.select(*keys, F.col("_i").alias("_from"), *columns), [*keys, "_from"]).drop("_from")
