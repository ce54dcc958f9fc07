"""Queries over vectors and token counts, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import cosine_distance, safe_div
from tidewell.operators import angles, compare, describe, drifts, lexical, ordered, vectors
from tidewell.plans.series import rounded
from tidewell.plans.tables import midpoint, read, token_maps
from tidewell.plans.tables import vectors as vector_table
from tidewell.sources import readers
from tidewell.sources.shared import kept

LAYERS = ["surface", "mid", "residue"]
PAIRS = [("surface-mid", "surface", "mid"), ("mid-residue", "mid", "residue"), ("surface-residue", "surface", "residue")]
ORDERS = ["<".join(p) for p in (("SM", "MR", "SR"), ("SM", "SR", "MR"), ("MR", "SM", "SR"), ("MR", "SR", "SM"), ("SR", "SM", "MR"), ("SR", "MR", "SM"))]


def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vector(vector_table(spark, sf_dir), ["label"], "v")
    return rounded(means.select("label", F.posexplode("mean").alias("dim", "mean")))


def residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.with_residual(vector_table(spark, sf_dir), [], "v")
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("residual_norm").alias("mean"), F.stddev_pop("residual_norm").alias("std_pop"), F.max("residual_norm").alias("top")))


def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.steps(vector_table(spark, sf_dir), "vec_id", "v", ["label"]))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.layer_table(vector_table(spark, sf_dir), "layer", "block", "v", LAYERS)


def layer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = vectors.pair_distances(layers(spark, sf_dir), ["block"], LAYERS)
    return rounded(long.groupBy("pair").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.avg("angle").alias("mean_angle")))


def ordered_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [("SM", "surface", "mid"), ("MR", "mid", "residue"), ("SR", "surface", "residue")]
    return layers(spark, sf_dir).select("block", vectors.ordering_label([(n, cosine_distance(F.col(a), F.col(b))) for n, a, b in names]).alias("ordering"))


def ordering_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(describe.category_frequencies(ordered_layers(spark, sf_dir), "ordering", ORDERS).withColumn("pos", F.col("pos").cast("int")))


def ordering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequencies = describe.category_frequencies(ordered_layers(spark, sf_dir), "ordering", ORDERS)
    return rounded(describe.mode(frequencies, "ordering").join(compare.uniform_tests(frequencies, 1 / 6)))


def relabeled_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of blocks whose first two layers are the closest pair, under each relabeling."""
    rows = vectors.relabelings(layers(spark, sf_dir), LAYERS)
    d = {n: cosine_distance(F.col(a), F.col(b)) for n, a, b in PAIRS}
    first = (d["surface-mid"] <= d["mid-residue"]) & (d["surface-mid"] <= d["surface-residue"])
    return rounded(rows.groupBy("perm").agg(F.avg(first.cast("double")).alias("share"), F.avg(d["surface-mid"]).alias("mean_distance")))


def zero_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the vectors' residuals from the grand mean, and their drift over the seconds since the first vector: slope, r and t."""
    rows = vectors.with_residual(vector_table(spark, sf_dir), [], "v").select((F.col("vec_id") * 3600).cast("double").alias("s"), F.col("residual_norm").alias("x"))
    one = rows.agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_pop"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.regr_slope("x", "s").alias("slope"), F.corr("x", "s").alias("r"),
    )
    found = compare.correlation_p(one)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std_pop", "low", "high")], F.round(F.col("slope") * 1e6, 6).alias("slope_per_megasecond"), F.round("r", 6).alias("r"), F.round("t", 5).alias("t"))


def zero_mode_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, sample deviation and median of the residuals' lengths in periods of 30 days of vectors."""
    rows = vectors.with_residual(vector_table(spark, sf_dir), [], "v").withColumn("period", F.floor(F.col("vec_id") / 720))
    stats = rows.groupBy("period").agg(F.count("*").alias("n"), F.avg("residual_norm").alias("mean"), F.stddev_samp("residual_norm").alias("std"))
    return rounded(ordered.beside(stats, ordered.quantiles(rows, ["period"], "residual_norm", {"median": 0.5}), ["period"], ["median"]))


def vocabulary_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words by language and over all of them, and whether the merged sketches lie within their error bound."""
    tokens = read(spark, sf_dir, "documents").select("lang", F.explode(lexical.words_of(F.col("text"))).alias("token"))
    found = lexical.vocabulary_sketches(tokens, ["lang"], "token")
    near = F.abs(F.col("n_sketch") - F.col("n_exact")) <= F.col("error_bound") * F.col("n_exact")
    return found.select("lang", "n_exact", near.alias("within"))


def relabeling_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the layers' vectors around their means under each relabeling, which must not change it, with its rank."""
    spread = vectors.label_spread(vectors.relabelings(layers(spark, sf_dir), LAYERS), "perm", LAYERS)
    spread = spread.select("perm", (F.col("perm") == 0).alias("is_identity"), F.round("spread", 8).alias("spread"))
    return ordered.average_rank(spread.withColumn("one", F.lit(1)), ["one"], "spread").drop("one")


def tokens_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens as a JSON object in order of the tokens, and whether it reads back as the same map."""
    maps = token_maps(spark, sf_dir).select("doc_id", "tokens", readers.tokens_json(F.col("tokens")).alias("json"))
    again = readers.parse_tokens(F.col("json"))
    same = F.array_sort(F.map_entries(again)) == F.array_sort(F.map_entries(F.transform_values("tokens", lambda k, v: v.cast("bigint"))))
    return maps.select("doc_id", "json", same.alias("reads_back"))


def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_table(spark, sf_dir).withColumn("period", F.when(F.col("vec_id") % 2 == 0, "p1").otherwise("p2"))
    return rounded(vectors.centroid_drift(rows, "period", "v"))


def between_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the labels' centroids around the grand mean, within-label spread, and their ratio."""
    rows = vector_table(spark, sf_dir)
    return rounded(vectors.between_within(rows, "label", "v"))


def gaussian_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean angles of layer pairs, observed and between normal vectors of the same lengths."""
    return vectors.gaussian_angle_null(layers(spark, sf_dir), "block", LAYERS, 200, 42)


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance shares of the first three components; signs of components are arbitrary, so scores enter by size."""
    residuals = vectors.with_residual(vector_table(spark, sf_dir), [], "v").select("label", "residual")
    shares, scores = vectors.principal_shares(residuals, "residual")
    sizes = scores.agg(*[F.avg(F.abs(F.col("scores")[i])).alias(f"s{i}") for i in range(len(shares))])
    each = [F.struct(F.lit(i + 1).alias("component"), F.lit(x).alias("share"), F.col(f"s{i}").alias("mean_abs_score")) for i, x in enumerate(shares)]
    return sizes.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def permuted_layers(table: DataFrame, reps: int, seed: int) -> DataFrame:
    """``reps`` copies in which each layer is shuffled over the blocks by a seed of its own."""
    drawn = table.withColumn("one", F.lit(1))
    first, *others = [vectors.permuted(drawn.select("one", "block", x), ["one"], "block", [x], reps, seed + k).drop("one") for k, x in enumerate(LAYERS)]
    for other in others:
        first = first.join(other, ["rep", "block"])
    return first


def angle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean angles of layer pairs, observed and with each layer's vectors permuted over blocks."""
    table = layers(spark, sf_dir)
    observed = vectors.pair_distances(table, [], LAYERS).groupBy("pair").agg(F.avg("angle").alias("observed"))
    shuffled = permuted_layers(table, 200, 42)
    null = vectors.pair_distances(shuffled, ["rep"], LAYERS).groupBy("pair", "rep").agg(F.avg("angle").alias("angle"))
    null = null.groupBy("pair").agg(F.avg("angle").alias("null_mean"), F.stddev_pop("angle").alias("null_std"))
    return observed.join(null, "pair").withColumn("ratio", safe_div(F.col("observed"), F.col("null_mean")))


def angle_null_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of layer pairs, apart and all together, against both nulls: normal vectors of the same lengths, and permuted layers."""
    seen, sums = angles.angle_sums(kept(layers(spark, sf_dir), "states"), "block", LAYERS, 200, 42)
    return compare.against_null_sums(seen, kept(sums, "angle_sums"), "null", ["pair"], "angle")


def entropy_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and richness of documents by language, and the rank test of the entropies of the two halves of the ids."""
    maps = token_maps(spark, sf_dir)
    rows = maps.select("lang", (F.col("doc_id") < midpoint(read(spark, sf_dir, "documents"), "doc_id")).alias("early"), F.size("tokens").alias("richness"), F.round(lexical.entropy_bits(F.col("tokens")), 6).alias("h"))
    stats = rows.groupBy("lang").agg(*[F.avg(F.when(side, F.col(c))).alias(f"{c}_{name}") for c in ("h", "richness") for name, side in (("early", F.col("early")), ("late", ~F.col("early")))])
    return rounded(ordered.beside(stats, compare.mann_whitney(rows, ["lang"], F.col("early"), "h"), ["lang"], ["n_a", "n_b", "u"]), 4)


def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = token_maps(spark, sf_dir)
    h = lexical.entropy_bits(F.col("tokens"))
    return rounded(maps.select("doc_id", F.size("tokens").alias("richness"), lexical.map_total(F.col("tokens")).alias("total"), h.alias("entropy"), lexical.entropy_bits(F.col("tokens"), smoothed=True).alias("smoothed")))


def language_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = token_maps(spark, sf_dir).withColumn("h", lexical.entropy_bits(F.col("tokens")))
    base = maps.groupBy("lang").agg(F.count("h").alias("n"), F.avg("h").alias("mean"), F.stddev_samp("h").alias("std"))
    return rounded(ordered.beside(base, ordered.quantiles(maps, ["lang"], "h", {"median": 0.5}), ["lang"], ["median"]))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.token_counts(read(spark, sf_dir, "documents"), "text")
    return counts.orderBy(F.desc("n"), "token").limit(10)


def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.token_counts(read(spark, sf_dir, "documents"), "text")
    return counts.agg(F.count("token").alias("n_tokens"), F.sum("n").alias("n_words"))


def lexical_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lexical.drift(token_maps(spark, sf_dir), ["lang"], "doc_id"))


def drift_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean drift per language, observed and over shuffled orders of the same documents."""
    means = kept(drifts.mean_drifts(read(spark, sf_dir, "documents"), ["lang"], "doc_id", "text", 200, 42), "drifts")
    seen = means.where("rep = 0").select("lang", F.col("js").alias("observed"))
    null = means.where("rep > 0").groupBy("lang").agg(F.avg("js").alias("null_mean"), F.stddev_pop("js").alias("null_std"))
    return seen.join(null, "lang").withColumn("ratio", safe_div(F.col("observed"), F.col("null_mean")))


def rarefied_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies at the least total of all documents, and at 5,000 tokens where a document has as many."""
    maps = token_maps(spark, sf_dir)
    least, large = (lexical.rarefied_entropy(maps, "doc_id", b) for b in (None, 5000))
    return least.join(large.select("doc_id", F.col("mean_entropy").alias("mean_5000"), F.col("std_entropy").alias("std_5000")), "doc_id")


def quality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lengths of the two quality labels: effect sizes."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.withColumn("n_chars", F.col("n_chars").cast("double"))
    return rounded(compare.two_groups(rows, ["lang"], F.col("quality") == 1, "n_chars"))


def viability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks with value, verdict and name, each computed from the tables."""
    v = vector_table(spark, sf_dir).agg(F.count("*").cast("double").alias("value")).select(F.lit("vectors").alias("check"), "value", (F.col("value") >= 100).alias("ok"))
    d = read(spark, sf_dir, "documents").agg(F.avg((F.col("n_chars") > 0).cast("double")).alias("value")).select(F.lit("share_of_texts").alias("check"), "value", (F.col("value") > 0.9).alias("ok"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("value")).select(F.lit("turns_a_conversation").alias("check"), "value", (F.col("value") >= 2).alias("ok"))
    return rounded(v.unionByName(d).unionByName(c))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    first = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("position", F.when(F.row_number().over(first) == 1, "first").otherwise("later")).groupBy("role", "position").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_means, residual_norms, vector_steps, layer_distances, ordering_frequencies, ordering_tests, relabeled_spread, relabeling_spread, tokens_as_json, centroid_drift,
        between_within, gaussian_angles, principal_components, angle_null, angle_null_table, token_entropy, entropy_of_halves, language_entropy, top_tokens, vocabulary_size, vocabulary_sketches, zero_mode, zero_mode_by_period, lexical_drift, drift_baseline,
        rarefied_entropy, quality_groups, viability, role_counts,
    )
}
