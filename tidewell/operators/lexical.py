"""Token counts: entropy, richness, rarefaction, drift between neighbouring rows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stats import safe_div
from tidewell.operators.ordered import beside, neighbour
from tidewell.sources.shared import kept

TOTAL_KEY = "__total__"


def words_of(text: Column) -> Column:
    """Words of the lower-cased text, split at white space."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, n) over all texts, summed up where they are read before anything is shuffled."""
    return df.select(F.explode(words_of(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def token_map(text: Column, k: int | None = None) -> Column:
    """Map of the text's tokens (the ``k`` most frequent, ties by token) to their counts, without any shuffle.

    Words are sorted within the row; a token's count is the distance between the places where it and the next one begin.
    """

    def counted(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

        def entries(at: Column) -> Column:
            n = lambda i: F.coalesce(F.get(at, i + 1), F.size(words)) - F.get(at, i)
            pairs = F.transform(at, lambda x, i: F.struct((-n(i)).alias("less"), F.get(words, x).alias("token")))
            ranked = F.array_sort(F.filter(pairs, lambda p: p["token"] != TOTAL_KEY))
            ranked = F.slice(ranked, 1, k) if k else ranked
            return F.map_from_entries(F.transform(ranked, lambda p: F.struct(p["token"], (-p["less"]).cast("double"))))

        return F.when(F.size(words) > 0, named(starts, entries)).otherwise(F.create_map().cast("map<string,double>"))

    return named(F.sort_array(words_of(text)), counted)


def map_total(tokens: Column) -> Column:
    return F.aggregate(F.map_values(tokens), F.lit(0.0), lambda s, x: s + x)


def entropy_bits(tokens: Column, *, smoothed: bool = False) -> Column:
    """Shannon entropy in bits; ``smoothed`` adds 1e-12 inside the logarithm. NULL for an empty map."""
    total = F.nullif(map_total(tokens), F.lit(0.0))
    p = F.transform(F.map_values(tokens), lambda x: x / total)
    kept = p if smoothed else F.filter(p, lambda x: x > 0)
    return -F.aggregate(kept, F.lit(0.0), lambda s, x: s + x * F.log2(x + (1e-12 if smoothed else 0.0)))


def aligned(a: Column, b: Column) -> Column:
    """Pairs of values of two maps over the union of their keys; missing ones are 0."""
    zipped = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y")))
    return F.map_values(zipped)


def js_distance(a: Column, b: Column) -> Column:
    """Root of the Jensen-Shannon divergence in bits."""
    na, nb = F.nullif(map_total(a), F.lit(0.0)), F.nullif(map_total(b), F.lit(0.0))
    p, q = F.transform_values(a, lambda k, x: x / na), F.transform_values(b, lambda k, x: x / nb)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.aggregate(
        aligned(p, q),
        F.lit(0.0),
        lambda s, v: s + 0.5 * part(v["x"], (v["x"] + v["y"]) / 2) + 0.5 * part(v["y"], (v["x"] + v["y"]) / 2),
    )
    return F.sqrt(F.greatest(F.lit(0.0), total))


def cosine_counts(a: Column, b: Column) -> Column:
    """1 - cosine of two count maps; NULL if one is empty."""
    both = F.aggregate(aligned(a, b), F.lit(0.0), lambda s, v: s + v["x"] * v["y"])
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return 1 - safe_div(both, size(a) * size(b))


def drift(maps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distances between neighbouring rows of a series; the step belongs to the later row."""
    steps = neighbour(maps.select(*keys, order, "tokens"), keys, [order], [order, "tokens"], "next").where("next IS NOT NULL")
    ahead = F.col("next.tokens")
    return steps.select(*keys, F.col(order).alias("from"), F.col("next")[order].alias("to"), js_distance(F.col("tokens"), ahead).alias("js"), cosine_counts(F.col("tokens"), ahead).alias("cosine"))


def rarefied_entropy(maps: DataFrame, key: str, budget: int | None = None, draws: int = 50, seed: int = 42) -> DataFrame:
    """Mean and sample deviation of the entropy of ``draws`` multinomial samples of ``budget`` tokens.

    Without a budget it is the least total of all rows. NULL where a row has fewer tokens. Draws are seeded by the row's key, so they do not depend
    on the partitioning.
    """

    if budget is None:
        budget = int(maps.agg(F.min(map_total(F.col("tokens")))).first()[0] or 0)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, tokens in zip(frame[key], frame["tokens"], strict=True):
                n = np.array([v for _, v in sorted(dict(tokens).items())], float)
                if not n.sum() or n.sum() < budget:
                    out.append((k, None, None))
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                p = rng.multinomial(budget, n / n.sum(), size=draws) / budget
                h = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
                out.append((k, float(h.mean()), float(h.std(ddof=1))))
            yield pd.DataFrame(out, columns=[key, "mean_entropy", "std_entropy"])

    return maps.select(key, "tokens").mapInPandas(sample, f"{key} {maps.schema[key].dataType.simpleString()}, mean_entropy double, std_entropy double")


def vocabulary_sketches(tokens: DataFrame, keys: list[str], token: str, log_size: int = 12) -> DataFrame:
    """Distinct tokens per key, and over all keys (keys NULL), exact (``n_exact``) and by a HyperLogLog sketch of 2**log_size registers.

    The sketches of the keys are stored and united for the whole; ``error_bound`` is three standard errors.
    """
    parts = kept(tokens.groupBy(*keys).agg(F.hll_sketch_agg(token, log_size).alias("sketch")), "sketches")
    own = parts.select(*keys, F.hll_sketch_estimate("sketch").alias("n_sketch"))
    every = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_sketch"))
    exact = tokens.select(*keys, token).distinct()
    by_key = exact.groupBy(*keys).agg(F.count(token).alias("n_exact"))
    kinds = dict(parts.dtypes)
    none = [F.lit(None).cast(kinds[k]).alias(k) for k in keys]
    whole = exact.select(token).distinct().agg(F.count(token).alias("n_exact")).join(every).select(*none, "n_exact", "n_sketch")
    both = beside(by_key, own, keys, ["n_sketch"]).unionByName(whole)
    return both.withColumn("error_bound", F.lit(3 * 1.04 / math.sqrt(1 << log_size)))
