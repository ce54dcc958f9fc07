"""Exact top-k search by inner product (operator 5): an impact-ordered, score-at-a-time index.

Components are floor(64 * x). Each row's postings (dimension, component) fall into levels by
quantised impact, the component's size in steps of STEP (in powers of two where it is large, so
levels are few); a block of rows has one segment of postings for each level. Segments are scored in descending order of impact, for a block of
queries at once. What is left of a row after a level is bounded by the lengths of the
unscored parts of query and row (Cauchy-Schwarz). A query stops when this proves that
no row outside its possible members can reach its k-th lower bound; the members are then
rescored exactly with all components.

Every query meets every row, in blocks: queries and rows are dealt to square-ish grids of
blocks by hash, a task holds one block of each, and k rows a block go on to the final ranking.

* Vectors that are null, or hold null, NaN or infinite components, take no part, as queries or
  rows. Vectors of different lengths are compared over the dimensions they share, as if
  padded with zeros. A query's own row, by id, is no candidate; repeated ids are rows each.
* Rows without an id take no part. Scores are exact at any size; a score beyond a long, and a
  component beyond one, count as its nearest end, and such scores tie.
* Empty table: empty result. Fewer than k candidates: all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import sorted_runs
from tidewell.llm.tables import stored

K, SCALE, STEP = 20, 64, 8
#: Rows of a block of queries, and of a block of candidates.
QUERIES, ROWS = 1024, 8192
#: Scores lie between this and its negative.
LONGEST = 2**63 - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from lists of any length."""
    rows = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(np.asarray(rows.offsets))
    flat = np.asarray(rows.flatten(), np.float64)
    out = np.zeros((len(rows), width), np.float64)
    out[np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def segments(rows: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Where a block's postings of a level lie, by descending level: steps of impact, and powers of two from 16 steps on."""
    steps = np.abs(rows) // step
    level = np.where(steps < 16, steps, 12 + np.floor(np.log2(np.maximum(steps, 16))))
    for x in np.unique(level)[::-1]:
        yield level == x


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs; where doubles are not exact, by whole numbers of any length, cut to a long's range."""
    sizes = np.abs(rows) @ np.abs(query)
    out = np.where(sizes < 2**53, rows @ query, 0).astype(np.int64)
    for i in np.flatnonzero(sizes >= 2**53).tolist():
        total = sum(int(x) * int(y) for x, y in zip(rows[i].tolist(), query.tolist(), strict=True))
        out[i] = max(-LONGEST, min(LONGEST, total))
    return out


def top_members(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query: positions of at least its k best rows, and their exact scores.

    ``own`` marks pairs of a query and its own row.
    """
    score = np.zeros((len(queries), len(rows)), np.float64)
    unscored = np.ones(rows.shape, bool)
    lengths = np.sqrt((rows**2).sum(axis=1))
    rounding = 4e-15 * rows.shape[1]
    open_queries = np.arange(len(queries))
    members: list[np.ndarray] = [np.arange(len(rows))] * len(queries)
    for places in segments(rows, step):
        score[open_queries] += queries[open_queries] @ np.where(places, rows, 0.0).T
        unscored &= ~places
        tail = np.sqrt((np.where(unscored, rows, 0.0) ** 2).sum(axis=1))
        rest = np.sqrt((queries[open_queries] ** 2) @ unscored.T.astype(np.float64))
        still = []
        for at, q in enumerate(open_queries.tolist()):
            spread = rest[at] * tail * (1 + rounding) + rounding * np.sqrt((queries[q] ** 2).sum()) * lengths
            low = np.where(own[q], -np.inf, np.minimum(score[q] - spread, LONGEST))
            if k < len(rows):
                kth = np.partition(low, len(low) - k)[len(low) - k]
                reach = np.flatnonzero((np.maximum(score[q] + spread, -LONGEST) >= kth) & ~own[q])
            else:
                reach = np.flatnonzero(~own[q])
            members[q] = reach
            if len(reach) > 4 * k:  # more to prove
                still.append(q)
        open_queries = np.array(still, np.int64)
        if not still:
            break
    return [(m, exact_scores(rows[m], queries[q])) for q, m in enumerate(members)]


def block_top(batches: Iterator[pa.Table], k: int, step: int) -> Iterator[tuple]:
    """Rows (query_id, vec_id, score) of one block pair given as a table of both sides."""
    for run in batches:
        is_query = np.asarray(run["is_query"].combine_chunks().cast(pa.int8())).astype(bool)
        ids, vectors = np.asarray(run["vec_id"]), run["v"].combine_chunks()
        if not is_query.any() or is_query.all():
            continue
        width = max(1, int(np.diff(np.asarray(vectors.offsets)).max()))
        whole = matrix(vectors, width)
        queries, rows = whole[is_query], whole[~is_query]
        row_ids, query_ids = ids[~is_query], ids[is_query]
        found = top_members(queries, rows, query_ids[:, None] == row_ids[None, :], k, step)
        for q, (at, score) in zip(query_ids.tolist(), found, strict=True):
            best = np.lexsort((row_ids[at], -score))[:k]
            yield np.full(len(best), q), row_ids[at][best], score[best].astype(np.int64)


def top_k(
    table: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = K,
    scale: int = SCALE,
    step: int = STEP,
) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``."""
    scaled = F.transform(F.col("v"), lambda x: F.floor(scale * x.cast("double")).cast("double"))
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL")
    rows = stored(rows.where(usable(F.col("v"))).select("vec_id", scaled.alias("v")), "vectors")
    n_rows = rows.count()
    row_blocks = max(1, -(-n_rows // ROWS))
    query_blocks = max(1, -(-(n_rows // every + 1) // QUERIES))
    deal = F.xxhash64("vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.pmod(deal, F.lit(query_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.lit(True).alias("is_query"),
        "vec_id",
        "v",
    )
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int").alias("rb"),
        F.lit(False).alias("is_query"),
        "vec_id",
        "v",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, v, s in block_top(sorted_runs(batches, 0), k, step):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    pairs = queries.unionByName(candidates).withColumn("block", F.xxhash64("qb", "rb")).drop("qb", "rb")
    pairs = pairs.select("block", "is_query", "vec_id", "v").repartition(max(8, row_blocks * query_blocks), "block")
    found = pairs.sortWithinPartitions("block").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
