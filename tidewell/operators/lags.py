"""All lags of a series at once: buckets of rows with halos, and block-bootstrap replicates as arrays over lags.

Rows carry ``idx``, gapless or not, along each series, and may carry ``block``: pairs count only within one. A bucket of BUCKET
indices takes the next rows of its neighbour as a halo, so a row is shuffled once, and again if it is within ``lags`` of a
bucket's start. In a task one bucket is a dense array, and a lag is a product of two slices of it.

Statistics of a pair (a, b): for numbers 1, a, b, a*a, b*b, a*b where both are there; for vectors 1 and their cosine.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import tails
from tidewell.functions.stats import present
from tidewell.operators.ordered import beside

BUCKET = 4096
#: Drawn starts that a task names, or looks up, at once.
DRAWS = 1 << 16
NUMBER_STATS, VECTOR_STATS = ("_m", "_a", "_b2", "_aa", "_bb", "_ab"), ("_m", "_s")


def dealt(rows: DataFrame, lags: int, *, back: bool = False, width: int | None = None) -> DataFrame:
    """Rows with ``_b``, their bucket, and again with the one before, if they are in reach of it (``back``: also the one after)."""
    width = width or BUCKET
    if lags > width:
        raise ValueError(f"lags of over {width} rows span more than two buckets")
    own, at = F.floor(F.col("idx") / width), F.pmod("idx", F.lit(width))
    places = [own, F.when(at < lags, own - 1)]
    if back:
        places.append(F.when(at >= width - lags, own + 1))
    return rows.withColumn("_b", F.explode(F.array_compact(F.array(*places))))


def dense(frame: pd.DataFrame, value: str, lags: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a bucket and both halos by place (missing: NaN), vectors of length 1; and the place's block, -1 without a row."""
    at = (frame["idx"].to_numpy(np.int64) - int(frame["_b"].iloc[0]) * width) + lags
    block = np.full(width + 2 * lags, -1, np.int64)
    block[at] = frame["block"].to_numpy(np.int64)
    values = frame[value]
    first = next((v for v in values if isinstance(v, (list, np.ndarray))), None)
    if first is None:
        out = np.full(len(block), np.nan)
        out[at] = values.to_numpy(float)
        return out, block
    out = np.full((len(block), len(first)), np.nan)
    for place, v in zip(at, values, strict=True):
        if isinstance(v, (list, np.ndarray)):
            out[place] = v
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, np.nan), block


def pair_stats(a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
    """One row of statistics for each pair; zeros where the pair does not count."""
    if a.ndim == 2:
        s = (a * b).sum(1)
        ok = there & ~np.isnan(s)
        return np.where(ok[:, None], np.stack([np.ones(len(s)), s], 1), 0.0)
    ok = there & ~np.isnan(a) & ~np.isnan(b)
    return np.where(ok[:, None], np.stack([np.ones(len(a)), a, b, a * a, b * b, a * b], 1), 0.0)


def prepared(rows: DataFrame, keys: list[str], value: str, lags: int, *, back: bool, width: int | None = None) -> DataFrame:
    block = F.col("block") if "block" in rows.columns else F.lit(0)
    return dealt(rows.select(*keys, F.col("idx").cast("long").alias("idx"), block.cast("long").alias("block"), F.col(value).alias("_v")), lags, back=back, width=width)


def is_vector(rows: DataFrame, value: str) -> bool:
    return dict(rows.dtypes)[value].startswith("array")


def key_types(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {t}, " for k, t in rows.select(*keys).dtypes)


def lag_sums(rows: DataFrame, keys: list[str], value: str, lags: list[int]) -> DataFrame:
    """Per series and lag: ``n`` pairs of rows in one block, and sums of the statistics over those with both values.

    The halo is as long as the largest lag; a bucket gives one row for each lag.
    """
    stats = VECTOR_STATS if is_vector(rows, value) else NUMBER_STATS
    reach, width = max(lags), BUCKET

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        x, block = dense(frame, "_v", reach, width)
        out = []
        for k in lags:
            a, b = slice(reach, reach + width), slice(reach + k, reach + width + k)
            there = (block[a] >= 0) & (block[a] == block[b])
            if there.any():
                out.append([*frame[keys].iloc[0], k, int(there.sum()), *pair_stats(x[a], x[b], there).sum(0)])
        return pd.DataFrame(out, columns=[*keys, "k", "n", *stats])

    schema = key_types(rows, keys) + "k int, n bigint, " + ", ".join(f"{s} double" for s in stats)
    found = prepared(rows, keys, value, reach, back=False).groupBy(*keys, "_b").applyInPandas(kernel, schema)
    return found.groupBy(*keys, "k").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in stats])


def pooled_r(m: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson's r from sums, NULL where either side does not vary beyond rounding."""
    m = F.nullif(m, F.lit(0.0))
    va, vb = saa / m - sa * sa / (m * m), sbb / m - sb * sb / (m * m)
    varies = (va > saa / m * 1e-14) & (vb > sbb / m * 1e-14)
    return F.when(varies, (sab / m - sa * sb / (m * m)) / F.sqrt(va * vb))


def centred(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Numbers less their series' mean, for sums of squares that keep their digits."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return beside(rows, mean, keys, ["_mean"]).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def lag_correlations(rows: DataFrame, keys: list[str], value: str, lags: list[int], least: int = 2) -> DataFrame:
    """(keys, k, n_pairs, n_values, rho): pairs of rows, those with both values, and their r where there are ``least``."""
    sums = lag_sums(centred(rows, keys, value), keys, value, lags)
    r = pooled_r(*[F.col(s) for s in NUMBER_STATS])
    return sums.select(*keys, "k", F.col("n").alias("n_pairs"), F.col("_m").cast("long").alias("n_values"), F.when(F.col("_m") >= least, r).alias("rho"))


def window_sums(x: np.ndarray, block: np.ndarray, lags: list[int], length: int, width: int) -> np.ndarray:
    """Of each of the first ``width`` places the sums over the pairs inside the ``length`` rows from there on, by statistic and lag.

    Running sums begin anew with each bucket, so they keep their digits however long the series is.
    """
    sums = np.zeros((width, len(NUMBER_STATS if x.ndim == 1 else VECTOR_STATS), len(lags)))
    for j, k in enumerate(lags):
        if k < length:
            reach = width + length - k
            there = (block[:reach] >= 0) & (block[:reach] == block[k : reach + k])
            run = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(pair_stats(x[:reach], x[k : reach + k], there), 0)])
            sums[:, :, j] = run[length - k : length - k + width] - run[:width]
    return sums.reshape(width, -1)


def hashed_starts(size: DataFrame, keys: list[str], block: int, reps: int, seed: int, *, inclusive: bool) -> DataFrame:
    """Starts of ceil(n / block) blocks for each replicate, uniform on 0..n - block, or one less if not ``inclusive``.

    A start is the first 60 bits of the MD5 of ``seed:keys:rep:blk`` modulo the room there is.
    """
    room = F.greatest(F.lit(1), F.col("n") - block + (1 if inclusive else 0))
    each = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    each = each.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.col("blk").cast("string"))
    return each.withColumn("_start", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % room).drop("blk", "n")


def dealt_starts(size: DataFrame, keys: list[str], block: int, reps: int, seed: int, *, inclusive: bool, width: int) -> DataFrame:
    """The starts of ``hashed_starts`` by bucket: (keys, n, rep, _b, at), ``at`` their places in a bucket of ``width`` as bytes, so few bytes a start are shuffled."""
    drawn, room = F.ceil(F.col("n") / block).cast("long"), F.greatest(F.lit(1), F.col("n") - block + (1 if inclusive else 0))
    each = size.select(*keys, "n", drawn.alias("end"), room.alias("room")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    each = each.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - 1, F.lit(DRAWS).cast("long"))))
    each = each.withColumn("stem", F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.lit("")))

    def draw(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                stem = row["stem"].encode()
                digests = b"".join([md5(stem + b"%d" % k).digest() for k in range(row["first"], min(row["first"] + DRAWS, row["end"]))])
                starts = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64) % row["room"]
                starts.sort()
                cuts = np.flatnonzero(np.diff(starts // width, prepend=-1, append=-1))
                out += [(*[row[k] for k in keys], row["n"], row["rep"], starts[a] // width, (starts[a:b] % width).astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "n", "rep", "_b", "at"])

    tasks = int(size.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(tasks, "stem", "first").mapInPandas(draw, f"{key_types(size, keys)}n bigint, rep int, _b bigint, at binary")


def rho_of(sums: np.ndarray, vectors: bool, least: int) -> np.ndarray:
    """The mean cosine of vectors or the pooled r of numbers (as ``pooled_r``) by replicate and lag from sums by replicate, statistic and lag; NaN where undefined."""
    m = np.where(sums[:, 0] > 0, sums[:, 0], np.nan)
    if vectors:
        return np.where(m >= least, sums[:, 1] / m, np.nan)
    a, b, aa, bb, ab = (sums[:, i] for i in range(1, 6))
    va, vb = aa / m - a * a / (m * m), bb / m - b * b / (m * m)
    varies = (m >= least) & (va > aa / m * 1e-14) & (vb > bb / m * 1e-14)
    return np.where(varies, (ab / m - a * b / (m * m)) / np.sqrt(np.where(varies, va * vb, 1.0)), np.nan)


def block_replicates(rows: DataFrame, keys: list[str], value: str, lags: list[int], *, block: int, reps: int, seed: int, inclusive: bool = True, least: int = 1) -> DataFrame:
    """Moving-block replicates of a series' lag curve, one row each: keys, rep, and arrays over ``lags``: ``pairs`` and ``rho``.

    Pairs lie within drawn blocks. A bucket knows the sums of each block that starts in it; the starts come to their buckets, four bytes each,
    and of a bucket goes on one row of sums for each replicate. rho is the mean cosine of vectors, the pooled r of
    numbers, and NULL at lags with fewer than ``least`` pairs. Of a series shorter than a block, only lags with k >= block - n count. Series with a null key have no rows.
    """
    vectors = is_vector(rows, value)
    rows = rows.na.drop(subset=keys)
    rows = rows if vectors else centred(rows, keys, value)
    width = -(-block // BUCKET) * BUCKET
    size = rows.groupBy(*keys).agg((F.max("idx") + 1).cast("long").alias("n"))
    starts = dealt_starts(size, keys, block, reps, seed, inclusive=inclusive, width=width)
    n_stats, n_lags, at_once = len(VECTOR_STATS if vectors else NUMBER_STATS), len(lags), DRAWS

    def pooled(drawn: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if drawn.empty or frame.empty:
            return pd.DataFrame([], columns=[*keys, "rep", "sums"])
        x, gaps = dense(frame, "_v", block, width)
        x = np.full((len(x), 1), np.nan) if vectors and x.ndim == 1 else x  # no vector is there
        sums = window_sums(x[block:], gaps[block:], lags, block, width)
        sums.reshape(width, n_stats, n_lags)[:, :, [j for j, k in enumerate(lags) if k < block - drawn["n"].iloc[0]]] = 0.0
        parts, ends = [], np.cumsum([len(x) // 4 for x in drawn["at"]])
        cuts = [0, *np.flatnonzero(np.diff(ends // at_once) > 0) + 1, len(drawn)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                at = np.frombuffer(b"".join(drawn["at"].iloc[a:b]), "<u4")
                parts.append(np.add.reduceat(sums[at], np.concatenate([[0], ends[a : b - 1] - (ends[a - 1] if a else 0)]), axis=0))
        out = drawn[[*keys, "rep"]].copy()
        out["sums"] = pd.Series(list(np.concatenate(parts)), index=out.index, dtype=object)
        return out

    dealt_rows = prepared(rows, keys, value, block, back=False, width=width)
    found = starts.groupBy(*keys, "_b").cogroup(dealt_rows.groupBy(*keys, "_b")).applyInPandas(pooled, f"{key_types(rows, keys)}rep int, sums array<double>")

    def curves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable")
        firsts = np.flatnonzero(np.diff(frame["rep"], prepend=-1))
        sums = np.add.reduceat(np.stack(list(frame["sums"])), firsts, axis=0).reshape(len(firsts), n_stats, n_lags)
        out = frame[[*keys, "rep"]].iloc[firsts].copy()
        for name, x in (("pairs", sums[:, 0]), ("rho", rho_of(sums, vectors, least))):
            out[name] = pd.Series(list(x), index=out.index, dtype=object)
        return out

    schema = f"{key_types(rows, keys)}rep int, pairs array<double>, rho array<double>"
    found = found.groupBy(*keys, F.floor(F.col("rep") / 64).alias("_some")).applyInPandas(curves, schema)
    return found.withColumn("rho", F.transform("rho", present))


def complete(replicates: DataFrame) -> DataFrame:
    """Replicates with a value at each lag."""
    return replicates.where(~F.exists("rho", lambda x: x.isNull()))


def band_mean(rho: Column, lags: list[int], low: int, high: int) -> Column:
    """Mean over the lags from ``low`` to ``high`` that have values."""
    slots = [i for i, k in enumerate(lags) if low <= k <= high]
    there = F.filter(F.slice(rho, slots[0] + 1, len(slots)), lambda x: x.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(there), F.lit(0))


def with_fits(replicates: DataFrame, lags: list[int], step_h: float, *, floor: bool = False) -> DataFrame:
    """Adds ``tau`` (and with ``floor`` also ``c``) of a decay fitted to each replicate's whole curve, batch by batch."""

    def fit(frames):
        for frame in frames:
            curves = np.stack([np.array([np.nan if x is None else x for x in r], float) for r in frame["rho"]]) if len(frame) else np.zeros((0, len(lags)))
            hours = np.array(lags, float) * step_h
            tau, c = tails.fit_decays_to_floor(hours, curves) if floor else (tails.fit_exponentials(hours, curves), np.full(len(curves), np.nan))
            more = pd.DataFrame({"tau": tau, "c": c}, index=frame.index).astype(object)
            yield pd.concat([frame, more.where(more.notna(), None)], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in replicates.dtypes)
    return replicates.mapInPandas(fit, f"{schema}, tau double, c double")
