"""Memory of series: lag curves, decay fits, moving-block bootstrap, periodicity bins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import tails
from tidewell.operators.lags import lag_correlations


def detrended(df: DataFrame, keys: list[str], x: str, y: str, name: str = "detrended") -> DataFrame:
    """y less its least-squares line on x, per series; nulls stay null."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return df.join(fit, keys).withColumn(name, F.col(y) - (F.col("_s") * F.col(x) + F.col("_i"))).drop("_s", "_i")


def grid_autocorrelation(grid: DataFrame, keys: list[str], value: str, lags: int, least: int = 5) -> DataFrame:
    """Pairwise-complete r of a regular grid with itself k points later, k = 0..lags; NULL below ``least`` pairs."""
    rows = grid.where(F.col(value).isNotNull()).select(*keys, F.col("g").alias("idx"), value)
    return lag_correlations(rows, keys, value, list(range(lags + 1)), least).drop("n_values")


def regime(mid: Column, far: Column) -> Column:
    """Of the means of a lag curve over a middle and a far band: rising again, decaying or flat."""
    return F.when((far > mid) & (mid > 1e-9), "weekly-leaning").when(mid > far, "decaying").otherwise("flat")


def decay_fits(curve: DataFrame, key: str, k: str, rho: str, step_h: float, *, floor: bool = False) -> DataFrame:
    """Per series: tau (and A, C with ``floor``) of the lag curve, with R2; NULL below three lags."""
    schema = f"{key} {curve.schema[key].dataType.simpleString()}, amplitude double, tau double, floor double, r2 double"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        use = frame[(frame["k"] >= 1) & frame["rho"].notna()].sort_values("k")
        hours, y = use["k"].to_numpy(float) * step_h, use["rho"].to_numpy(float)
        if len(y) < 3:
            found = (None, None, None, None)
        elif floor:
            found = tails.fit_decay_to_floor(hours, y)
        else:
            tau, r2 = tails.fit_exponential(hours, y)
            found = (1.0, tau, 0.0, r2)
        return pd.DataFrame([(frame[key].iloc[0], *found)], columns=[key, "amplitude", "tau", "floor", "r2"])

    return curve.select(key, F.col(k).alias("k"), F.col(rho).alias("rho")).groupBy(key).applyInPandas(fit, schema)


def ar1_time(rho1: Column, step_h: float) -> Column:
    """-step / ln(rho), NULL unless rho is positive."""
    return F.when(rho1 > 0, -F.lit(step_h) / F.ln(rho1))


def interval_reading(intervals: DataFrame, points: DataFrame, keys: list[str], point: str, limit: float) -> DataFrame:
    """Intervals beside their point estimates: whether these lie outside (false if either is missing), their ratio to the median, and whether the upper end exceeds a limit."""
    both = intervals.join(points.select(*keys, point), keys, "left")
    return both.withColumns(
        {
            "outside": F.coalesce(~F.col(point).between(F.col("low"), F.col("high")), F.lit(False)),
            "ratio": F.col(point) / F.nullif(F.col("median"), F.lit(0.0)),
            "exceeds": F.col("high") > limit,
        }
    )


def percentile_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2.5 and 97.5 percent points and median of replicates, where more than ten are there."""
    q = F.percentile(value, F.lit([0.025, 0.5, 0.975]))
    return df.groupBy(*keys).agg(F.count(value).alias("n_ok"), F.count_if(F.col(value).isNull()).alias("n_failed"), F.when(F.count(value) > 10, q).alias("q")).select(
        *keys, "n_ok", "n_failed", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high")
    )


def band_means(curve: DataFrame, keys: list[str], k: str, rho: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean of the lag curve over bands of lags (inclusive), with the least number of pairs."""
    each = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in bands.items()])
    rows = curve.select(*keys, k, rho, "n_pairs", F.explode(each).alias("_b")).where(F.col(k).between(F.col("_b.a"), F.col("_b.b")))
    return rows.groupBy(*keys, F.col("_b.band").alias("band")).agg(F.avg(rho).alias("mean_rho"), F.min("n_pairs").alias("min_pairs"))


def periodicity_bins(pairs: DataFrame, keys: list[str], similarity: Column) -> DataFrame:
    """Mean similarity of lag pairs by difference of hours (four bins) and of weekdays (seven)."""
    hour = lambda t: F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600
    by_hour = F.least(F.lit(3), F.floor(F.pmod(hour("ts_b") - hour("ts_a"), F.lit(24.0)) / 6)).cast("int")
    by_day = F.pmod(F.weekday("ts_b") - F.weekday("ts_a"), F.lit(7))
    bins = F.array(F.struct(F.lit("diurnal").alias("kind"), by_hour.alias("bin")), F.struct(F.lit("weekly").alias("kind"), by_day.alias("bin")))
    rows = pairs.select(*keys, similarity.alias("s"), F.explode(bins).alias("x"))
    return rows.groupBy(*keys, "x.kind", "x.bin").agg(F.count("*").alias("n_pairs"), F.avg("s").alias("mean_similarity"))


def change_points(series: DataFrame, key: str, index: str, value: str, *, least: int = 3, penalties: int = 20) -> DataFrame:
    """PELT with an RBF kernel cost on each series; the penalty is chosen by BIC over a geometric range.

    Series are searched in parallel, each by one task: the search needs a kernel matrix, so a
    series should be a resampled grid of at most some thousand points. The kernel's width is the
    median heuristic. ``change_idx`` is the last row before a break; also the number of breaks at
    penalties lower and higher by the root of three.
    """
    kind = series.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, change_idx long, n_changes int, penalty double, n_low int, n_high int"

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        use = frame[frame[value].notna()].sort_values(index)
        found = best_breaks(use[value].to_numpy(float), least, penalties)
        if found is None:
            return pd.DataFrame([], columns=["k", "c", "n", "p", "l", "h"])
        breaks, penalty, low, high = found
        rows = [(frame[key].iloc[0], int(use[index].iloc[b - 1]), len(breaks), penalty, low, high) for b in breaks]
        return pd.DataFrame(rows or [(frame[key].iloc[0], None, 0, penalty, low, high)], columns=[key, "change_idx", "n_changes", "penalty", "n_low", "n_high"])

    return series.select(key, index, value).groupBy(key).applyInPandas(search, schema)


class KernelCost:
    """Within-segment kernel scatter n - sum(K) / n from a two-dimensional running sum."""

    def __init__(self, x: np.ndarray) -> None:
        d = (x[:, None] - x[None, :]) ** 2
        mid = np.median(d[np.triu_indices(len(x), 1)])
        self.sums = np.zeros((len(x) + 1, len(x) + 1))
        self.sums[1:, 1:] = np.exp(-d / (mid or 1.0)).cumsum(0).cumsum(1)

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        inner = self.sums[b, b] - self.sums[a, b] - self.sums[b, a] + self.sums[a, a]
        return (b - a) - inner / (b - a)


def pelt(cost: KernelCost, n: int, penalty: float, least: int) -> list[int]:
    """Optimal breaks for a penalty, with pruning of starts that cannot win again."""
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    starts = [0]
    for end in range(least, n + 1):
        open_ = np.array([s for s in starts if end - s >= least])
        if len(open_):
            total = best[open_] + cost(open_, end)
            at = int(np.argmin(total))
            best[end], last[end] = total[at] + penalty, open_[at]
            drop = set(open_[total > best[end]].tolist())
            starts = [s for s in starts if s not in drop]
        starts.append(end)
    out, at = [], n
    while last[at] > 0:
        at = int(last[at])
        out.append(at)
    return out[::-1]


def best_breaks(x: np.ndarray, least: int, penalties: int) -> tuple[list[int], float, int, int] | None:
    if len(x) < 2 * least:
        return None
    cost, n, seen = KernelCost(x), len(x), {}
    for penalty in np.geomspace(0.2, 200, penalties).tolist():
        breaks = pelt(cost, n, penalty, least)
        seen.setdefault(len(breaks), (breaks, penalty))

    def bic(item: tuple[list[int], float]) -> float:
        edges = [0, *item[0], n]
        total = sum(float(cost(np.array([a]), b)[0]) for a, b in zip(edges[:-1], edges[1:], strict=True))
        return n * math.log(total / n + 1e-12) + (len(item[0]) + 1) * math.log(n)

    breaks, penalty = min(seen.values(), key=bic)
    low, high = (len(pelt(cost, n, penalty * f, least)) for f in (1 / math.sqrt(3), math.sqrt(3)))
    return breaks, penalty, low, high
