"""Ordered-series operators: gaps, rolling statistics, autocorrelation, runs, ranks.

``keys`` name the series; each series is ordered by ``order`` in its own window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import safe_corr
from tidewell.sources.shared import kept


def over(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, from either timestamp type."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


#: Width of a bucket of whole numbers, and buckets of fractions between a number and its double.
BUCKET, PER_OCTAVE = 4096, 256
#: Ranges that the distinct values of a series are cut in, and the inverse of the sketch's relative error in ranks.
RANGES, ACCURACY = 256, 10_000
NUMBERS = ("double", "float", "tinyint", "smallint", "int", "bigint", "decimal")


def bucket_of(df: DataFrame, column: str) -> Column:
    """A coarse place along an ordering column that never falls with it: days of times, ranges of whole numbers, bands of the logarithm
    of fractions (infinities and NaN share the last one), else one bucket.

    A task then orders one bucket of a series, and of a series only its buckets are put in one order.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float") or kind.startswith("decimal"):
        x = F.col(column).cast("double")
        size = F.floor(F.least(F.greatest(F.log2(F.abs(x)), F.lit(-1100.0)), F.lit(1100.0)) * PER_OCTAVE) + 1200 * PER_OCTAVE
        return F.when(x > 0, size).when(x < 0, -size).when(x == 0, F.lit(0).cast("long"))
    if kind.startswith("timestamp"):
        return F.to_date(column)
    if kind in ("bigint", "int"):
        return F.floor(F.col(column) / BUCKET)
    return F.lit(0)


def beside(df: DataFrame, small: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of a table with one row per key at each row of ``df``; null keys meet null keys, rows without a match stay."""
    named = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def attached(df: DataFrame, buckets: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A column of the table of buckets at each row of the bucket."""
    return beside(df, buckets, [*keys, "_b"], [column])


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, *, back: bool = False, bucket: Column | None = None) -> DataFrame:
    """Adds the struct of ``columns`` of each series' next row (``back``: the one before), null at its end.

    The last row of a bucket takes the first row of the next bucket, of which there is one row each.
    """
    own, place = F.struct(*columns), F.struct(*order)
    move, end = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    inner = df.withColumn("_b", bucket_of(df, order[0]) if bucket is None else bucket)
    ends = inner.groupBy(*keys, "_b").agg(end(own, place).alias("_end"))
    ends = ends.select(*keys, "_b", move("_end").over(over(keys, ["_b"])).alias("_far"))
    inner = inner.withColumn("_near", move(own).over(over([*keys, "_b"], order)))
    return attached(inner, ends, keys, "_far").withColumn(name, F.coalesce("_near", "_far")).drop("_b", "_near", "_far")


def running_sums(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, Column], *, bucket: Column | None = None) -> DataFrame:
    """Sums of the named amounts over each series' rows up to and including this one: within buckets, plus what earlier buckets hold."""
    inner = df.withColumn("_b", bucket_of(df, order[0]) if bucket is None else bucket).withColumns({f"_x{i}": x for i, x in enumerate(amounts.values())})
    before = over(keys, ["_b"]).rowsBetween(Window.unboundedPreceding, -1)
    own = over([*keys, "_b"], order).rowsBetween(Window.unboundedPreceding, 0)
    slots = range(len(amounts))
    totals = inner.groupBy(*keys, "_b").agg(*[F.sum(f"_x{i}").alias(f"_t{i}") for i in slots])
    totals = totals.select(*keys, "_b", F.struct(*[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"t{i}") for i in slots]).alias("_before"))
    found = attached(inner.withColumns({f"_x{i}": F.sum(f"_x{i}").over(own) for i in slots}), totals, keys, "_before")
    return found.withColumns({name: F.col(f"_x{i}") + F.col(f"_before.t{i}") for i, name in enumerate(amounts)}).drop("_b", "_before", *[f"_x{i}" for i in slots])


def with_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row numbers from 0 along each series."""
    return running_sums(df, keys, order, {"idx": F.lit(1).cast("long")}).withColumn("idx", F.col("idx") - 1)


def with_gaps(df: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """Hours to the next reading, and its difference of the un-dropped values; equal times are ordered by ``tie``."""
    ahead = neighbour(df, keys, [ts, tie], [ts, value], "next")
    gap = (seconds(F.col(f"next.{ts}")) - seconds(F.col(ts))) / 3600
    return ahead.withColumns({"gap_h": gap, "diff1": F.col(f"next.{value}") - F.col(value)}).drop("next")


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 8, least: int = 4) -> DataFrame:
    """Mean and sample deviation of the last ``size`` rows where ``least`` of them hold values.

    Rows are dealt to buckets by their index; the last ``size`` - 1 of a bucket also go to the next one.
    """
    rows = with_index(df, keys, order).withColumn("_own", F.floor(F.col("idx") / BUCKET))
    both = F.when(F.col("idx") % BUCKET > BUCKET - size, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
    w = over([*keys, "_b"], ["idx"]).rowsBetween(-(size - 1), 0)
    enough = F.count(value).over(w) >= least
    found = rows.withColumn("_b", F.explode(both)).withColumns(
        {
            "roll_mean": F.when(enough, F.avg(value).over(w)),
            "roll_std": F.when(enough, F.stddev_samp(value).over(w)),
        }
    )
    return found.where("_b = _own").drop("_b", "_own", "idx")


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """r of each series with itself ``lag`` non-null rows later, by an equi-join of indices; NULL for short or constant series."""
    dense = with_index(df.where(F.col(value).isNotNull()), keys, order)
    first = dense.select(*keys, F.col(value).alias("a"), "idx", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("idx", F.col("idx") - F.col("lag"))
    pairs = first.join(dense.select(*keys, "idx", F.col(value).alias("b")), [*keys, "idx"], "left")
    return pairs.groupBy(*keys, "lag").agg(
        F.count("b").alias("n_pairs"), F.when(F.count("b") > 1, safe_corr(F.col("a"), F.col("b"))).alias("acf")
    )


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of neighbouring flagged rows (a null flag is no flag): one row per run with its rows' ends and the largest gap inside.

    Rows of a run have seen equally many unflagged ones.
    """
    flagged = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    flagged = kept(flagged.select(*dict.fromkeys([*keys, *order]), "flag"), "flags")
    marked = running_sums(flagged, keys, order, {"run": (~F.col("flag")).cast("long")})
    marked = neighbour(marked, keys, order, [order[0], "flag"], "before", back=True).where("flag")
    gap = (F.col(order[0]).cast("double") if dict(df.dtypes)[order[0]] in ("bigint", "int", "double") else seconds(F.col(order[0])))
    last = F.col("before")[order[0]]
    last = last.cast("double") if dict(df.dtypes)[order[0]] in ("bigint", "int", "double") else seconds(last)
    inside = F.when(F.col("before.flag"), gap - last)
    return marked.groupBy(*keys, "run").agg(
        F.count("*").alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.max(inside).alias("largest_gap_s")
    )


def run_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.sum("length").alias("n_flagged"),
        F.max("length").alias("longest"),
        F.avg("length").alias("mean_length"),
        F.count_if(F.col("length") == 1).alias("n_isolated"),
        F.count_if(F.col("length") >= 2).alias("n_persistent"),
        F.max((seconds(F.col("end")) - seconds(F.col("start"))) / 3600).alias("longest_span_h"),
    )


def ranged(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``_b``, the range of its series' values that a row's value lies in: equally many rows of ``steps`` to each.

    The bounds come from a quantile sketch of each series, which is built within partitions and merged; values equal to a bound
    lie below it, null first and NaN last.
    """
    x = F.col(value).cast("double")
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = steps.where(~F.isnan(x)).groupBy(*keys).agg(F.percentile_approx(x, shares, ACCURACY).alias("_bounds"))
    place = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < x))
    return beside(steps, bounds, keys, ["_bounds"]).withColumn("_b", place).drop("_bounds")


def value_steps(df: DataFrame, keys: list[str], value: str, amounts: dict[str, Column]) -> DataFrame:
    """Per series and distinct value: sums of the amounts, and ``up_to_`` their running sums in the order of the values.

    Rows are summed up by value before they are shuffled and kept in a table; distinct numbers are put in order by ranges that the
    data set (``ranged``), a range to a task, other values in one.
    """
    steps = kept(df.groupBy(*keys, value).agg(*[F.sum(x).alias(name) for name, x in amounts.items()]), "steps")
    sums = {f"up_to_{name}": F.col(name) for name in amounts}
    if not dict(steps.dtypes)[value].startswith(NUMBERS):
        return running_sums(steps, keys, [value], sums)
    return running_sums(ranged(steps, keys, value), keys, [value], sums, bucket=F.col("_b"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1; tied values share the mean of their ranks. Nulls come first."""
    steps = value_steps(df, keys, value, {"n": F.lit(1).cast("long")})
    return beside(df, steps.withColumn(name, F.col("up_to_n") - (F.col("n") - 1) / 2.0), [*keys, value], [name])


def counted_values(df: DataFrame, keys: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """Per series and distinct value ``_v``: ``n`` rows (or their weights) and ``up_to_n``; nulls weigh nothing."""
    rows = df.select(*keys, value.cast("double").alias("_v"), (F.lit(1).cast("long") if weight is None else weight).alias("_w"))
    return value_steps(rows, keys, "_v", {"n": F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(F.lit(0).cast("long"))})


def step_quantiles(steps: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``counted_values``, and their number ``n_values``; series without values have no row.

    A quantile lies between the first values whose running counts exceed its two neighbouring places.
    """
    placed = beside(steps, steps.groupBy(*keys).agg(F.sum("n").alias("n_values")), keys, ["n_values"])
    first_above = lambda place: F.min(F.when(F.col("up_to_n") > place, F.col("_v")))
    at = lambda share: (F.col("n_values") - 1) * F.lit(share)
    ends = [x for i, p in enumerate(shares.values()) for x in (first_above(F.floor(at(p))).alias(f"_l{i}"), first_above(F.ceil(at(p))).alias(f"_h{i}"))]
    found = placed.groupBy(*keys, "n_values").agg(*ends).where("n_values > 0")
    part = lambda share: at(share) - F.floor(at(share))
    between = [(F.col(f"_l{i}") * (1 - part(p)) + F.col(f"_h{i}") * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())]
    return found.select(*keys, "n_values", *between)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of the values that are there, and their number ``n_values``."""
    return step_quantiles(counted_values(df, keys, F.col(value)), keys, shares)


def gap_blocks(df: DataFrame, keys: list[str], order: list[str], limit_h: float) -> DataFrame:
    """Adds ``idx`` along each series and ``block``, the number of gaps of over ``limit_h`` hours so far.

    Rows of one block have no such gap between them. Times come first in ``order``.
    """
    ts = order[0]
    ahead = neighbour(df, keys, order, [ts], "before", back=True)
    big = F.coalesce(seconds(F.col(ts)) - seconds(F.col("before")[ts]) > limit_h * 3600, F.lit(False)).cast("long")
    sums = running_sums(ahead, keys, order, {"idx": F.lit(1).cast("long"), "block": big})
    return sums.withColumn("idx", F.col("idx") - 1).drop("before")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order (unlike dropDuplicates, which takes any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
