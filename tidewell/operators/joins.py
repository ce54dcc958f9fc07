"""Joins on time: nearest within a tolerance, intervals, grids and lags, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import gap_blocks, seconds


def nearest(left: DataFrame, right: DataFrame, left_s: Column, right_s: Column, right_key: str, tolerance: float | None = None, width: float = 86400) -> DataFrame:
    """Each left row with the right row nearest in time, if it is at most ``tolerance`` seconds away.

    Both sides are put in one order of time within buckets of ``width`` seconds, where a window carries the last right
    row at or before each left row, and the next one at or after it; buckets without such rows take them from the nearest
    bucket that has one. So the work grows with the rows, however dense they are, and a task orders one bucket.
    Ties go to the earlier right row, then to the least ``right_key``. Left rows without a match or a time stay, with nulls.
    """
    none = F.lit(None)
    of_right = F.struct(*right.columns)
    a = left.select(left_s.alias("s"), F.struct(*left.columns).alias("l"), none.cast(right.schema).alias("r"))
    b = right.select(right_s.alias("s"), none.cast(left.schema).alias("l"), of_right.alias("r")).where("s IS NOT NULL")
    both = a.unionByName(b).withColumn("b", F.floor(F.col("s") / width))
    found = F.when(F.col("r").isNotNull(), F.struct(F.col("s").alias("s"), F.col("r").alias("r")))
    is_left, key = F.col("l").isNotNull(), F.col("r")[right_key]
    before = Window.partitionBy("b").orderBy("s", is_left, key.desc())
    after = Window.partitionBy("b").orderBy(F.desc("s"), is_left, key.desc())
    near = both.withColumns({"p": F.last(found, ignorenulls=True).over(before), "n": F.last(found, ignorenulls=True).over(after)}).where(is_left)
    rights = both.where(~is_left).groupBy("b").agg(F.min_by(found, F.struct(-F.col("s"), key)).alias("last_one"), F.min_by(found, F.struct("s", key)).alias("first_one"))
    line = Window.orderBy("b")  # one row a bucket
    edges = both.where("b IS NOT NULL").select("b").distinct().join(rights, "b", "left").select(
        "b",
        F.last("last_one", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("bucket_p"),
        F.first("first_one", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("bucket_n"),
    )
    near = near.join(edges, "b", "left").withColumns({"p": F.coalesce("p", "bucket_p"), "n": F.coalesce("n", "bucket_n")})
    to_p, to_n = F.col("s") - F.col("p.s"), F.col("n.s") - F.col("s")
    best = F.when(to_n.isNull() | (to_p <= to_n), F.col("p")).otherwise(F.col("n"))
    far = F.abs(F.col("s") - F.col("best.s"))
    near = near.withColumn("best", best).withColumn("d", far)
    if tolerance is not None:
        near = near.withColumn("best", F.when(F.col("d") <= tolerance, F.col("best"))).withColumn("d", F.when(F.col("best").isNotNull(), F.col("d")))
    return near.select("l.*", *[F.col("best.r")[c].alias(c) for c in right.columns], F.col("d").alias("delta_s"))


def asof_coverage(matched: DataFrame, right: DataFrame, right_key: str) -> DataFrame:
    """Matched and unmatched left rows, and right rows that no left row took."""
    taken = matched.where(F.col(right_key).isNotNull()).select(right_key).distinct()
    spare = right.join(taken, right_key, "left_anti").agg(F.count("*").alias("unmatched_right"))
    sides = matched.agg(F.count(right_key).alias("matched"), (F.count("*") - F.count(right_key)).alias("unmatched_left"))
    return sides.join(spare)  # one row with one row


def grid_resample(df: DataFrame, keys: list[str], ts: str, value: str, step_h: float = 6, tolerance_h: float = 3) -> DataFrame:
    """Regular grid from each series' first reading; the nearest reading within the tolerance, or null.

    Each reading goes to the grid points it can serve, and each point takes the nearest one
    (ties: the earlier): no range join.
    """
    step, tolerance = step_h * 3600, tolerance_h * 3600
    dense = df.where(F.col(value).isNotNull()).select(*keys, seconds(F.col(ts)).alias("s"), F.col(value).alias("v"))
    ends = dense.groupBy(*keys).agg(F.min("s").alias("s0"), F.max("s").alias("s1"))
    grid = ends.select(*keys, "s0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("s1") - F.col("s0")) / step))).alias("g"))
    low = F.ceil((F.col("s") - F.col("s0") - tolerance) / step)
    high = F.floor((F.col("s") - F.col("s0") + tolerance) / step)
    served = dense.join(ends.select(*keys, "s0"), keys).withColumn("g", F.explode(F.when(low <= high, F.sequence(low, high))))
    away = F.abs(F.col("s") - F.col("s0") - F.col("g") * step)
    best = served.groupBy(*keys, "g").agg(F.min_by("v", F.struct(away, "s")).alias("value"))
    return grid.join(best, [*keys, "g"], "left").select(*keys, "g", F.timestamp_seconds(F.col("s0") + F.col("g") * step).alias("grid_ts"), "value")


def within_interval(points: DataFrame, logs: DataFrame, point_s: Column, log_s: Column, reach: float) -> DataFrame:
    """Each point with all log rows at most ``reach`` seconds away (inclusive); points without one stay, equal points each.

    Log rows go to the three buckets that they can reach; the join is an outer one, so null columns need no care.
    """
    a = points.withColumn("_ps", point_s).withColumn("_b", F.floor(F.col("_ps") / reach))
    b = logs.withColumn("_qs", log_s).withColumn("_c", F.explode(F.array(*[F.floor(F.col("_qs") / reach) + k for k in (-1, 0, 1)])))
    met = (F.col("_b") == F.col("_c")) & (F.abs(F.col("_ps") - F.col("_qs")) <= reach)
    return a.join(b, met, "left").drop("_b", "_c", "_ps", "_qs")


def first_interval(points: DataFrame, intervals: DataFrame, point_key: str, point_s: Column, start_s: Column, end_s: Column, label: str, reach: float, keys: list[str] | None = None) -> DataFrame:
    """Adds ``near``: the label of the first interval, by start and label, that begins at most ``reach`` seconds after the point
    and ends at most as long before it; null if there is none. Intervals and times that are null or NaN count nowhere.
    With ``keys``, only intervals of the point's own series count; a null key has none.

    No pairs are made. Each interval goes to buckets narrower than itself, so it begins in one and ends in a later one: in its first bucket it
    serves the points from its start on, in its last one those up to its end, in those between all of them, of which the least interval is enough.
    A window in either direction carries the least interval so far to each point. Intervals of much different lengths have buckets of their
    own, twice as wide from one class of lengths to the next, and points go to all classes that there are; intervals without length have a bucket each.
    """
    keys = keys or []
    low, high = start_s - reach, end_s + reach
    b = intervals.na.drop(subset=keys).select(*keys, F.struct(start_s.alias("s"), F.col(label).alias("label")).alias("_f"), low.cast("double").alias("_low"), high.cast("double").alias("_high"))
    b = b.where("_low <= _high AND NOT isnan(_low) AND NOT isnan(_high)")
    b = b.withColumn("_w", F.when(F.col("_high") > F.col("_low"), F.pow(F.lit(2.0), F.floor(F.log2(F.col("_high") - F.col("_low"))) - 1)).otherwise(0.0))
    bucket = lambda x: F.when(F.col("_w") > 0, F.floor(x / F.col("_w")).cast("double")).otherwise(x)
    b = b.withColumns({"_first": bucket(F.col("_low")), "_last": bucket(F.col("_high"))})
    whole = b.where("_last > _first + 1").withColumn("_b", F.explode(F.sequence((F.col("_first") + 1).cast("long"), (F.col("_last") - 1).cast("long"))))
    whole = whole.groupBy(*keys, "_w", "_b").agg(F.min("_f").alias("_from")).select(*keys, "_w", F.col("_b").cast("double").alias("_b"), F.lit(float("-inf")).alias("_at"), "_from")
    begun = b.groupBy(*keys, "_w", F.col("_first").alias("_b"), F.col("_low").alias("_at")).agg(F.min("_f").alias("_from"))
    ended = b.where("_w > 0").groupBy(*keys, "_w", F.col("_last").alias("_b"), F.col("_high").alias("_at")).agg(F.min("_f").alias("_until"))
    classes = b.select("_w").distinct()
    a = points.na.drop(subset=keys).select(*keys, F.struct(point_key).alias("_p"), point_s.cast("double").alias("_at")).where("_at IS NOT NULL AND NOT isnan(_at)")
    a = a.join(F.broadcast(classes)).withColumn("_b", bucket(F.col("_at")))  # some classes of lengths
    rows = a.unionByName(whole.unionByName(begun), allowMissingColumns=True).unionByName(ended, allowMissingColumns=True)
    series = Window.partitionBy(*keys, "_w", "_b")
    before = series.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = series.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select("_p", F.least(F.min("_from").over(before), F.min("_until").over(after)).alias("_f")).where("_p IS NOT NULL AND _f IS NOT NULL")
    first = met.groupBy(F.col(f"_p.{point_key}").alias(point_key)).agg(F.min("_f").alias("_f"))
    return points.join(first.select(point_key, F.col("_f.label").alias("near")), point_key, "left")


def lag_pairs(df: DataFrame, keys: list[str], ts: str, value: str, lags: int, limit_h: float, tie: str | None = None) -> DataFrame:
    """Pairs (idx, idx + k) for k = 1..lags with no gap of over ``limit_h`` hours between them.

    An equi-join on the later index; a running count of big gaps replaces the scan between.
    """
    order = [ts, tie] if tie else [ts]
    rows = gap_blocks(df, keys, order, limit_h).select(*keys, "idx", "block", ts, value)
    first = rows.select(*keys, "block", F.col("idx").alias("i"), F.col(ts).alias("ts_a"), F.col(value).alias("a")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.lit(lags)))
    ).withColumn("j", F.col("i") + F.col("k"))
    later = rows.select(*keys, "block", F.col("idx").alias("j"), F.col(ts).alias("ts_b"), F.col(value).alias("b"))
    return first.join(later, [*keys, "block", "j"])
