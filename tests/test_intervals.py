"""The first interval of each point against a loop over all pairs, and rows where pairs would be too many."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import joins

POINTS, INTERVALS = "k string, id long, t double", "k string, label long, a double, b double"


@pytest.mark.parametrize("keyed", [False, True])
def test_first_interval_is_that_of_all_pairs(spark, keyed):
    rng = random.Random(3)
    key = lambda: rng.choice(["x", "y", None])
    points = [(key(), i, rng.choice([None, math.nan, *[rng.randint(-400, 4000) / 4] * 18])) for i in range(300)]
    length = lambda: rng.choice([0, 0.25, 1, 7, 60, 64, 500, -3, -200, -10.0])
    intervals = [(key(), i, a := rng.randint(-400, 4000) / 4, a + length()) for i in range(60)] + [("x", 99, None, 5.0), ("x", 98, 5.0, None), ("x", 97, math.nan, 9.0)]
    for reach in (5.0, 0.5):
        found = joins.first_interval(
            spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS), "id", F.col("t"), F.col("a"), F.col("b"), "label", reach, ["k"] if keyed else None
        )
        good = [x for x in intervals if x[2] is not None and x[3] is not None and not math.isnan(x[2])]
        want = {}
        for k, i, t in points:
            near = [(a, label) for j, label, a, b in good if t is not None and a - reach <= t <= b + reach and (not keyed or (k == j and k is not None))]
            want[i] = min(near)[1] if near else None
        assert {r.id: r.near for r in found.collect()} == want and sum(x is not None for x in want.values()) > 20


def test_many_intervals_at_one_point_make_no_pairs(spark):
    points = spark.range(60_000).select("id", (F.col("id") % 1000).cast("double").alias("t"))
    intervals = spark.range(60_000).select(F.col("id").alias("label"), (F.col("id") % 1000).cast("double").alias("s"))
    found = joins.first_interval(points, intervals, "id", F.col("t"), F.col("s"), F.col("s") + 3600, "label", 1800)
    assert found.where("near = 0").count() == 60_000  # 3.6 billion pairs lie near enough
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "Join Inner, (_b" not in plan
