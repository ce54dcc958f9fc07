"""Exact null distributions against enumeration, and order statistics by ranges that the data set."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import exact
from tidewell.operators import compare, ordered


@pytest.mark.parametrize("n", range(1, 8))
def test_tails_equal_enumeration(n):
    for m in range(1, 8):
        ranks, distances = {}, {}
        for first in itertools.combinations(range(n + m), n):
            i = j = u = d = 0
            for k in range(n + m):
                if k in first:
                    i, u = i + 1, u + j
                else:
                    j += 1
                d = max(d, abs(i * m - j * n))
            ranks[u], distances[d] = ranks.get(u, 0) + 1, distances.get(d, 0) + 1
        total = math.comb(n + m, n)
        for u in range(n * m + 1):
            tail = sum(c for x, c in ranks.items() if x >= max(u, n * m - u)) / total
            assert exact.rank_sum_two_sided(u, n, m) == pytest.approx(min(1, 2 * tail), rel=1e-12)
        for d in distances:
            assert exact.distance_tail(d / (n * m), n, m) == pytest.approx(sum(c for x, c in distances.items() if x >= d) / total, rel=1e-12)


def test_distance_tail_equals_a_count_of_paths():
    a, b = 121, 110
    for d in (0.1, 0.2, 0.3):
        edge, row = round(d * 1210) * 11, [0] * (b + 1)
        for x in range(a + 1):
            for y in range(b + 1):
                ways = 1 if x == y == 0 else (row[y] if x else 0) + (row[y - 1] if y else 0)
                row[y] = ways if abs(x * b - y * a) < edge else 0
        assert exact.distance_tail(edge / (a * b), a, b) == pytest.approx(1 - row[b] / math.comb(a + b, a), rel=1e-9)
    assert exact.distance_tail(1.0, 400, 300) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)


def test_p_needs_the_least_number_of_values(spark):
    rows = [(k, s, float(v)) for k, a, b in (("few", 2, 9), ("some", 3, 9), ("many", 9, 30), ("none", 0, 4)) for s, n in ((True, a), (False, b)) for v in range(100 * s, 100 * s + n)]
    df = spark.createDataFrame([*rows, ("tied", True, 1.0)] + [("tied", k % 2 == 0, 1.0 + k // 4) for k in range(20)], "k string, s boolean, v double")
    u = {r.k: r for r in compare.mann_whitney(df, ["k"], F.col("s"), "v").collect()}
    d = {r.k: r for r in compare.kolmogorov_smirnov(df, ["k"], F.col("s"), "v").collect()}
    assert u["few"].p is None and d["few"].p is None and u["none"].p is None and d["none"].p is None
    assert u["some"].p == pytest.approx(2 / math.comb(12, 3)) and d["some"].p == pytest.approx(2 / math.comb(12, 3))
    for r in (u["many"], u["tied"]):
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)))
    assert compare.mann_whitney(df.where("k = 'some'"), ["k"], F.col("s"), "v", least=5).first().p is None


def test_values_crowded_in_one_octave_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", 64)
    df = spark.range(200_000).select(F.lit("a").alias("k"), (1 + F.rand(5) * 1e-4).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", None), ("b", float("nan")), ("b", 2.0), ("b", float("inf")), ("b", -1.0)], "k string, v double"))
    steps = ordered.ranged(df.groupBy("k", "v").agg(F.count("*").alias("n")), ["k"], "v")
    sizes = sorted(r["count"] for r in steps.where("k = 'a'").groupBy("_b").count().collect())
    assert len(sizes) == 64 and sizes[-1] <= 2 * sizes[32]
    in_order = ordered.value_steps(df.where("k = 'b'"), ["k"], "v", {"n": F.lit(1)}).orderBy("up_to_n").collect()
    assert str([r.v for r in in_order]) == "[None, -1.0, 2.0, inf, nan]"
    found = ordered.quantiles(df.where("k = 'a'"), ["k"], "v", {"m": 0.5}).first()
    values = sorted(r.v for r in df.where("k = 'a'").select("v").collect())
    assert found.m == (values[99_999] + values[100_000]) / 2
