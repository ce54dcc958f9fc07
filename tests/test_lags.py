"""The lag kernel and the array replicates against loops over pairs, with buckets much smaller than the series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from tidewell.operators import lags
from tidewell.plans import registry

LAGS = [1, 2, 5, 7]
#: Queries whose starts must not be exploded into the side of a join, which Spark takes for small and sends through the driver.
DRAWN = ["floor_intervals", "vector_replicates", "vector_intervals", "long_lag_intervals"]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    x = rng.normal(size=75)
    x[[5, 33]] = np.nan
    return x, np.cumsum(rng.random(75) < 0.05), rng.normal(size=(75, 3))


@pytest.fixture(scope="module")
def rows(spark, series):
    x, block, v = series
    data = [("a", i, int(block[i]), None if np.isnan(x[i]) else float(x[i]), None if i == 40 else v[i].tolist()) for i in range(75)]
    return spark.createDataFrame([*data, (None, 3, 0, 1.0, [1.0, 0.0, 0.0])], "s string, idx long, block long, v double, x array<double>")


@pytest.mark.parametrize("width", [7, 16, 75, 4096])
def test_sums_over_all_lags(rows, series, monkeypatch, width):
    x, block, v = series
    monkeypatch.setattr(lags, "BUCKET", width)
    for r in lags.lag_correlations(rows, ["s"], "v", [0, *LAGS]).where("s = 'a'").collect():
        pairs = [(x[i], x[i + r.k]) for i in range(75 - r.k) if block[i] == block[i + r.k]]
        both = np.array([p for p in pairs if not np.isnan(p).any()])
        assert (r.n_pairs, r.n_values) == (len(pairs), len(both)) and r.rho == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    for r in lags.lag_sums(rows, ["s"], "x", LAGS).where("s = 'a'").collect():
        near = [unit[i] @ unit[i + r.k] for i in range(75 - r.k) if block[i] == block[i + r.k] and 40 not in (i, i + r.k)]
        assert r["_m"] == len(near) and r["_s"] == pytest.approx(sum(near), abs=1e-9)


def test_a_row_is_shuffled_once_and_its_halo_again(rows, monkeypatch):
    monkeypatch.setattr(lags, "BUCKET", 25)
    assert lags.dealt(rows.where("s = 'a'"), 5).where("_b >= 0").count() == 75 + 2 * 5
    assert lags.dealt(rows.where("s = 'a'"), 5, back=True).where("_b BETWEEN 0 AND 2").count() == 75 + 4 * 5
    with pytest.raises(ValueError, match="more than two buckets"):
        lags.dealt(rows, 26)


def test_replicates_pool_pairs_inside_blocks(rows, series, monkeypatch):
    monkeypatch.setattr(lags, "BUCKET", 16)
    x, block, v = series
    own, y = rows.where("s = 'a'"), x - np.nanmean(x)
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    size = own.groupBy("s").agg((F.max("idx") + 1).alias("n"))
    for inclusive, length in ((True, 10), (False, 6)):
        starts = lags.hashed_starts(size, ["s"], length, 3, 7, inclusive=inclusive).collect()
        assert all(0 <= s["_start"] <= 75 - length - (not inclusive) for s in starts) and len(starts) == 3 * -(-75 // length)
        numbers = {r.rep: r for r in lags.block_replicates(own, ["s"], "v", LAGS, block=length, reps=3, seed=7, inclusive=inclusive).collect()}
        vectors = {r.rep: r for r in lags.block_replicates(own, ["s"], "x", LAGS, block=length, reps=3, seed=7, inclusive=inclusive).collect()}
        assert len(numbers) == len(vectors) == 3
        for rep in range(3):
            for j, k in enumerate(LAGS):
                at = [i for s in starts if s.rep == rep for i in range(s["_start"], s["_start"] + length - k) if block[i] == block[i + k]]
                near = [unit[i] @ unit[i + k] for i in at if 40 not in (i, i + k)]
                both = np.array([(y[i], y[i + k]) for i in at if not np.isnan(y[i] + y[i + k])])
                assert vectors[rep].pairs[j] == len(near) and numbers[rep].pairs[j] == len(both)
                assert vectors[rep].rho[j] == (pytest.approx(np.mean(near), abs=1e-9) if near else None)
                if len(both) > 2:
                    assert numbers[rep].rho[j] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_complete_replicates_and_bands(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2, 0.6]), (1, [0.1, None, 0.5]), (2, [None, None, 0.5])], "rep int, rho array<double>")
    assert [r.rep for r in lags.complete(df).collect()] == [0]
    means = {r.rep: r.m for r in df.select("rep", lags.band_mean(F.col("rho"), [4, 5, 6], 4, 5).alias("m")).collect()}
    assert means == {0: pytest.approx(0.15), 1: pytest.approx(0.1), 2: None}


def test_starts_come_to_their_buckets_in_four_bytes_each(rows):
    size = rows.where("s = 'a'").groupBy("s").agg((F.max("idx") + 1).alias("n"))
    want = sorted((r.rep, r["_start"]) for r in lags.hashed_starts(size, ["s"], 6, 5, 7, inclusive=False).collect())
    found = lags.dealt_starts(size, ["s"], 6, 5, 7, inclusive=False, width=16).collect()
    assert sorted((r.rep, r["_b"] * 16 + int(k)) for r in found for k in np.frombuffer(r["at"], "<u4")) == want and len(found) <= 5 * 5


@pytest.mark.parametrize(("width", "length"), [(16, 10), (4, 10), (4096, 10)])
def test_replicates_of_a_series_with_holes(rows, series, monkeypatch, width, length):
    monkeypatch.setattr(lags, "BUCKET", width)
    monkeypatch.setattr(lags, "DRAWS", 3)
    x, block, v = series
    own = rows.where("s = 'a' AND idx % 9 <> 4 AND idx NOT BETWEEN 48 AND 66")
    there = {r.idx for r in own.collect()} - {40}
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    size = own.groupBy("s").agg((F.max("idx") + 1).alias("n"))
    starts = lags.hashed_starts(size, ["s"], length, 4, 7, inclusive=True).collect()
    for r in lags.block_replicates(own, ["s"], "x", LAGS, block=length, reps=4, seed=7).collect():
        for j, k in enumerate(LAGS):
            near = [unit[i] @ unit[i + k] for s in starts if s.rep == r.rep for i in range(s["_start"], s["_start"] + length - k) if {i, i + k} <= there and block[i] == block[i + k]]
            assert r.pairs[j] == len(near) and r.rho[j] == (pytest.approx(np.mean(near), abs=1e-9) if near else None)


@pytest.mark.parametrize("name", DRAWN)
def test_starts_meet_their_sums_without_a_join(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "_start" not in plan
