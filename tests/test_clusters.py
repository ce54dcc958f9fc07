"""Clusters near points, flags of metrics, spreads under relabelings: against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import quality, vectors
from tidewell.plans import series


def test_planted_shift_and_cluster_are_found_together(spark):
    rng = random.Random(3)
    start, rows = dt.datetime(2026, 4, 1), []
    for name, high in (("shifted", 9.0), ("quiet", 0.0)):
        for g in range(80):
            x = rng.gauss(0, 0.3) + (high if g >= 68 else 0.0)
            rows.append((name, g, start + dt.timedelta(hours=6 * g), None if g % 11 == 5 else x))
    grid = spark.createDataFrame(rows, "event_type string, g long, grid_ts timestamp, value double")
    clusters = {(r.event_type, r.start, r.end, r.length) for r in series.outlier_clusters(grid).collect()}
    there = [r for r in rows if r[0] == "shifted" and r[1] >= 68 and r[3] is not None]
    assert ("shifted", there[0][2], there[-1][2], len(there)) in clusters
    found = series.changes_near_clusters(grid).where("event_type = 'shifted'").collect()
    assert any(abs(r.change_idx - 67) <= 1 and r.near and r.near.endswith(f"(len {len(there)})") for r in found)
    for r in series.changes_near_clusters(grid).collect():
        near = [c for c in clusters if c[0] == r.event_type and c[1] - dt.timedelta(hours=12) <= r.grid_ts <= c[2] + dt.timedelta(hours=12)]
        assert (r.near is None) == (not near)


def test_intervals_of_other_series_and_null_keys_do_not_count(spark):
    at = lambda h: dt.datetime(2026, 4, 1) + dt.timedelta(hours=h)
    points = spark.createDataFrame([("a", 1, at(10)), ("a", 2, at(40)), ("b", 3, at(10)), (None, 4, at(10))], "event_type string, id long, grid_ts timestamp")
    runs = spark.createDataFrame([("a", at(20), at(21), "late"), ("a", at(0), at(1), "first"), (None, at(10), at(10), "none")], "event_type string, start timestamp, end timestamp, cluster string")
    got = {r.id: r.near for r in series.near_clusters(points, "id", runs).collect()}
    assert got == {1: "first", 2: None, 3: None, 4: None}


def test_flags_of_metrics_count_as_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, -1.0, 0.0, 0.5, 2.0]), float(rng.randrange(40, 60)), i * 1.0 if i % 7 else None) for i in range(200)]
    rows = [(s, n, None if n is None or t is None else n * 2 + rng.random()) for s, n, t in rows]
    df = spark.createDataFrame(rows, "share double, n double, twice double").withColumn("metric", F.lit("clash"))
    got = {r.metric: r for r in quality.metric_flags(df, ["share", "n", "twice"], shares=["share"], counts=["n"], companions=["n"]).collect()}
    column = {m: [r[i] for r in rows] for i, m in enumerate(("share", "n", "twice"))}
    for m, xs in column.items():
        there = [x for x in xs if x is not None]
        pairs = np.array([(x, n) for x, n in zip(xs, column["n"]) if x is not None])
        r = np.corrcoef(pairs.T)[0, 1]
        assert got[m].r_with_n == pytest.approx(r) and got[m].depends_on_n == bool(abs(r) > 0.5)
        assert got[m].n_zero == there.count(0.0) and got[m].share_at_max == pytest.approx(there.count(max(there)) / len(there))
        assert got[m].n_few == (sum(x < 50 for x in there) if m == "n" else 0)
        assert got[m].n_outside_unit == (sum(not 0 <= x <= 1 for x in there) if m == "share" else 0)
    assert got["share"].n_negative == 0 and got["twice"].depends_on_n
    empty = quality.metric_flags(df.where("n < 0"), ["share"], shares=["share"], companions=["n"])
    assert empty.count() == 0


def test_spread_is_the_same_under_every_relabeling(spark):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(30, 3, 4)) * [[1.0], [2.0], [5.0]]
    df = spark.createDataFrame([(i, *[v.tolist() for v in row]) for i, row in enumerate(table)], "id int, a array<double>, b array<double>, c array<double>")
    got = {r.perm: r.spread for r in vectors.label_spread(vectors.relabelings(df, ["a", "b", "c"]), "perm", ["a", "b", "c"]).collect()}
    for i, order in enumerate(permutations(range(3))):
        parts = [table[:, p] for p in order]
        assert got[i] == pytest.approx(np.mean([np.linalg.norm(x - x.mean(axis=0), axis=1).mean() for x in parts]))
