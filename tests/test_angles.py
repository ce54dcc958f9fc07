"""Nulls of angles by sums of tasks' parts against the angles themselves, with blocks and tasks of a few rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import angles, compare, vectors

NAMES = ["s", "m", "r"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(3 * i, *[np.round(rng.normal(size=4), 1).tolist() for _ in NAMES]) for i in range(23)]
    rows[5] = (15, [0.0] * 4, *rows[5][2:])
    rows[7] = (21, *rows[6][1:])
    return spark.createDataFrame(rows, "block long, s array<double>, m array<double>, r array<double>")


def permuted_angles(table, reps, seed):
    drawn = table.withColumn("one", F.lit(1))
    first, *others = [vectors.permuted(drawn.select("one", "block", x), ["one"], "block", [x], reps, seed + k).drop("one") for k, x in enumerate(NAMES)]
    for other in others:
        first = first.join(other, ["rep", "block"])
    return vectors.pair_distances(first, [], NAMES)


@pytest.mark.parametrize(("rows", "pairs"), [(1 << 15, 300_000), (5, 20)])
def test_sums_of_parts_say_what_all_angles_say(table, monkeypatch, rows, pairs):
    monkeypatch.setattr(angles, "ROWS", rows)
    monkeypatch.setattr(angles, "PAIRS", pairs)
    seen, sums = angles.angle_sums(table, "block", NAMES, 9, 42)
    found = {(r.null, r.pair): r for r in compare.against_null_sums(seen, sums, "null", ["pair"], "angle").collect()}
    both = vectors.pair_distances(table, [], NAMES).select("pair", "angle", F.lit(True).alias("o")).unionByName(permuted_angles(table, 9, 42).select("pair", "angle", F.lit(False).alias("o")))
    want = compare.against_null(both.withColumn("pair", F.explode(F.array("pair", F.lit("all")))), ["pair"], F.col("o"), "angle").collect()
    assert len(found) == 8 and len(want) == 4
    for r in want:
        own = found["permuted", r.pair].asDict()
        assert own.pop("null") == "permuted" and own == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in r.asDict().items()}
    for name in ("s-m", "s-r", "m-r", "all"):
        r = found["gaussian", name]
        assert r.n_null == 9 * r.n_obs and abs(r.mean_null - np.pi / 2) < 0.25 and 0.4 < r.std_null < 0.8  # one row has no length


def test_normal_draws_do_not_depend_on_blocks_or_tasks(table, monkeypatch):
    seen = []
    for rows, pairs in ((1 << 15, 300_000), (4, 9)):
        monkeypatch.setattr(angles, "ROWS", rows)
        monkeypatch.setattr(angles, "PAIRS", pairs)
        _, sums = angles.angle_sums(table, "block", NAMES, 9, 42)
        seen.append({r.pair: r.x for r in sums.where("null = 'gaussian'").groupBy("pair").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("x")).collect()})
    assert seen[0].keys() == seen[1].keys() and all(seen[0][k] == pytest.approx(seen[1][k], abs=1e-12) for k in seen[0])


def test_no_null_angle_is_a_row(table):
    _, sums = angles.angle_sums(table, "block", NAMES, 200, 42)
    n, rows = sums.agg(F.sum("n"), F.sum(F.size("values"))).first()
    assert n > 20_000 and rows < 1_000  # three pairs and all of them, each twice the observed angles at most
