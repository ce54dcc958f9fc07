from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import stats, tails
from tidewell.operators import compare, ingest, joins, lags, lexical, memory, ordered, states, vectors
from tidewell.sources import logs, readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nan_and_text_become_null(spark):
    df = frame(spark, [("1.5",), ("x",), ("NaN",), (None,)], "v string").select(ingest.numeric(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == [1.5, None, None, None]


def test_timestamps_with_suffix_offset_and_noise(spark):
    df = frame(spark, [("2026-04-01 10:00:00 UTC",), ("2026-04-01T12:00:00+02:00",), ("soon",)], "t string")
    got = [r.t for r in df.select(ingest.utc_timestamp(F.col("t")).alias("t")).collect()]
    assert got[0] == got[1] and got[2] is None


def test_window_is_half_open(spark):
    df = frame(spark, [(dt.datetime(2026, 4, 1),), (dt.datetime(2026, 5, 1),), (None,)], "ts timestamp")
    assert ingest.in_window(df, "ts", "2026-04-01", "2026-05-01").count() == 1
    assert ingest.window_counts(df, "ts", "2026-04-01", "2026-05-01").first().asDict() == {
        "n_rows": 3, "n_before": 0, "n_in": 1, "n_after": 1, "n_without_time": 1,
    }


def test_correlation_of_a_constant_is_null(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert df.agg(stats.safe_corr(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_nearest_ties_and_tolerance(spark):
    left = frame(spark, [(1, 1000.0), (2, 5000.0), (3, 9000.0)], "id long, s double")
    right = frame(spark, [(10, 990.0), (11, 1010.0), (12, 5300.0), (13, 9301.0)], "rid long, t double")
    got = {r.id: r.rid for r in joins.nearest(left, right, F.col("s"), F.col("t"), "rid", 300).collect()}
    assert got == {1: 10, 2: 12, 3: None}


def test_gap_of_exactly_the_limit_does_not_split(spark):
    t0 = dt.datetime(2026, 4, 1)
    times = [t0, t0 + dt.timedelta(hours=12), t0 + dt.timedelta(hours=24, seconds=1)]
    df = frame(spark, [("a", t, 1.0) for t in times], "k string, ts timestamp, v double")
    assert [r.block for r in ordered.gap_blocks(df, ["k"], ["ts"], 12).orderBy("ts").collect()] == [0, 0, 1]


def test_runs_break_at_null_flags(spark):
    df = frame(spark, [("a", i, f) for i, f in enumerate([True, True, None, True, False, True])], "k string, i long, f boolean")
    got = sorted(r.length for r in ordered.runs(df, ["k"], ["i"], F.col("f")).collect())
    assert got == [1, 1, 2]


def test_neighbours_and_sums_across_buckets(spark):
    size = ordered.BUCKET
    places = [0, 1, size - 1, size, size + 3, 3 * size, 3 * size + 1, 9 * size]
    df = frame(spark, [(k, i) for k in ("a", None) for i in places], "k string, i long")
    for key in ("a", None):
        rows = ordered.neighbour(df, ["k"], ["i"], ["i"], "next").where(F.col("k").eqNullSafe(key)).orderBy("i").collect()
        assert [r.next and r.next.i for r in rows] == [*places[1:], None]
        back = ordered.neighbour(df, ["k"], ["i"], ["i"], "before", back=True).where(F.col("k").eqNullSafe(key)).orderBy("i").collect()
        assert [r.before and r.before.i for r in back] == [None, *places[:-1]]
        assert [r.idx for r in ordered.with_index(df, ["k"], ["i"]).where(F.col("k").eqNullSafe(key)).orderBy("i").collect()] == list(range(len(places)))


def test_rolling_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", 8)
    values = [float(x * x % 17) if x % 5 else None for x in range(40)]
    df = frame(spark, [("a", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    got = [r.roll_mean for r in ordered.rolling(df, ["k"], ["i"], "v", 4, 2).orderBy("i").collect()]
    for i, mean in enumerate(got):
        seen = [v for v in values[max(0, i - 3) : i + 1] if v is not None]
        assert mean == pytest.approx(sum(seen) / len(seen)) if len(seen) >= 2 else mean is None


def test_nearest_without_tolerance_crosses_empty_buckets(spark):
    left = frame(spark, [(1, 0.0), (2, 500_000.0), (3, 900_000.0), (4, None)], "id long, s double")
    right = frame(spark, [(9, 450_000.0), (8, 450_000.0), (7, 550_000.0)], "rid long, t double")
    got = {r.id: (r.rid, r.delta_s) for r in joins.nearest(left, right, F.col("s"), F.col("t"), "rid").collect()}
    assert got == {1: (8, 450_000.0), 2: (8, 50_000.0), 3: (7, 350_000.0), 4: (None, None)}


def test_points_with_null_columns_meet_intervals(spark):
    points = frame(spark, [(1, 10.0, None), (1, 10.0, None), (2, 900.0, "x")], "id long, s double, note string")
    events = frame(spark, [(5, 12.0)], "eid long, t double")
    got = sorted((r.id, r.eid or 0) for r in joins.within_interval(points, events, F.col("s"), F.col("t"), 60).collect())
    assert got == [(1, 5), (1, 5), (2, 0)]


def test_result_tables_with_null_keys_and_missing_rows(spark):
    old = frame(spark, [(None, 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    new = frame(spark, [(None, 1.0 + 1e-12), ("c", 2.0), ("b", None)], "k string, v double")
    got = {r.k: (r.found_in, r.agrees) for r in compare.compare_tables(old, new, ["k"], ["v"]).collect()}
    assert got == {None: ("both", True), "a": ("old", False), "b": ("both", True), "c": ("new", False)}


def test_trends_of_vectors_are_taken_out(spark):
    rows = [("a", float(t), [2.0 * t + 1, 5.0, -float(t)]) for t in range(6)] + [("b", 1.0, [3.0, 4.0, 5.0])]
    df = frame(spark, rows, "k string, t double, v array<double>")
    for r in states.detrended_vectors(df, ["k"], "t", "v").collect():
        assert r.detrended == pytest.approx([0, 0, 0], abs=1e-9)


def test_false_discovery_rates_by_hand(spark):
    df = frame(spark, [("f", p) for p in (0.01, 0.02, 0.02, 0.5, None)], "k string, p double")
    got = [r.q for r in compare.benjamini_hochberg(df, ["k"], "p").orderBy(F.col("p").asc_nulls_last()).collect()]
    assert got[:4] == pytest.approx([0.02 * 4 / 2, 0.02 * 4 / 2, 0.02 * 4 / 2, 0.5]) and got[4] is None


def test_rank_test_against_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, 30), rng.integers(1, 7, 25)
    df = frame(spark, [("k", True, float(x)) for x in a] + [("k", False, float(x)) for x in b], "k string, s boolean, v double")
    got = compare.mann_whitney(df, ["k"], F.col("s"), "v").first()
    assert got.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and 0 < got.p < 1


def test_tails():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.chi_square(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    assert tails.binomial_at_least(3, 3, 0.5) == pytest.approx(0.125)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_fits_find_planted_values():
    t = np.arange(1, 17) * 6.0
    assert tails.fit_exponential(t, np.exp(-t / 30))[0] == pytest.approx(30, rel=1e-4)
    a, tau, c, r2 = tails.fit_decay_to_floor(t, 0.6 * np.exp(-t / 20) + 0.2)
    assert (a, tau, c, r2) == pytest.approx((0.6, 20, 0.2, 1), rel=1e-3)


def test_change_point_of_a_shift():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(4, 1, 60)])
    breaks = memory.best_breaks(x, 3, 20)[0]
    assert any(abs(b - 60) <= 2 for b in breaks)


def test_refits_find_the_replicates_times(spark):
    rows = [("a", rep, [math.exp(-k * 6.0 / tau) for k in range(1, 17)]) for rep, tau in enumerate((12.0, 30.0, 60.0))] + [("a", 3, [0.5] + [None] * 15)]
    got = {r.rep: r.tau for r in lags.with_fits(frame(spark, rows, "s string, rep long, rho array<double>"), list(range(1, 17)), 6.0).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([12, 30, 60], rel=1e-3) and got[3] is None
    rng, t = np.random.default_rng(2), np.arange(1, 17) * 6.0
    y = np.stack([0.6 * np.exp(-t / tau) + c + rng.normal(0, 0.02, 16) for tau, c in ((20, 0.2), (40, -0.1), (9, 0.0))])
    tau, floor = tails.fit_decays_to_floor(t, y)
    for i in range(3):
        _, one, c, _ = tails.fit_decay_to_floor(t, y[i])
        assert (tau[i], floor[i]) == pytest.approx((one, c), rel=1e-3, abs=1e-3)
        assert tails.fit_exponentials(t, y)[i] == pytest.approx(tails.fit_exponential(t, y[i])[0], rel=1e-3)


def test_distances_of_token_maps(spark):
    df = frame(spark, [({"a": 1.0}, {"b": 1.0}), ({"a": 1.0}, {"a": 2.0}), ({}, {"a": 1.0})], "a map<string,double>, b map<string,double>")
    got = df.select(lexical.js_distance(F.col("a"), F.col("b")).alias("js"), lexical.cosine_counts(F.col("a"), F.col("b")).alias("c")).collect()
    assert (got[0].js, got[0].c) == (1, 1) and got[1].js == pytest.approx(0) and got[2].c is None


def test_rarefaction_is_the_same_in_any_partitioning(spark):
    maps = frame(spark, [(i, {"a": 50.0, "b": 50.0 + i}) for i in range(6)] + [(9, {"a": 3.0})], "id long, tokens map<string,double>")
    a = lexical.rarefied_entropy(maps.repartition(3), "id", 60).toPandas().sort_values("id")
    b = lexical.rarefied_entropy(maps.coalesce(1), "id", 60).toPandas().sort_values("id")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
    assert math.isnan(a.mean_entropy.iloc[-1])


def test_invalid_vectors_are_null(spark):
    df = frame(spark, [([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r.v for r in df.select(vectors.as_doubles(F.col("v"), 2).alias("v")).collect()] == [[1.0, 2.0], None, None, None]


def test_cosine_of_a_zero_vector_is_null(spark):
    df = frame(spark, [([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(stats.cosine_distance(F.col("a"), F.col("b")).alias("d")).first().d is None


def test_log_blocks_positions_and_reasons(spark):
    text = (
        "preamble\n## BASELINE-SHUFFLE obs :: 2026-04-01 10:00:00 UTC\n**metrics:** first run H(t)= 3.5 phi(t)= 0.5 D(t)= 0.1\n"
        "surface-mid real=0.5 | shuffle=0.25 | delta=0.25\n**metrics:** H(t)= 4 phi(t)= 0.1 D(t)= 0.2\n"
    )
    rows = logs.blocks(logs.lines(frame(spark, [("f", text)], "f string, t string"), "f", "t"), "f")
    one = logs.comparisons(rows, "f").first()
    assert (one.pair, one.real, one.shuffle, one.delta) == ("surface-mid", 0.5, 0.25, 0.25)
    kept = logs.quarantined_metrics(rows, "f").orderBy("line_no").collect()
    assert [(r.position, r.reason) for r in kept] == [("before", "first_run"), ("after", "carried")]
    assert logs.anomalies(logs.quarantined_metrics(rows, "f")).count() == 1
    assert logs.wide(logs.comparisons(rows, "f"), "f", ["surface-mid", "mid-residue"]).first()["surface-mid"] == 0.25


def test_log_numbers_and_values_apart(spark):
    text = "## BASELINE-SHUFFLE obs :: 2026-04-01 10:00:00 UTC\nsurface-mid real=4e-05 | shuffle=.5 | delta=-1E-05\n**metrics:** H(t) = N/A phi(t)= 1e-2\n**metrics:** H(t)=2.5 phi N/A\n"
    rows = logs.blocks(logs.lines(frame(spark, [("f", text)], "f string, t string"), "f", "t"), "f")
    one = logs.comparisons(rows, "f").first()
    assert (one.real, one.shuffle, one.delta) == (4e-05, 0.5, -1e-05)
    kept = logs.quarantined_metrics(rows, "f").orderBy("line_no").collect()
    assert [(r.reason, r.h_raw, r.phi_raw, r.d_raw, r.position) for r in kept] == [("not_available", None, 0.01, None, "after"), ("carried", 2.5, None, None, "after")]


def test_observation_entries(spark):
    text = "## obs :: 2026-04-01 10:00 UTC\n**surface mood:** calm\n## obs :: 2026-04-01 16:00 UTC\n**anomaly flag:** yes\n"
    got = logs.observation_entries(frame(spark, [("f", text)], "f string, t string"), "f", "t").orderBy("entry").collect()
    assert [(r.mood, r.flag) for r in got] == [("calm", None), (None, "yes")]


def test_json_columns(spark):
    df = frame(spark, [("[1,2]", '{"a":[1],"b":[0]}', '{"x":2,"__total__":2}'), ("[1", '{"a":[1],"b":[2]}', "no")], "v string, l string, t string")
    got = df.select(readers.parse_vector(F.col("v")).alias("v"), readers.parse_layers(F.col("l"), ["a", "b"]).alias("l"), readers.parse_tokens(F.col("t")).alias("t")).collect()
    assert got[0].v == [1, 2] and got[1].v is None and got[0].l is None and got[1].l.b == [2] and got[0].t == {"x": 2}


def test_observation_file_with_mark_and_comment(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("﻿H_t,Timestamp_UTC\n# note\n1.5,2026-04-01 10:00:00 UTC\n,bad\n", encoding="utf-8")
    got = readers.read_observations(spark, str(path), ["H_t"]).collect()
    assert [r.H_t for r in got] == [1.5, None] and got[1].ts is None


def test_permutation_keeps_content(spark):
    df = frame(spark, [("a", i, i * 10) for i in range(20)], "k string, i long, v long")
    got = vectors.permuted(df, ["k"], "i", ["v"], 3, 7).toPandas()
    for _, part in got.groupby("rep"):
        assert sorted(part.v) == [i * 10 for i in range(20)] and list(part.sort_values("i").v) != sorted(part.v)


def test_same_session_gaps_in_a_stream(spark, tmp_path):
    from tidewell.streaming import windows

    frame(spark, [("a", dt.datetime(2026, 4, 1, h), float(h)) for h in (0, 6, 20)], "k string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    query = windows.gap_sessions(stream, "k", "ts", "v", "12 hours", "1 day").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_quantiles_and_ranks_over_bands_of_values_equal_plain_ones(spark):
    values = [None, 0.0, -0.0, -3.5, 1e-9, 1e300, 7.25, 7.25, 7.26, -1e-300, 100.0, 100.0, 100.0, 3.0, -250.0]
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("empty", None)], "k string, v double")
    shares = {"low": 0.1, "mid": 0.5, "high": 0.9, "top": 1.0}
    found = {r.k: r for r in ordered.quantiles(rows, ["k"], "v", shares).collect()}
    there = [v for v in values if v is not None]
    assert set(found) == {"a", None}
    for r in found.values():
        assert r.n_values == len(there)
        assert [r[n] for n in shares] == pytest.approx(list(np.quantile(there, list(shares.values()))))
    ranks = sorted((r.v, r.avg_rank) for r in ordered.average_rank(rows.where("k = 'a' AND v IS NOT NULL"), ["k"], "v").collect())
    assert [x for _, x in ranks] == [(2 * sum(w < v for w in there) + sum(w == v for w in there) + 1) / 2 for v, _ in ranks]
    bands = spark.createDataFrame([(v,) for v in [float("-inf"), -5.0, -1e-320, 0.0, 5e-324, 2.0, 1e308, float("inf"), float("nan")]], "v double")
    placed = [r.b for r in bands.select(ordered.bucket_of(bands, "v").alias("b")).collect()]
    assert placed == sorted(placed)


def test_permuted_rows_keep_their_key_and_all_contents(spark):
    rows = spark.range(50).selectExpr("id % 2 AS k", "id", "id * 10 AS x")
    found = vectors.permuted(rows, ["k"], "id", ["x"], 3, 7).collect()
    assert len(found) == 150 and all(r.x // 10 % 2 == r.k for r in found)
    for rep in (1, 2, 3):
        assert sorted(r.x for r in found if r.rep == rep) == [10 * i for i in range(50)]
        assert any(r.x != 10 * r.id for r in found if r.rep == rep)


def test_correlation_p_is_null_where_undefined(spark):
    matrix = spark.createDataFrame([(10, 0.5), (2, 0.5), (10, 1.0), (10, None)], "n long, r double")
    got = [(r.t, r.p) for r in compare.correlation_p(matrix).collect()]
    assert got[0] == (pytest.approx(1.632993), pytest.approx(0.141111, abs=1e-5)) and got[1:] == [(None, None)] * 3


def test_status_states_and_a_file_that_is_not_there(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "done": true,\n "n": 3\n}\n')
    (tmp_path / "s.csv").write_text('# note\nTimestamp_UTC,vector,other\n2026-04-01 10:00:00,"[1.0, 2.5]",x\n2026-04-01 11:00:00,"[1.0, null]",y\n')
    (tmp_path / "o.csv").write_text("Timestamp_UTC,H\n2026-04-01 10:00:00,1.5\n2026-04-01 11:00:00,none\n")
    got = readers.read_status(spark, str(tmp_path / "a.json"), "done boolean, n long, note string").collect()
    assert [tuple(r) for r in got] == [(True, 3, None)]
    states_ = readers.read_states(spark, str(tmp_path / "s.csv"), ["vector"]).select("ts", readers.parse_vector(F.col("vector"), 2).alias("v"))
    assert states_.columns == ["ts", "v"] and [r.v for r in states_.orderBy("ts").collect()] == [[1.0, 2.5], None]
    with pytest.warns(UserWarning, match="is not there"):
        found = readers.read_observations(spark, str(tmp_path / "gone.csv"), ["H"], ["time", "Timestamp_UTC"], str(tmp_path / "o.csv"))
    assert sorted((r.H for r in found.collect()), key=str) == [1.5, None]
    with pytest.raises(Exception, match="gone"):
        readers.read_observations(spark, str(tmp_path / "gone.csv"), ["H"])


def test_observed_values_against_a_null(spark):
    rng = np.random.default_rng(0)
    rows = [("a", True, float(x)) for x in rng.normal(0, 0.5, 60)] + [("a", False, float(x)) for x in rng.normal(0.4, 1, 300)] + [("b", True, 1.0), ("b", None, 2.0), ("b", False, None)]
    got = {r.k: r for r in compare.against_null(spark.createDataFrame(rows, "k string, o boolean, v double"), ["k"], F.col("o"), "v").collect()}
    obs, null = (np.array([v for k, o, v in rows if k == "a" and o is side]) for side in (True, False))
    assert (got["a"].n_obs, got["a"].n_null, got["a"].std_ratio) == (60, 300, pytest.approx(obs.std() / null.std()))
    both = np.sort(np.concatenate([obs, null]))
    assert got["a"].d == pytest.approx(max(abs((obs <= x).mean() - (null <= x).mean()) for x in both))
    assert got["a"].tighter and got["a"].displaced and got["a"].p < 0.05
    assert (got["b"].n_obs, got["b"].n_null, got["b"].tighter) == (1, 0, None)


def test_rarefaction_to_the_least_total(spark):
    maps = spark.createDataFrame([(1, {"a": 5.0, "b": 5.0}), (2, {"a": 4.0})], "doc_id long, tokens map<string,double>")
    got = {r.doc_id: r for r in lexical.rarefied_entropy(maps, "doc_id").collect()}
    assert got[2].mean_entropy == 0 and 0.6 < got[1].mean_entropy <= 1
    assert lexical.rarefied_entropy(maps.where("false"), "doc_id").count() == 0
