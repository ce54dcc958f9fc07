"""Runs found on a stream of shuffled micro-batches are those of the whole table."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewell.operators import ordered
from tidewell.streaming.runs import flagged_runs

START = dt.datetime(2026, 4, 1)
SCHEMA = "k string, ts timestamp, id long, f boolean"


def streamed(spark, folder, batches, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        found = flagged_runs(stream, "k", "ts", "id", F.col("f"), "2 hours")
        query = found.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.unset(provider)
    return plain(spark.table(name))


def plain(runs):
    return sorted(map(tuple, runs.select("k", "start", "end", "length", F.round("largest_gap_s", 5)).collect()), key=str)


def test_shuffled_micro_batches_give_the_runs_of_the_table(spark, tmp_path):
    rng = random.Random(7)
    minutes = sorted(rng.choices(range(600), k=120))
    rows = [(rng.choice("abc"), START + dt.timedelta(minutes=m, microseconds=rng.randrange(3)), i, rng.choice([True, True, True, False, None])) for i, m in enumerate(minutes)]
    ends = [(k, START + dt.timedelta(hours=11), 1000 + i, False) for i, k in enumerate("abc")]
    batches = []
    for at in range(0, 120, 30):
        part = rows[at : at + 30]
        rng.shuffle(part)
        batches.append(part)
    held = batches[0].pop()  # comes a batch later than its like, within two hours of the watermark or not
    in_time = held[1] > max(r[1] for r in batches[0]) - dt.timedelta(hours=2)
    batches[1].append(held)
    batches += [ends, [("z", START + dt.timedelta(days=2), 2000, False)]]
    table = spark.createDataFrame([r for r in [*rows, *ends] if in_time or r != held], SCHEMA)
    want = plain(ordered.runs(table, ["k"], ["ts", "id"], F.col("f")))
    got = streamed(spark, tmp_path / "in", batches, "stream_runs")
    assert got == want and len(got) > 10


def test_rows_behind_the_watermark_and_open_runs_give_nothing(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [("a", at(1), 0, True), ("a", at(2), 1, True), ("a", at(3), 2, False), ("z", at(24), 3, False)],
        [("a", at(2), 4, False), ("a", None, 5, True), ("z", at(48), 6, False)],
        [("a", at(49), 7, True), ("z", at(72), 8, False)],
    ]
    got = streamed(spark, tmp_path / "in", batches, "late_runs")
    assert got == [("a", at(1), at(2), 2, 3600.0)]
