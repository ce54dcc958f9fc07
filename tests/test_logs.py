"""Log files cut in records over many tasks, against whole texts; order statistics against loops over the labelings."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import vectors
from tidewell.sources import logs


@pytest.fixture
def split_log(spark, tmp_path):
    """One file of some 400 kB, read in splits of 16 kB."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "16k")
    yield tmp_path / "log.md"
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_one_file_over_many_tasks(spark, split_log):
    body = ["preamble é"]
    for k in range(1500):
        body.append(f"## BASELINE-SHUFFLE obs :: 2026-04-{k % 28 + 1:02d} 10:00:{k % 60:02d} UTC\r" if k % 3 == 0 else "prose " * (k % 40))
        body += [f"surface-mid real=0.{k} | shuffle=.5 | delta=-1E-05", "", f"**metrics:** awaiting H(t)= {k}.5"]
    split_log.write_bytes("\n".join(body).encode())
    rows = logs.read_lines(spark, str(split_log))
    assert spark.read.text(str(split_log)).rdd.getNumPartitions() > 8
    whole = logs.lines(spark.createDataFrame([("f", "\n".join(body))], "file string, text string"), "file", "text")
    for step in (lambda x: x, lambda x: logs.blocks(x, "file"), lambda x: logs.comparisons(logs.blocks(x, "file"), "file"), lambda x: logs.quarantined_metrics(logs.blocks(x, "file"), "file")):
        got, want = (step(x).drop("file").orderBy("line_no").toPandas() for x in (rows, whole))
        assert len(got) > 1000 and got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_entries_of_one_file_over_many_tasks(spark, split_log):
    entries = [f"2026-04-{k % 28 + 1:02d} 10:{k % 60:02d}{' UTC' if k % 5 else ''}\n**surface mood:** calm {k}\n{'x' * (k % 300)}\n**anomaly flag:** yes{k}, as said" for k in range(1000)]
    text = "about\n## obs :: " + "\n## obs :: ".join(entries)
    split_log.write_text(text, newline="")
    got = logs.read_entries(spark, str(split_log)).orderBy("entry").collect()
    want = [(k + 1, f"calm {k}", f"yes{k}") for k in range(1000) if k % 5]
    assert [(r.entry, r.mood, r.flag) for r in got] == want
    raw = text.encode()
    assert all(raw[r.offset :].startswith(f"2026-04-{(r.entry - 1) % 28 + 1:02d} 10:".encode()) for r in got)
    rows = logs.observation_entries(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t").orderBy("entry").collect()
    assert [(r.entry, r.ts, r.mood, r.flag) for r in rows] == [(r.entry, r.ts, r.mood, r.flag) for r in got]


def test_entries_need_utc_and_an_entry_may_open_the_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("## obs :: 2026-04-01 10:00 UTC\n**anomaly flag:** élan vital\n## obs :: 2026-04-01 11:00\n**anomaly flag:** no")
    (tmp_path / "b.md").write_text("")
    got = logs.read_entries(spark, str(tmp_path)).collect()
    assert [(r.entry, r.offset, r.mood, r.flag) for r in got] == [(0, 0, None, "élan")]


def test_order_statistics_under_all_labelings(spark):
    rng = np.random.default_rng(4)
    d = rng.random((40, 3))
    rows = [(*map(float, r),) for r in d] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.statistic: r for r in vectors.order_statistics(df, F.col("a"), F.col("b"), F.col("c")).collect()}
    pair = {frozenset((0, 1)): d[:, 0], frozenset((1, 2)): d[:, 1], frozenset((0, 2)): d[:, 2]}
    seen = []
    for p in permutations(range(3)):
        a, b, c = (pair[frozenset(x)] for x in ((p[0], p[1]), (p[1], p[2]), (p[0], p[2])))
        seen.append([np.mean(a < b), np.mean((c > a) & (c > b)), np.mean((a < b) & (b < c)), np.mean(a / b), np.mean(c / a)])
    seen = np.array(seen)
    for j, name in enumerate(["first_lt_second", "outer_largest", "all_in_order", "first_to_second", "outer_to_first"]):
        r, null = got[name], seen[1:, j]
        assert (r.n, r.observed, r.null_mean, r.null_std) == (40, pytest.approx(seen[0, j]), pytest.approx(null.mean()), pytest.approx(null.std(ddof=1)))
        far = np.round(np.abs(np.append(null, seen[0, j]) - null.mean()), 12)
        assert r.tail == (pytest.approx(np.mean(far[:-1] >= far[-1])) if j < 3 else None)
    assert vectors.order_statistics(df.where("false"), F.col("a"), F.col("b"), F.col("c")).count() == 0
