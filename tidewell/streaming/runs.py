"""Runs of flagged rows on a stream, as ``operators.ordered.runs`` finds them in a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FOUND = ["start_us", "end_us", "length", "gap_us"]


class RunProcessor(StatefulProcessor):
    """Holds back a series' rows until the watermark passes them, then follows them in order; its state is the open run."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, tie long, flag boolean")
        self.open = handle.getValueState("open", "start_us long, end_us long, length long, gap_us long")
        self.released = handle.getValueState("released", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.released.get()[0] if self.released.exists() else None
        first = None
        for frame in rows:
            frame = frame.set_axis([self.key, "ts", "us", "tie", "flag"], axis=1)  # names of computed columns do not reach here
            there = frame if done is None else frame[frame["us"] > done]
            if len(there):
                self.pending.appendList([(int(u), int(t), bool(f)) for u, t, f in zip(there["us"], there["tie"], there["flag"], strict=True)])
                least = int(there["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((u, t, f) for u, t, f in self.pending.get()) if self.pending.exists() else []
        due, later = [r for r in waiting if r[0] <= mark], [r for r in waiting if r[0] > mark]
        run = tuple(self.open.get()) if self.open.exists() else None
        found = []
        for us, _, flag in due:
            if not flag:
                if run is not None:
                    found.append(run)
                run = None
            elif run is None:
                run = (us, us, 1, -1)
            else:
                run = (run[0], us, run[2] + 1, max(run[3], us - run[1]))
        if run is None:
            self.open.clear()
        else:
            self.open.update(run)
        self.pending.clear()
        if later:
            self.pending.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        self.released.update((mark,))
        if found:
            yield pd.DataFrame(found, columns=FOUND).assign(**{self.key: key[0]})[[self.key, *FOUND]]

    def close(self) -> None:
        pass


def flagged_runs(df: DataFrame, key: str, ts: str, tie: str, flag: Column, late: str) -> DataFrame:
    """A row for each run of neighbouring flagged rows of a series, once an unflagged row behind it has passed the watermark.

    Rows may come in any order within ``late``; equal times are ordered by ``tie``, a whole number (null: 0). Later ones are left out, as are
    rows without a time; a null flag is no flag. A run that nothing ends stays open. The state of a series is one open run and the rows not
    older than ``late``. Needs the RocksDB state store.
    """
    rows = df.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(
        key, ts, F.unix_micros(F.col(ts)).alias("us"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.coalesce(flag, F.lit(False)).alias("flag")
    )
    schema = f"{key} {df.schema[key].dataType.simpleString()}, start_us long, end_us long, length long, gap_us long"
    found = rows.groupBy(key).transformWithStateInPandas(RunProcessor(key), schema, "Append", "EventTime")
    gap = F.when(F.col("gap_us") >= 0, F.col("gap_us") / 1e6)
    return found.select(key, "length", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), gap.alias("largest_gap_s"))
