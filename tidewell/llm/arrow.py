"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def arrays(parts: list[np.ndarray], kind: type) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*parts, np.array([], kind)]).astype(kind)))


def sorted_runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """The runs of equal keys (column number ``key``) of a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and values[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """A sorted partition in tables of many whole runs of equal keys: what is last waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = np.asarray(batch.column(key))
        if not len(values):
            continue
        cut = int(np.searchsorted(values, values[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != values[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
