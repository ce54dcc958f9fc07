"""Mean lexical drift along a series, in its own order and in many shuffled ones.

A shuffled order makes nearly every row the neighbour of any other one, so rows don't travel to their pairs. They are stored once,
in blocks of some megabytes with a vocabulary each. An order is a list of row numbers; its pairs, eight bytes each, are dealt to the
tiles of two blocks, and a tile's task reads its two blocks from the shared folder. What goes over the network and to disk are the rows,
twice, and the pairs; memory is that of two blocks.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.lags import key_types
from tidewell.operators.lexical import TOTAL_KEY
from tidewell.operators.ordered import running_sums
from tidewell.sources.shared import kept, opened, shared_dir

#: Distinct tokens of all rows of a block, and pairs of a tile that a task takes.
ENTRIES, PAIRS = 1 << 22, 300_000
SPACE = re.compile("[ \t\n\x0b\f\r]+")


def counted_words(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Distinct tokens of each text, joined by blanks, and their counts, as ``lexical.token_map`` takes them; texts without words are left out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for t in frame.pop("_t"):
                n = Counter(SPACE.split(t))
                n.pop("", None), n.pop(TOTAL_KEY, None)
                found.append((" ".join(n), np.fromiter(n.values(), "<i4").tobytes(), len(n)))
            frame[["_words", "_counts", "_size"]] = pd.DataFrame(found, columns=["_words", "_counts", "_size"], index=frame.index)
            yield frame

    rows = df.where(F.col(text).rlike(r"\S")).na.drop(subset=keys).select(*keys, order, F.lower(text).alias("_t"))
    return rows.mapInPandas(count, f"{key_types(rows, [*keys, order])}_words string, _counts binary, _size long")


def blocks(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Blocks of rows in the order of their series: (keys, first, rows, file), ``first`` the number of the first row and ``file`` where the block is."""
    rows = running_sums(words, keys, [order], {"_i": F.lit(1).cast("long"), "_n": F.col("_size")})
    rows = rows.select(*keys, (F.col("_i") - 1).alias("_i"), F.floor((F.col("_n") - F.col("_size")) / ENTRIES).alias("_block"), "_words", "_counts", "_size")

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_i")
        tokens = pc.split_pattern(pa.array(frame["_words"], pa.large_string()), " ").flatten()
        coded = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        by_use = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")  # common tokens side by side
        place = np.empty(len(names), "<i4")
        place[by_use] = np.arange(len(names))
        starts = np.concatenate([[0], np.cumsum(frame["_size"])]).astype("<i8")
        out = [int(frame["_i"].iloc[0]), len(frame), "\n".join(names.take(pa.array(by_use)).to_pylist()), starts.tobytes(), place[codes].tobytes(), b"".join(frame["_counts"])]
        return pd.DataFrame([[*frame[keys].iloc[0], *out]], columns=[*keys, "first", "rows", "names", "starts", "codes", "counts"])

    schema = f"{key_types(rows, keys)}first long, rows long, names string, starts binary, codes binary, counts binary"
    path = f"{shared_dir(words.sparkSession)}/blocks-{uuid.uuid4().hex}"
    rows.groupBy(*keys, "_block").applyInPandas(block, schema).write.option("maxRecordsPerFile", 1).parquet(path)  # a file for each
    return words.sparkSession.read.parquet(path).select(*keys, "first", "rows", F.col("_metadata.file_path").alias("file"))


class Block:
    """A stored block: the tokens of all its rows by code, with their shares and those times their logarithms."""

    def __init__(self, file: str) -> None:
        system, path = opened(file)
        with system.open_input_file(path) as source:
            row = pq.read_table(source, columns=["names", "starts", "codes", "counts"])
        part = lambda name, kind: np.frombuffer(row[name][0].as_buffer(), kind)
        names = row["names"][0].as_py()
        self.names = pa.array(names.split("\n") if names else [], pa.string())
        self.starts, self.codes = part("starts", "<i8"), part("codes", "<i4")
        n = part("counts", "<i4").astype(float)
        size = np.diff(self.starts)
        totals = np.bincount(np.repeat(np.arange(len(size)), size), weights=n, minlength=len(size))
        self.share = n / np.repeat(totals, size)
        self.logs = self.share * np.log2(self.share)
        self.mass = (size > 0).astype(float)

    def met_by(self, other: Block) -> tuple[np.ndarray, ...]:
        """Starts, codes, shares and logs of this block's entries whose tokens another row of ``other`` may hold, in the codes of ``other``."""
        if other is self:
            place = np.arange(len(self.names), dtype=np.int64)
            place[np.bincount(self.codes, minlength=len(place)) < 2] = -1
        else:
            place = pc.fill_null(pc.index_in(self.names, value_set=other.names), -1).to_numpy(zero_copy_only=False)
        codes = place[self.codes]
        use = codes >= 0
        starts = np.concatenate([[0], np.cumsum(use)])[self.starts]
        return starts, codes[use], self.share[use], self.logs[use]


def common_parts(left: Block, right: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the tokens that two rows share take off the sum of both rows' masses; only the tokens of rows j are gone through, in a table of row i."""
    starts, codes, share, logs = right.met_by(left)
    by_row = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[by_row], prepend=-1, append=-1))
    own, own_logs, there = np.zeros(len(left.names)), np.zeros(len(left.names)), np.zeros(len(left.names), bool)
    common = np.zeros(len(i))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = slice(left.starts[i[by_row[a]]], left.starts[i[by_row[a]] + 1])
        low = starts[j[by_row[a:b]]]
        size = starts[j[by_row[a:b]] + 1] - low
        pairs, low, size = by_row[a:b][size > 0], low[size > 0], size[size > 0]
        if not len(pairs):
            continue
        mine_codes = left.codes[mine]
        own[mine_codes], own_logs[mine_codes], there[mine_codes] = left.share[mine], left.logs[mine], True
        ends = np.cumsum(size)
        at = np.ones(ends[-1], np.int64)  # the places of all entries of the rows j: steps of one, and jumps where a row begins
        at[0] = low[0]
        at[ends[:-1]] = low[1:] - (low[:-1] + size[:-1] - 1)
        at = np.cumsum(at)
        met = codes[at]
        hit = np.flatnonzero(there[met])
        at, met = at[hit], met[hit]
        both = own[met] + share[at]
        gain = both * np.log2(both) - own_logs[met] - logs[at]
        common[pairs] = np.bincount(np.searchsorted(ends, hit, "right"), weights=gain, minlength=len(pairs))
        there[mine_codes] = False
    return common


def js_of_pairs(left: Block, right: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows i of one block and rows j of the other, as ``lexical.js_distance``.

    Tokens that one row has alone give their share, so only common ones are looked for, those of the shorter row in the longer one.
    """
    longer = np.diff(left.starts)[i] >= np.diff(right.starts)[j]
    common = np.zeros(len(i))
    if left is right:
        common = common_parts(left, left, np.where(longer, i, j), np.where(longer, j, i))
    else:
        common[longer] = common_parts(left, right, i[longer], j[longer])
        common[~longer] = common_parts(right, left, j[~longer], i[~longer])
    return np.sqrt(np.maximum(0.0, (left.mass[i] + right.mass[j] - common) / 2))


def tiled_pairs(series: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """Neighbours in each order, by tiles: rows of two files' blocks by their numbers there. Replicate 0 is the order as it is.

    Shuffled orders are those of ``vectors.permuted``: row numbers by their seeded hashes. A task orders the row numbers of one series.
    """
    orders = series.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.xxhash64(F.lit(seed), F.col("rep"), i).cast("double"))
    orders = orders.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "rep").withColumn("h", F.when(F.col("rep") > 0, hashes))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                n, firsts, files = row["n"], np.array([b["first"] for b in row["blocks"]], np.int64), [b["file"] for b in row["blocks"]]
                order = np.arange(n) if row["rep"] == 0 else np.argsort(row["h"], kind="stable")
                x, y = order[:-1], order[1:]
                of_x, of_y = np.searchsorted(firsts, x, "right") - 1, np.searchsorted(firsts, y, "right") - 1
                x, y, a, b = (np.where(of_x <= of_y, *both) for both in ((x, y), (y, x), (of_x, of_y), (of_y, of_x)))
                tile = a * len(files) + b
                by_tile = np.argsort(tile, kind="stable")
                cuts = np.flatnonzero(np.diff(tile[by_tile], prepend=-1, append=-1))
                parts = -(-(reps * n * 2) // (len(files) ** 2 * PAIRS))
                out = []
                for k in np.split(by_tile, cuts[1:-1]) if len(tile) else []:
                    i, j = x[k] - firsts[a[k[0]]], y[k] - firsts[b[k[0]]]
                    out.append([*(row[c] for c in keys), row["rep"], files[a[k[0]]], files[b[k[0]]], row["rep"] % parts, i.astype("<i4").tobytes(), j.astype("<i4").tobytes()])
                yield pd.DataFrame(out, columns=[*keys, "rep", "left", "right", "part", "i", "j"])

    return orders.mapInPandas(pairs, f"{key_types(series, keys)}rep int, left string, right string, part long, i binary, j binary")


def mean_drifts(df: DataFrame, keys: list[str], order: str, text: str, reps: int, seed: int) -> DataFrame:
    """(keys, rep, js): the mean Jensen-Shannon distance of neighbouring texts, in their own order (rep 0) and in ``reps`` shuffled ones.

    Series with a null key, or with fewer than two texts that hold words, have no rows.
    """
    table = blocks(kept(counted_words(df, keys, order, text), "words"), keys, order)
    series = table.groupBy(*keys).agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("first", "file"))).alias("blocks"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        left = Block(frame["left"].iloc[0])
        right = left if frame["right"].iloc[0] == frame["left"].iloc[0] else Block(frame["right"].iloc[0])
        i, j = (np.concatenate([np.frombuffer(x, "<i4") for x in frame[c]]) for c in ("i", "j"))
        js = js_of_pairs(left, right, i, j)
        ends = np.cumsum([len(x) // 4 for x in frame["i"]])
        found = frame[[*keys, "rep"]].copy()
        found["s"], found["m"] = [math.fsum(x) for x in np.split(js, ends[:-1])], np.diff(ends, prepend=0)
        return found

    sums = tiled_pairs(series, keys, reps, seed).groupBy("left", "right", "part").applyInPandas(tile, f"{key_types(df, keys)}rep int, s double, m long")
    return sums.groupBy(*keys, "rep").agg((F.sum("s") / F.sum("m")).alias("js"))
