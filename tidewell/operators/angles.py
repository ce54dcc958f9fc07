"""Angles between the vectors of rows, against those of normal draws and of vectors that are permuted over the rows.

The null angles are as many as rows times replicates, and only their mean, their deviation and their distance from the observed ones are asked
for. So a task draws or looks up its part of them and hands on sums and counts: the distance of two distributions is greatest at an observed angle or
just before one, so null angles between two neighbouring observed ones may step together. Permuted vectors don't travel: they are stored in blocks
of rows, and a task reads the two blocks of its tile of pairs. The observed angles of a pair, eight bytes a row, are in a task's memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import with_index
from tidewell.operators.vectors import pair_distances
from tidewell.sources.shared import opened, shared_dir

#: Rows of a block, least pairs of a task, and tasks that one null takes at most for each tile.
ROWS, PAIRS, TASKS = 1 << 15, 300_000, 48
SUMS = "pair string, n long, mean double, m2 double, values array<double>, counts array<long>"


def stored_rows(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows in the order of the key in blocks: (first, rows, file), ``first`` the number of the first row and ``file`` where the block is."""
    rows = with_index(df.select(F.lit(1).alias("one"), key, *names), ["one"], [key]).withColumn("_h", F.xxhash64(key))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        parts = [np.stack(list(frame[n])).astype("<f8").tobytes() for n in names]
        return pd.DataFrame([[int(frame["idx"].iloc[0]), len(frame), frame["_h"].to_numpy("<i8").tobytes(), *parts]], columns=["first", "rows", "_h", *names])

    path = f"{shared_dir(df.sparkSession)}/states-{uuid.uuid4().hex}"
    found = rows.groupBy(F.floor(F.col("idx") / ROWS).alias("_b")).applyInPandas(block, "first long, rows long, _h binary, " + ", ".join(f"{n} binary" for n in names))
    found.write.option("maxRecordsPerFile", 1).parquet(path)  # a file for each
    return df.sparkSession.read.parquet(path).select("first", "rows", F.col("_metadata.file_path").alias("file"))


def part_of(file: str, name: str, kind: str = "<f8") -> np.ndarray:
    system, path = opened(file)
    with system.open_input_file(path) as source:
        return np.frombuffer(pq.read_table(source, columns=[name])[name][0].as_buffer(), kind)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors by their lengths; NaN below 1e-12, as ``stats.cosine_distance`` has it."""
    size = np.sqrt((vectors * vectors).sum(-1, keepdims=True))
    return vectors / np.where(size >= 1e-12, size, np.nan)


def angles_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, 0 where one is missing, as ``stats.angle``."""
    return np.arccos(np.clip(np.nan_to_num(np.einsum("pd,pd->p", x, y), nan=1.0), -1, 1))


def observed_angles(folder: str) -> dict[str, np.ndarray]:
    """The observed angles by pair, and of all pairs, in order."""
    system, path = opened(folder)
    table = pq.read_table(path, filesystem=system).to_pandas().dropna()
    return {pair: np.sort(x.to_numpy(float)) for pair, x in [*table.groupby("pair")["angle"], ("all", table["angle"])]}


def summed(pair: str, angles: np.ndarray, seen: dict[str, np.ndarray]) -> Iterator[tuple]:
    """Sums of null angles of a pair, for it and for all pairs: number, mean, squares, and counts at observed angles and between them."""
    angles = np.sort(angles)
    if len(angles):
        for name in (pair, "all"):
            at = seen.get(name, np.zeros(0))
            slot = np.searchsorted(at, angles, "left") + np.searchsorted(at, angles, "right")  # equal to one, or between two
            last = np.flatnonzero(np.diff(slot, append=-1))
            yield name, len(angles), float(angles.mean()), float(((angles - angles.mean()) ** 2).sum()), angles[last], np.diff(last, prepend=-1)


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pair", "n", "mean", "m2", "values", "counts"])


def gaussian_sums(table: DataFrame, names: list[str], reps: int, seed: int, folder: str) -> DataFrame:
    """Sums of the angles of normal vectors, drawn for each row, vector and replicate by a generator that the row's key seeds.

    Lengths do not change an angle.
    """
    ranges = table.join(F.broadcast(table.agg(F.sum("rows").alias("n"))))
    size = F.greatest(F.lit(-(-PAIRS // reps)), F.ceil(F.col("n") / TASKS)).cast("long")
    ranges = ranges.withColumn("size", size).select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, size)).alias("low"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, size, low in frame.itertuples(index=False):
                hashes = part_of(file, "_h", "<i8")
                given = np.stack([unit(part_of(file, n).reshape(len(hashes), -1)) for n in names], 1)[low : low + size]
                angles = np.empty((len(given), reps, len(names) * (len(names) - 1) // 2))
                for at, h in enumerate(hashes[low : low + size]):
                    x = unit(np.random.default_rng([seed, int(h) % (1 << 64)]).standard_normal((reps, *given.shape[1:])))
                    x = np.where(np.isnan(given[at, :, :1]), np.nan, x)
                    for p, (a, b) in enumerate(combinations(range(len(names)), 2)):
                        angles[at, :, p] = angles_of(x[:, a], x[:, b])
                seen = observed_angles(folder)
                yield frame_of([x for p, (a, b) in enumerate(combinations(names, 2)) for x in summed(f"{a}-{b}", angles[:, :, p].ravel(), seen)])

    return ranges.repartition(TASKS, "file", "low").mapInPandas(draw, SUMS)


def permuted_sums(table: DataFrame, names: list[str], reps: int, seed: int, folder: str) -> DataFrame:
    """Sums of the angles of vectors that are permuted over the rows, each name's in ``reps`` orders of its own: those of ``vectors.permuted`` with ``seed``
    plus the name's place. A task orders the row numbers of one replicate."""
    whole = table.agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("first", "file"))).alias("blocks")).where("n > 0")
    orders = whole.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    hashed = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.xxhash64(F.lit(s), F.col("rep"), i).cast("double"))
    hashes = [hashed(seed + k).alias(f"h{k}") for k in range(len(names))]
    orders = orders.repartition(TASKS, "rep").select("n", "blocks", "rep", *hashes)

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                firsts, files = np.array([b["first"] for b in row["blocks"]], np.int64), [b["file"] for b in row["blocks"]]
                order = [np.argsort(row[f"h{k}"], kind="stable") for k in range(len(names))]
                parts = max(1, min(TASKS, reps * row["n"] // (PAIRS * len(files) ** 2)))
                out = []
                for a, b in combinations(range(len(names)), 2):
                    of_a, of_b = (np.searchsorted(firsts, order[k], "right") - 1 for k in (a, b))
                    tile = of_a * len(files) + of_b
                    by_tile = np.argsort(tile, kind="stable")
                    for k in np.split(by_tile, np.flatnonzero(np.diff(tile[by_tile])) + 1):
                        left, right = of_a[k[0]], of_b[k[0]]
                        ids = [(order[c][k] - firsts[x]).astype("<i4").tobytes() for c, x in ((a, left), (b, right))]
                        out.append((a, b, files[left], files[right], row["rep"] % parts, *ids))
                yield pd.DataFrame(out, columns=["a", "b", "left", "right", "part", "i", "j"])

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = names[frame["a"].iloc[0]], names[frame["b"].iloc[0]]
        i, j = (np.frombuffer(b"".join(frame[c]), "<i4") for c in ("i", "j"))
        x, y = (unit(part_of(frame[side].iloc[0], name).reshape(int(at), -1)) for side, name, at in (("left", a, frame["rows_l"].iloc[0]), ("right", b, frame["rows_r"].iloc[0])))
        found = np.concatenate([angles_of(x[i[k : k + 8192]], y[j[k : k + 8192]]) for k in range(0, len(i), 8192)])
        return frame_of(list(summed(f"{a}-{b}", found, observed_angles(folder))))

    dealt = orders.mapInPandas(pairs, "a int, b int, left string, right string, part long, i binary, j binary")
    sizes = [table.select(F.col("file").alias(side), F.col("rows").alias(f"rows_{side[0]}")) for side in ("left", "right")]
    dealt = dealt.join(F.broadcast(sizes[0]), "left").join(F.broadcast(sizes[1]), "right")  # a row a block
    return dealt.groupBy("a", "b", "left", "right", "part").applyInPandas(tile, SUMS)


def angle_sums(df: DataFrame, key: str, names: list[str], reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Observed angles (pair, angle), each also for the pair ``all``, and sums of both nulls (null and the columns of SUMS)."""
    folder = f"{shared_dir(df.sparkSession)}/angles-{uuid.uuid4().hex}"
    table = stored_rows(df, key, names)
    pair_distances(df, [], names).select("pair", "angle").write.parquet(folder)
    seen = df.sparkSession.read.parquet(folder).select(F.explode(F.array("pair", F.lit("all"))).alias("pair"), "angle")
    gaussian = gaussian_sums(table, names, reps, seed, folder).select(F.lit("gaussian").alias("null"), "*")
    permuted = permuted_sums(table, names, reps, seed, folder).select(F.lit("permuted").alias("null"), "*")
    return seen, gaussian.unionByName(permuted)
