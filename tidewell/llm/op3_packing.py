"""Bulk-synchronous best-fit packing of token sequences (operator 3).

Each document is its tokens and an end id. Documents of more than CAPACITY tokens are cut
into pieces of that length, the first one shorter. Pieces of one length are alike, so the
sorted documents and the sorted gaps are held as runs (size, count): at most CAPACITY runs
of documents, and at most three times as many of gaps, however large the corpus is. A sweep takes the
longest run of documents and matches it with its successors among the gaps, smallest fitting
gap first, a whole run at a time; ranks within the runs say which document meets which gap.
The gaps it used shrink, and the next sweep follows. Documents without a gap open sequences.

The sweeps run over those bounded runs only. What grows with the corpus runs in Spark: the
tokens, the counts of each length, the rank of each piece within its length (dealt to parts
of each length, whose counts give the offsets; their number grows with the longest run), and the lookup of its place.

* Null or empty text: the end id alone. Empty table: empty result. Repeated rows are packed
  each; ties go by doc_id, piece and ids. Rows without doc_id are packed, too. A long text is cut
  as said, whole in its task's memory. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.op4_bpe import BATCH, VOCABULARY, encode_texts, vocabulary
from tidewell.llm.tables import stored

CAPACITY, END = 2048, 0
SALTS, PART = 64, 500_000  # parts of a length: 64 at least, of about PART pieces


def token_pieces(docs: DataFrame, doc_id: str, text: str, path: str, capacity: int, end: int) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, stop = vocabulary(path), np.array([end], "<i4")
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                rows = []
                flat, at = encode_texts(v, part.column(1))
                for doc, low, high in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = np.concatenate([flat[low:high], stop])
                    ends = np.arange(len(ids), 0, -capacity)[::-1].tolist()
                    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                        rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(cut, schema)


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Matches of document runs and gap runs: rows (length, first rank, first sequence, offset).

    The documents of a length with ranks from the first one on, up to the next row's first
    rank, take one place each in consecutive sequences at the given offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs (first sequence, count)
    sizes: list[int] = []
    n_sequences, out = 0, []

    def put(size: int, first: int, count: int) -> None:
        if size and size not in gaps:
            bisect.insort(sizes, size)
        if size:
            gaps.setdefault(size, []).append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                opened = -(-left // (capacity // length))
                put(capacity, n_sequences, opened)
                n_sequences += opened
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            used = min(left, count)
            if used < count:
                gaps[gap].append((first + used, count - used))
            elif not gaps[gap]:
                del gaps[gap], sizes[at]
            out.append((length, rank, first, capacity - gap))
            put(gap - length, first, used)
            rank, left = rank + used, left - used
    return np.array(out, np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of one length.

    A length may hold a third of all pieces: each is dealt to ``salts`` parts.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop(
        "salt", "own", "before"
    )


def placed(pieces: DataFrame, runs: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to ranked pieces; ``runs`` is bounded by the capacity, not by the corpus."""
    key = runs[:, 0] << 44 | runs[:, 1]
    order = np.argsort(key)
    key, runs = key[order], runs[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            run = runs[np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.select(*columns).mapInArrow(place, schema)


def best_fit_packing(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = stored(token_pieces(docs, doc_id, text, path, capacity, end), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    salts = max(SALTS, -(-max(counts.values(), default=0) // PART))
    return placed(ranked(pieces, salts), best_fit_runs(counts, capacity))
