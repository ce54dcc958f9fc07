"""Token counts by separator scan (operator 10).

A flat token file is an array of 16- or 32-bit ids without an index, in which an end id
follows each document. Blocks of BLOCK tokens are scanned apart, each by a task that reads its
own byte range and no more: one vectorised comparison finds the end ids of a block. A block
then says how many tokens and ends it holds, where its first and last ends are, and the
lengths between them. Prefix scans over the blocks of a file (running sums of tokens and ends,
running maximum of the last end's position) give each block its place and the start of the
document that reaches into it, and stitch the boundaries.

The tables hold no token files, so the query first writes one for each partition of the documents
to the shared folder, and a manifest beside it: which documents a file holds, in order.
A file's name is new for each attempt of a task, and only files that the manifest names are read:
what a lost or repeated attempt has left behind counts nowhere.

* Null or empty texts are documents of no tokens. Tokens after a file's last end are an
  unfinished document, with ``ended`` false. Empty input: empty result. A text of any length is
  tokenised whole, and scanned in as many blocks as it takes.
* Documents are known by file and ordinal; a manifest (file, ordinal, doc_id) names them, null ids included.
  Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.op4_bpe import BATCH, VOCABULARY, encode_texts, vocabulary
from tidewell.llm.tables import shared_dir, stored

BLOCK, END = 1 << 17, 50256
SCAN = "file string, block long, n_tokens long, n_ends long, first long, last long, lengths array<long>"


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, int, int, np.ndarray]:
    """Tokens, ends, position of the first and last end (-1: none), and lengths between ends."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), 0, -1, -1, at
    return len(ids), len(at), int(at[0]), int(at[-1]), np.diff(at) - 1


def scan_rows(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]


def opened(name: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))


def scanned(files: DataFrame, *, width: int = 2, block: int = BLOCK, end: int = END) -> DataFrame:
    """Scanned blocks of flat token files (file, size in bytes). A task holds one block of ids at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = opened(name)
                with system.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(block * width, k * block * width), f"<u{width}")
                yield pa.RecordBatch.from_arrays(scan_rows([(name, k, *scan_block(ids, end))]), schema=schema)

    schema = pa.schema(list(zip("file block n_tokens n_ends first last lengths".split(), [a.type for a in scan_rows([])], strict=True)))
    ranges = files.where("size > 0").selectExpr("file", f"explode(sequence(0L, (size - 1) div {block * width})) AS block")
    return ranges.repartition("file", "block").mapInArrow(scan, SCAN)


def file_blocks(spark: SparkSession, path: str, *, width: int = 2, block: int = BLOCK, end: int = END) -> DataFrame:
    """Scanned blocks of all flat token files under ``path``; listing them reads none of their content."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return scanned(files, width=width, block=block, end=end)


def token_files(docs: DataFrame, folder: str, *, doc_id: str, text: str, path: str, width: int, end: int) -> DataFrame:
    """Writes each partition's documents as one flat token file; returns the manifest's parts: file, ordinal, ids, size.

    ``ids`` are those of the documents from ``ordinal`` on; ``size`` is the number of bytes they take.
    """
    names = ["file", "ordinal", "ids", "size"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, stop, n_docs = vocabulary(path, False), np.array([end], "<i4"), 0
        name = f"{folder}/{uuid.uuid4().hex}.ids"
        system, place = opened(name)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as target:
            for batch in batches:
                for k in range(0, batch.num_rows, BATCH):
                    part = batch.slice(k, BATCH)
                    flat, at = encode_texts(v, part.column(1))
                    written = target.write(np.insert(flat, at[1:], stop).astype(f"<u{width}").tobytes())
                    row = [[name], [n_docs], [part.column(0).to_pylist()], [written]]
                    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names)
                    n_docs += part.num_rows

    schema = "file string, ordinal long, ids array<long>, size long"
    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(write, schema)


def token_counts(blocks: DataFrame) -> DataFrame:
    """Per document of scanned blocks: file, ordinal, n_tokens, ended."""
    slim = blocks.select("file", "block", "n_tokens", "n_ends", "first", "last")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumns(
        {
            "start": F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0)),
            "ordinal": F.coalesce(F.sum("n_ends").over(so_far), F.lit(0)),
        }
    )
    after = F.when(F.col("n_ends") > 0, F.col("start") + F.col("last") + 1)
    placed = placed.withColumn("open", F.coalesce(F.max(after).over(so_far), F.lit(0)))
    lengths = F.concat(F.array(F.col("start") + F.col("first") - F.col("open")), F.col("lengths"))
    ended = (
        placed.where("n_ends > 0")
        .join(blocks.select("file", "block", "lengths"), ["file", "block"])
        .select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens"))
        .select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    )
    tails = placed.groupBy("file").agg(
        F.sum("n_ends").alias("ordinal"), (F.sum("n_tokens") - F.coalesce(F.max(after), F.lit(0))).alias("n_tokens")
    )
    return ended.unionByName(tails.where("n_tokens > 0").withColumn("ended", F.lit(False)))


def document_token_counts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    width: int = 2,
    block: int = BLOCK,
    end: int = END,
) -> DataFrame:
    """doc_id and n_tokens of each document, counted in flat token files in the shared folder.

    ``width`` is the bytes of an id: 2 holds vocabularies of up to 65,536 tokens.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    parts = stored(token_files(docs, folder, doc_id=doc_id, text=text, path=path, width=width, end=end), "manifest")
    files = parts.groupBy("file").agg(F.sum("size").alias("size"))
    counts = token_counts(stored(scanned(files, width=width, block=block, end=end), "blocks"))
    named = parts.select("file", "ordinal", F.posexplode("ids").alias("k", "doc_id"))
    manifest = named.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
