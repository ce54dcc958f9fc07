"""Removal of repeated byte strings (operator 8), through anchored windows.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Strings
("windows") are compared by hashes of their bytes, as ranges of one running sum.

1. Each window names an anchor: its KMER-byte substring of least hash, the first if tied.
   Equal windows have equal anchors at equal distances. A run of neighbouring windows with
   one anchor is a piece: the bytes from its first window to the end of its last one.
2. Pieces whose anchor occurs nowhere else hold no repeated window. Pieces that are equal as
   a whole, with anchors at equal distances, are repeated as a whole.
3. What is left, single pieces with an anchor that other pieces have too, is compared window by
   window with one of each of those others: in one task for each anchor, as arrays; the windows of
   anchors whose pieces have more than GROUP_WINDOWS of them are dealt out by their hashes instead.
4. Repeated windows are merged into spans, and the spans cut out of their documents.

Groups are counted where they are read before any shuffle, and joins run on stored tables, so
a passage that many documents share is not gathered in one task.

* Null text: empty. Empty table: empty result. Rows that share doc_id and text are documents
  of their own, so each is a copy of the other; they are cut alike. Rows without doc_id
  count as documents, too; they are joined by the hashes of their texts. Extra columns are ignored.
* The operator gives spans and texts (``without_repeats``); the query derives its digests from them.
* A text is handled whole in one task, with some 100 bytes of arrays for each of its bytes.

The named method merges Burrows-Wheeler transforms of shards by interleave refinement. The README
says with figures why this operator compares anchored windows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import whole_runs
from tidewell.llm.bytes import RangeHash, buffer_of, groups
from tidewell.llm.tables import discard, stored

LENGTH, KMER, GROUP_WINDOWS = 400, 100, 1 << 20
#: Windows compared at once, where one anchor has no more.
BATCH_WINDOWS = 1 << 18
#: Window starts handled at once; positions take the low bits of what is compared.
CHUNK_BITS = 20


def window_anchors(kmers: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value among ``width`` neighbours, from each position on."""
    n = len(kmers) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    step = (1 << CHUNK_BITS) - width
    low_bits = np.uint64((1 << CHUNK_BITS) - 1)
    for c in range(0, n, step):
        part = kmers[c : min(c + step, n) + width - 1]
        least = (part & ~low_bits) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < width:  # the least of ever longer ranges, the last two of them overlapping
            shift = min(size, width - size)
            least = np.minimum(least[:-shift], least[shift:])
            size += shift
        out[c : c + len(least)] = c + (least & low_bits).astype(np.int64)
    return out


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, piece hash, and first and last window start (in the text) of each piece."""
    of_bytes = RangeHash(data)
    n = len(data) - kmer + 1
    if n <= length - kmer:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n)
    kmers = of_bytes(at, at + kmer)
    anchor = window_anchors(kmers, length - kmer + 1)
    start = np.arange(len(anchor))
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[1:][text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    # a piece ends before the next one begins, and with the last window of its text
    bounds = np.concatenate([np.flatnonzero(new), [len(anchor)]])
    last = np.minimum(bounds[np.searchsorted(bounds, first, side="right")] - 1, offsets[1:][text[first]] - length)
    where = of_bytes(first, last + length) ^ (anchor[first] - first).astype(np.uint64)
    of = text[first]
    return of, kmers[anchor[first]].view(np.int64), where.view(np.int64), first - offsets[of], last - offsets[of]


def pieces(docs: DataFrame, length: int, kmer: int) -> DataFrame:
    """Pieces of all texts: doc_id, t (hash of the text), f (anchor), h (piece), low, high (window starts)."""
    names = "doc_id t f h low high".split()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(1)):
                data, offsets = buffer_of(batch.column(1).slice(low, high - low))
                hashes = RangeHash(data)(offsets[:-1], offsets[1:]).view(np.int64)
                of, f, h, a, b = pieces_of(data, offsets, length, kmer)
                ids = batch.column(0).slice(low, high - low).take(pa.array(of))
                columns = [ids, pa.array(hashes[of]), pa.array(f), pa.array(h), pa.array(a), pa.array(b)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(find, "doc_id long, t long, f long, h long, low long, high long")


PIECE = ["doc_id", "t", "f", "low", "high", "single"]


def piece_bytes(texts: DataFrame, length: int) -> DataFrame:
    """The wanted pieces (PIECE) of each text with their bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(2)):
                part = batch.slice(low, high - low)
                rows = []
                for doc, t, text, wish in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = text.encode()
                    rows += [(doc, t, w["f"], w["low"], w["high"], w["single"], raw[w["low"] : w["high"] + length]) for w in wish]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*PIECE, "bytes"])

    return texts.mapInArrow(build, "doc_id long, t long, f long, low long, high long, single boolean, bytes binary")


def windows_of(rows: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all pieces on end, and which piece each belongs to."""
    data, offsets = buffer_of_bytes(rows["bytes"])
    sizes = np.diff(offsets) - length + 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = offsets[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return RangeHash(data)(at, at + length), of


def buffer_of_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def some_anchors(rows: pa.Table, length: int) -> Iterator[pa.Table]:
    """Parts of a table of whole anchors: the pieces of one anchor or more, of about BATCH_WINDOWS windows."""
    anchor = np.asarray(rows["f"])
    before = np.cumsum(np.asarray(pc.binary_length(rows["bytes"])) - length + 1)
    ends = np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
    low, part = 0, -1
    for end in ends.tolist():
        if before[end - 1] // BATCH_WINDOWS != part and part >= 0:
            yield rows.slice(low, end - low)
            low = end
        part = before[end - 1] // BATCH_WINDOWS
    if low < len(anchor):
        yield rows.slice(low)


def repeats_within(pieces_: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of single pieces, each anchor's pieces compared in one task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in (part for rows in whole_runs(batches, 0) for part in some_anchors(rows, length)):  # their windows differ
            hashes, of = windows_of(run, length)
            _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            single = np.asarray(run["single"].combine_chunks().cast(pa.int8())).astype(bool)
            hit = (counts[inverse] > 1) & single[of]
            begin = hit & ~np.concatenate([[False], hit[:-1] & (of[1:] == of[:-1])])
            stop = hit & ~np.concatenate([hit[1:] & (of[1:] == of[:-1]), [False]])
            first, last = np.flatnonzero(begin), np.flatnonzero(stop)
            place = np.asarray(run["low"])[of[first]] - np.searchsorted(of, of[first])
            at = pa.array(of[first])
            yield pa.RecordBatch.from_arrays(
                [run["doc_id"].combine_chunks().take(at), run["t"].combine_chunks().take(at), pa.array(place + first), pa.array(place + last)],
                ["doc_id", "t", "low", "high"],
            )

    rows = pieces_.select("f", "doc_id", "t", "low", "high", "single", "bytes").repartition("f").sortWithinPartitions("f")
    return rows.mapInArrow(compare, "doc_id long, t long, low long, high long")


def repeats_across(pieces_: DataFrame, length: int) -> DataFrame:
    """The same for anchors of any number of pieces: windows meet by their hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, of = windows_of(batch, length)
            start = np.asarray(batch["low"])[of] + np.arange(len(of)) - np.searchsorted(of, of)
            at = pa.array(of)
            columns = [batch["doc_id"].take(at), batch["t"].take(at), pa.array(start), batch["single"].take(at), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "low", "single", "w"])

    windows = stored(pieces_.mapInArrow(build, "doc_id long, t long, low long, single boolean, w long"), "windows", large=True)
    often = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    again = windows.where("single").join(stored(often, "often", large=True), "w", "left_semi")
    return again.select("doc_id", "t", "low", F.col("low").alias("high"))


def text_hash(texts: pa.Array) -> pa.Array:
    out = []
    for low, high in groups(texts):
        data, offsets = buffer_of(texts.slice(low, high - low))
        out.append(RangeHash(data)(offsets[:-1], offsets[1:]).view(np.int64))
    return pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))


def hashed_without_id(docs: DataFrame) -> DataFrame:
    """The rows without doc_id, with the hash of their texts, by which they are joined."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, text_hash(batch.column(1))], ["doc_id", "text", "t"])

    return docs.where("doc_id IS NULL").mapInArrow(add, "doc_id long, text string, t long")


def matching_texts(docs: DataFrame, wish: DataFrame) -> DataFrame:
    """Texts of documents with wishes: doc_id, t, text, wish; one row for each that shares doc_id and text."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.asarray(text_hash(batch.column(2))) == np.asarray(batch.column(1))
            yield batch.filter(pa.array(same))

    columns = ["doc_id", "t", "text", *[c for c in wish.columns if c not in ("doc_id", "t")]]
    joined = docs.where("doc_id IS NOT NULL").join(wish, "doc_id").select(*columns)
    without_id = hashed_without_id(docs).join(wish.where("doc_id IS NULL").drop("doc_id"), "t").select(*columns)
    return joined.mapInArrow(match, joined.schema).unionByName(without_id)


def repeated_spans(docs: DataFrame, length: int, kmer: int, group_windows: int) -> DataFrame:
    """Runs of repeated windows: doc_id, t, low, high (first and last window start)."""
    found = stored(pieces(docs, length, kmer), "pieces", large=True)
    place = F.struct("doc_id", "t", "low", "high")
    kinds = stored(found.groupBy("f", "h").agg(F.count("*").alias("n"), F.min(place).alias("one")), "kinds", large=True)
    copied = stored(kinds.where("n > 1").select("f", "h"), "copied")
    whole = stored(found.join(copied, ["f", "h"], "left_semi").select("doc_id", "t", "low", "high"), "whole", large=True)
    # anchors of several kinds of pieces, one of which is single at least
    windows = F.sum(F.col("one.high") - F.col("one.low") + 1).alias("windows")
    mixed = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), windows).where("kinds > 1 AND least = 1")
    mixed = stored(mixed.select("f", "windows"), "mixed", large=True)
    chosen = kinds.join(mixed, "f").select("f", "one.*", (F.col("n") == 1).alias("single"), (F.col("windows") > group_windows).alias("many"))
    wish = chosen.groupBy("doc_id", "t", "many").agg(F.collect_list(F.struct("f", "low", "high", "single")).alias("wish"))
    wish = stored(wish, "wish", large=True)
    parts = []
    for many, compare in ((False, repeats_within), (True, repeats_across)):
        if not wish.where(F.col("many") == many).isEmpty():
            texts = matching_texts(docs, wish.where(F.col("many") == many).drop("many"))
            texts = stored(piece_bytes(texts, length), "bytes", large=True)
            parts.append(stored(compare(texts, length), "parts", large=True))
            discard(texts)
    discard(found, kinds, wish)
    for part in parts:
        whole = whole.unionByName(part)
    return whole


def without_covered(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list[dict[str, int]], bytes, bytes]:
    """Spans of the bytes from each ``low`` up to ``high``, the other bytes, and those of characters without a byte in a span."""
    gone = np.zeros(len(raw) + 1, np.int32)
    np.add.at(gone, low, 1)
    np.add.at(gone, high, -1)
    covered = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist()
    of = np.cumsum((raw & 0xC0) != 0x80)  # a byte's character
    touched = np.zeros(len(raw) + 1, bool)
    touched[of[covered]] = True
    spans = [{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return spans, raw[~covered].tobytes(), raw[~touched[of]].tobytes()


def cut_texts(docs: DataFrame, repeats: DataFrame, length: int) -> DataFrame:
    """Per document: doc_id, spans, kept, text; see ``without_repeats``."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in groups(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                rows = []
                for i, (text, wish) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    whole, same = text.as_buffer().to_pybytes() if text.is_valid else b"", []
                    if wish.is_valid:
                        own, low, high = (np.asarray(wish.values.field(k)) for k in range(3))
                        same = np.flatnonzero(own == np.asarray(text_hash(part.column(1).slice(i, 1)))[0])
                    if len(same):
                        rows.append(without_covered(np.frombuffer(whole, np.uint8), low[same], high[same] + length))
                    else:
                        rows.append(([], whole, whole))
                spans, kept, left = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(spans, spans_type), pa.array(kept, pa.binary()), pa.array(left, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "kept", "text"])

    # neighbouring windows of a document become one span before its spans are gathered
    order = Window.partitionBy("doc_id", "t").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = repeats.withColumn("new", F.when(F.col("low") <= reach + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "t", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    runs = stored(runs, "runs", large=True)
    gathered = F.collect_list(F.struct("t", "low", "high")).alias("wish")
    wish = runs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(gathered)
    named = docs.where("doc_id IS NOT NULL").join(wish, "doc_id", "left").select("doc_id", "text", "wish")
    wish = runs.where("doc_id IS NULL").groupBy("t").agg(gathered)
    without_id = hashed_without_id(docs).join(wish, "t", "left").select("doc_id", "text", "wish")
    schema = "doc_id long, spans array<struct<start: long, end: long>>, kept binary, text string"
    return named.unionByName(without_id).mapInArrow(cut, schema)


def without_repeats(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    kmer: int = KMER,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Per document: doc_id, spans (its removed runs, from byte start up to end), kept (the bytes left), text (what is left as text).

    Where a run ends inside a character, ``kept`` has the rest of its bytes and ``text`` does not have the character.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut_texts(own, repeated_spans(own, length, kmer, group_windows), length)


def remove_repeats(docs: DataFrame, **options: str | int) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of what is left, then spans and text of ``without_repeats``."""
    found = without_repeats(docs, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.end - s.start)
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "spans",
        "text",
    )
