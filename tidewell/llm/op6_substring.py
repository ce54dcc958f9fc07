"""Substring dedup by paragraph MinHash banding (operator 6).

A paragraph is a line of LINE or more words, or a run of neighbouring shorter lines. A-Z count
as a-z; words are runs of characters other than space and U+0009..U+000D. Three steps find what to
remove; of all that belongs together, the first by doc_id and place stays.

1. Equal paragraphs of LINE or more words share a hash.
2. Nearly equal ones: MinHash over SHINGLE-word shingles with BANDS bands of ROWS values,
   tuned for recall (1 - (1 - 0.8**3)**8 = 0.997 at a similarity of 0.8, more above). Paragraphs of a bucket
   meet leaders among them, which only saves work: then all pairs of a bucket whose components still
   differ are compared. Links are verified by exact Jaccard similarity of PERCENT or more. Components
   of equal and verified paragraphs are the clusters of removals.
3. Passages inside paragraphs, whatever their lines and sentences: a word goes if a run of RUN words that
   covers it also stands at an earlier place, or at one that step 1 or 2 leaves where this one is removed.
   Runs are compared as in operator 8: neighbouring runs with one anchor (the KMER words of least hash)
   are a piece; equal pieces go whole, and different ones with one anchor are compared run by run.

Recall: steps 1 and 3 miss nothing. Step 2 misses a link of similarity 0.8 with probability 0.003 at most.
Repeats of fewer than RUN words inside paragraphs that differ, and equal paragraphs of fewer than
LINE words, are no removals by definition.

* Spans of step 3 can overlap those of paragraphs.
* Null and empty texts hold no paragraphs. Empty table: empty result. Rows that share doc_id
  and text are one document. Rows without doc_id come after all others
  and are told apart by their texts (doc_ids of 2**63 - 2**48 and more count as none). Extra columns are ignored.
* A text is handled whole in one task, however long, with some 150 bytes of arrays for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import arrays, whole_runs
from tidewell.llm.bytes import ODD, RangeHash, buffer_of, groups, lower_ascii, mix, shingle_hashes, words
from tidewell.llm.components import components
from tidewell.llm.op8_suffix import window_anchors
from tidewell.llm.tables import discard, met_by, stored, unused

LINE = 20
RUN, KMER = 50, 12
SHINGLE, BANDS, ROWS, PERCENT, LEADERS = 5, 8, 3, 80, 16
#: Buckets of more paragraphs, or of more shingles, are dealt to pairs of blocks.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21


class Units:
    """Words and paragraphs of a group of texts, as ranges with hashes."""

    def __init__(self, texts: pa.Array) -> None:
        data, self.offsets = buffer_of(texts)
        data = lower_ascii(data)
        of_bytes = RangeHash(data)
        self.start, self.end, self.of = words(data, self.offsets)
        self.text_hash = of_bytes(self.offsets[:-1], self.offsets[1:]).view(np.int64)
        self.word_hash = of_bytes(self.start, self.end)
        self.of_words = RangeHash(self.word_hash)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[self.start] - breaks[self.offsets[:-1]][self.of]
        new_line = np.ones(len(self.start), bool)
        new_line[1:] = (line[1:] != line[:-1]) | (self.of[1:] != self.of[:-1])
        first, end = self.ranges(new_line)
        short = end - first < LINE  # runs of short lines are one paragraph; an empty line ends it
        joined = short[1:] & short[:-1] & (line[first[1:]] == line[first[:-1]] + 1) & (self.of[first[1:]] == self.of[first[:-1]])
        new_line[first[1:][joined]] = False
        self.lines = self.ranges(new_line)
        first, end = self.lines
        self.line = np.repeat(line[first], end - first)

    @staticmethod
    def ranges(new: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(new)
        return np.stack([first, np.concatenate([first[1:], [len(new)]])]).astype(np.int64) if len(first) else np.zeros((2, 0), np.int64)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.of_words(a, b).view(np.int64)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Anchor hash, piece hash, and first and last run (its first word) of each piece."""
        n = len(self.start) - KMER + 1
        if n <= RUN - KMER:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        at = np.arange(n)
        grams = self.hashes(at, at + KMER).view(np.uint64)
        anchor = window_anchors(grams, RUN - KMER + 1)
        of = self.of[: len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        bounds = np.concatenate([np.flatnonzero(new), [len(anchor)]])
        first = np.flatnonzero(new & (self.of[RUN - 1 :] == of))
        ends = np.searchsorted(self.of, of[first], side="right")
        last = np.minimum(bounds[np.searchsorted(bounds, first, side="right")] - 1, ends - RUN)
        whole = self.hashes(first, last + RUN) ^ (anchor[first] - first)
        return grams[anchor[first]].view(np.int64), whole, first, last

    def shingles(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of word ranges on end, and where each range begins."""
        grams = shingle_hashes(self.word_hash, SHINGLE)
        sizes = b - a - SHINGLE + 1
        starts = np.cumsum(sizes) - sizes
        return grams[np.repeat(a - starts, sizes) + np.arange(sizes.sum())], starts


def band_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of BANDS keys for each range of shingles."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), np.uint64(band))
        for row in range(ROWS):
            seed = mix(np.array([1 + band * ROWS + row], np.uint64))[0] | np.uint64(1)
            key = mix(key * ODD + np.minimum.reduceat((shingles ^ (seed >> np.uint64(7))) * seed, starts))
        out[:, band] = key
    return out.view(np.int64)


RUNS = "doc_id long, t long, line int, low long, high long, start long, end long"


def units(docs: DataFrame) -> DataFrame:
    """Paragraphs (with band keys, no anchor) and pieces of runs (with an anchor) of all texts.

    RUNS: t is the hash of the text, low and high the first words of the first and last run, for a paragraph
    its first and last word, start and end bytes; f (anchor), h (hash of the whole), bands.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(1)):
                u = Units(batch.column(1).slice(low, high - low))
                ids = np.asarray(batch.column(0).slice(low, high - low))
                a, b = u.lines[:, u.lines[1] - u.lines[0] >= LINE]
                keys = band_keys(*u.shingles(a, b)) if len(a) else np.zeros((0, BANDS), np.int64)
                more = [pa.nulls(len(a), pa.int64()), u.hashes(a, b), arrays(list(keys), np.int64)]
                yield runs_batch(u, ids, a, b - 1, 1, more, ["f", "h", "bands"])
                f, h, first, last = u.pieces()
                yield runs_batch(u, ids, first, last, RUN, [f, h, pa.nulls(len(f), pa.list_(pa.int64()))], ["f", "h", "bands"])

    return docs.mapInArrow(find, f"{RUNS}, f long, h long, bands array<long>")


PLACE = ["doc_id", "t", "line", "start"]


def later_copies(found: DataFrame) -> DataFrame:
    """Units equal to an earlier one, with the earliest as ``first``.

    Counts come before the joins, so that a common paragraph is summed up where it is read,
    and joins run on stored tables, so that its rows can be split.
    """
    place = F.struct(*PLACE)
    counts = found.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = stored(counts.select("h"), "repeated", large=True)
    again = stored(found.join(repeated, "h", "left_semi"), "again", large=True)
    first = stored(again.groupBy("h").agg(F.min(place).alias("first")), "first", large=True)
    equal = stored(again.join(first, "h").where(place != F.col("first")), "equal", large=True)
    discard(repeated, again, first)
    return equal


def near_equal(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def leaders_in_buckets(chosen: DataFrame) -> DataFrame:
    """Verified links (a, b) between paragraphs that share a bucket.

    Rows: bucket, id, shingles. Each is compared with at most LEADERS of its bucket; a task
    holds these only.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in batches:
            found = []
            for key, i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.asarray(raw.values)
                if key != now:
                    now, leaders = key, []
                near = False
                for other, set_ in leaders:
                    if near_equal(own, set_):
                        found.append((i, other))
                        near = True
                        break
                if not near and len(leaders) < LEADERS:
                    leaders.append((i, own))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = chosen.select("bucket", "id", "shingles").repartition("bucket").sortWithinPartitions("bucket", "id")
    return rows.mapInArrow(compare, "a long, b long")


def unjoined_pairs(tile: np.ndarray, own: np.ndarray, other: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Nearly equal rows of one tile whose roots differ; a pair whose roots earlier ones have joined is left out.

    Sets that are equal enough share one of their rarest elements, the first n - ceil(PERCENT * n / 100) + 1.
    In a tile of two blocks, rows of one block are not compared: the block's own tile does so.
    """
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, key, count = np.unique(mix(np.concatenate(sets).view(np.uint64) ^ mix(tile.view(np.uint64))[row]), return_inverse=True, return_counts=True)
    order = np.lexsort((key, count[key], row))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = rank < (sizes + (-sizes * PERCENT // 100) + 1)[row]
    key, row = key[order][rare], row[rare]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    root, seen, found = root.copy(), set(), []
    at = np.arange(len(key))
    for distance in range(1, len(key)):
        at = at[at + distance < len(key)]
        at = at[key[at] == key[at + distance]]
        if not len(at):
            break
        a, b = row[at], row[at + distance]
        go = (root[a] != root[b]) & ((own[a] != own[b]) | (own[a] == other[a])) & (tile[a] == tile[b])
        go &= PERCENT * np.maximum(sizes[a], sizes[b]) <= 100 * np.minimum(sizes[a], sizes[b])
        for x, y in zip(a[go].tolist(), b[go].tolist(), strict=True):
            if root[x] != root[y] and (x, y) not in seen:
                seen.add((x, y))
                if near_equal(sets[x], sets[y]):
                    found.append((x, y))
                    root[root == root[y]] = root[x]
    return found


def links_left(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Verified links (a, b) between paragraphs that share a bucket and are of different components so far."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, 0):
            tile, own, other, root, ids = (np.asarray(run[c]) for c in ("tile", "own", "other", "root", "id"))
            pairs = unjoined_pairs(tile, own, other, root, [np.asarray(x.values) for x in run["shingles"]])
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[p[k]]) for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    known = sets.join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("id", F.coalesce("root", "id").alias("root"), F.size("shingles").alias("n"), "buckets")
    slim = stored(known.select("id", "root", "n", F.explode("buckets").alias("bucket")), "slim", large=True)
    totals = [F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.sum("n").alias("total")]
    mixed = slim.groupBy("bucket").agg(*totals).where("low < high")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    mixed = stored(mixed.select("bucket", blocks.alias("blocks")), "mixed")
    dealt = slim.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = stored(dealt.select(tile.alias("tile"), "own", "other", "root", "id"), "dealt", large=True)
    rows = dealt.join(sets.select("id", "shingles"), "id").select("tile", "own", "other", "root", "id", "shingles")
    found = stored(rows.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(compare, "a long, b long"), "left", large=True)
    discard(slim, dealt)
    return found


def paragraph_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, buckets and sorted shingles of the wanted paragraphs (doc_id, t, start, id, buckets), grouped by document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(0)):
                part = batch.slice(low, high - low)
                u = Units(part.column(0))
                a, b = u.lines
                where = {(o, s): k for k, (o, s) in enumerate(zip(u.of[a].tolist(), (u.start[a] - u.offsets[:-1][u.of[a]]).tolist(), strict=True))}
                grams = shingle_hashes(u.word_hash, SHINGLE)
                ids, buckets, sets = [], [], []
                for k, (t, wish) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if t != u.text_hash[k]:
                        continue
                    for w in wish:
                        at = where[k, w["start"]]
                        ids.append(w["id"])
                        buckets.append(w["buckets"])
                        sets.append(np.unique(grams[a[at] : b[at] - SHINGLE + 1]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), arrays(sets, np.int64)],
                    ["id", "buckets", "shingles"],
                )

    wish = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "id", "buckets")).alias("wish"))
    wish = stored(wish, "wish", large=True)
    some = met_by(docs, F.col("doc_id"), wish.select("doc_id"), "met").where("met")
    return some.join(wish, "doc_id").select("text", "t", "wish").mapInArrow(
        build, "id long, buckets array<long>, shingles array<long>"
    )


def near_copies(docs: DataFrame, lines: DataFrame, equal: DataFrame) -> DataFrame:
    """Paragraphs of a component of equal and nearly equal ones, but the first: PLACE, n, end, first."""
    ident = F.xxhash64(*PLACE)
    told = met_by(lines, ident, equal.select(ident), "again")
    alone = told.where("again").drop("again").join(equal.select(*PLACE), PLACE, "left_anti")  # one of each equal ones
    alone = told.where("NOT again").drop("again").unionByName(alone)
    alone = stored(alone.select(*PLACE, ident.alias("id"), "bands"), "alone", large=True)
    banded = alone.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(shared.select("bucket"), "shared", large=True)
    met = met_by(banded, F.col("bucket"), shared, "again").where("again").drop("again").join(shared, "bucket")
    buckets = stored(met.groupBy("id").agg(F.collect_list("bucket").alias("buckets")), "buckets", large=True)
    wanted = stored(alone.drop("bands").join(buckets, "id"), "wanted", large=True)
    discard(alone, buckets)
    sets = stored(paragraph_sets(docs, wanted), "paragraphs", large=True)
    discard(wanted)
    roots = components(leaders_in_buckets(sets.select(F.explode("buckets").alias("bucket"), "id", "shingles")))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links_left(sets, roots))
    same = equal.select(ident.alias("a"), F.xxhash64(*[f"first.{c}" for c in PLACE]).alias("b"))
    roots = components(stored(links.unionByName(same), "links", large=True))
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    told = met_by(lines, ident, roots.select("node").unionByName(roots.select(F.col("root").alias("node"))), "met")
    members = told.where("met").drop("met").withColumn("node", ident).join(rooted, "node")
    first = members.groupBy("root").agg(F.min(F.struct(*PLACE)).alias("first"))
    copies = members.join(first, "root").where(F.struct(*PLACE) != F.col("first")).select(*PLACE, "n", "end", "first")
    near = stored(copies, "near", large=True)
    discard(sets)
    return near


def runs_batch(u: Units, ids: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, more: list, names: list[str]) -> pa.RecordBatch:
    """RUNS and more columns; the last run has ``size`` words."""
    of = u.of[first]
    base = np.searchsorted(u.of, of)
    at = u.offsets[:-1][of]
    columns = [ids[of], u.text_hash[of], u.line[first].astype(np.int32), first - base, last - base, u.start[first] - at, u.end[last + size - 1] - at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *more)], ["doc_id", "t", "line", "low", "high", "start", "end", *names])


def single_runs(docs: DataFrame, wish: DataFrame) -> DataFrame:
    """Each run of the wanted pieces (doc_id, t, wish: low, high, gone): RUNS, gone, w (hash)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(1)):
                part = batch.slice(low, high - low)
                u = Units(part.column(1))
                base = np.searchsorted(u.of, np.arange(high - low))
                at, gone = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for k, (t, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    for w in wanted if t == u.text_hash[k] else ():
                        at.append(base[k] + np.arange(w["low"], w["high"] + 1))
                        gone.append(np.full(len(at[-1]), w["gone"]))
                first = np.concatenate(at)
                yield runs_batch(u, np.asarray(part.column(0)), first, first, RUN, [np.concatenate(gone), u.hashes(first, first + RUN)], ["gone", "w"])

    some = met_by(docs, F.col("doc_id"), wish.select("doc_id"), "met").where("met")
    rows = some.join(wish, "doc_id").select("doc_id", "text", "t", "wish")
    return rows.mapInArrow(build, f"{RUNS}, gone boolean, w long")


def repeated_runs(docs: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """Passages of RUN or more words of which each run also stands at a place before: PLACE, n, end, first.

    ``found``: all pieces. ``near``: removed paragraphs. What lies in them comes after all other places, so that no copy stays away for their sake.
    """
    place = F.struct("gone", "doc_id", "t", "low")
    often = stored(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "often", large=True)
    again = met_by(found, F.col("f"), often, "met").where("met").drop("met").join(often, "f", "left_semi")
    removed = stored(near.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "end")).alias("removed")), "removed")
    touched = F.exists("removed", lambda r: (r["start"] < F.col("end")) & (r["end"] > F.col("start")))
    again_ = again.join(removed, ["doc_id", "t"], "left").withColumn("gone", F.coalesce(touched, F.lit(False))).drop("removed")
    flagged = stored(again_, "flagged", large=True)
    kinds = flagged.groupBy("f", "h").agg(F.min(F.struct("gone", "doc_id", "t", "low", "high")).alias("one"))
    kinds = stored(kinds, "kinds", large=True)
    ends = F.struct("one.gone", "one.doc_id", "one.t", "one.low")
    copies = flagged.join(kinds, ["f", "h"]).where(place != ends).withColumn("of_doc_id", F.col("one.doc_id"))
    names = ["doc_id", "t", "line", "low", "high", "start", "end", "of_doc_id"]
    copies = stored(copies.select(*names), "copies", large=True)
    # anchors of several kinds of pieces: the piece of each kind that stays is compared run by run
    mixed = stored(kinds.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "mixed")
    wish = kinds.join(mixed, "f", "left_semi").select("one.*")
    wish = stored(wish.groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "high", "gone")).alias("wish")), "wish", large=True)
    discard(flagged, kinds)
    runs = stored(single_runs(docs, wish), "runs", large=True)
    discard(wish)
    often = runs.groupBy("w").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("w", "first")
    later = runs.join(stored(often, "first_runs", large=True), "w").where(place != F.col("first"))
    later = later.withColumn("of_doc_id", F.col("first.doc_id")).select(*names)
    order = Window.partitionBy("doc_id", "t").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = copies.unionByName(later).withColumn("new", F.when(F.col("low") <= reach + RUN, 0).otherwise(1))
    rows = rows.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    least = [F.min(c).alias(c) for c in ("line", "low", "start", "of_doc_id")]
    rows = rows.groupBy("doc_id", "t", "passage").agg(*least, F.max("high").alias("high"), F.max("end").alias("end"))
    inside = F.exists("removed", lambda r: (r["start"] <= F.col("start")) & (r["end"] >= F.col("end")))
    rows = rows.join(removed, ["doc_id", "t"], "left").where(~F.coalesce(inside, F.lit(False)))
    rows = rows.select(*PLACE, (F.col("high") - F.col("low") + RUN).alias("n"), "end", F.struct(F.col("of_doc_id").alias("doc_id")).alias("first"))
    passages = stored(rows, "passages", large=True)
    discard(runs, copies)
    return passages


#: The largest whole numbers stand for rows without doc_id, by hashes of their texts.
FIRST_KEY = (1 << 63) - (1 << 48)


def document_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or a number after all of them (from FIRST_KEY on) for a row without one; a document is a key and a text."""
    return F.coalesce(doc_id.cast("long"), F.lit(FIRST_KEY) + F.xxhash64(text).bitwiseAND(F.lit((1 << 48) - 1)))


def own_id(key: Column) -> Column:
    return F.when(key < FIRST_KEY, key)


def repeated_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What to remove, one row per span: doc_id, t, line, start, end, n_words, kind, of_doc_id, key.

    ``start`` and ``end`` are bytes of the document's UTF-8 text, ``t`` the hash of that text
    with A-Z lower-cased, ``of_doc_id`` the document whose copy stays; ``key`` is the document's ``document_key``.
    """
    own = docs.select(document_key(F.col(doc_id), F.col(text)).alias("doc_id"), F.col(text).alias("text"))
    found = stored(units(own), "units", large=True)
    lines = found.where("f IS NULL").withColumn("n", F.col("high") - F.col("low") + 1).drop("f", "low", "high")
    equal = later_copies(lines.drop("bands"))
    near = near_copies(own, lines, equal)
    runs = repeated_runs(own, found.where("f IS NOT NULL").drop("bands"), near)
    discard(found, equal)
    columns = [*PLACE, "n", "end", F.struct("first.doc_id").alias("first")]
    spans = [rows.select(*columns, F.lit(kind).alias("kind")) for kind, rows in (("paragraph", near), ("passage", runs))]
    return spans[0].unionByName(spans[1]).select(
        own_id(F.col("doc_id")).alias("doc_id"), "t", "line", "start", "end", F.col("n").alias("n_words"), "kind",
        own_id(F.col("first.doc_id")).alias("of_doc_id"), F.col("doc_id").alias("key"),
    )


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents (doc_id, text and more columns) with the spans (key, t, start, end) cut out of their texts.

    Documents that surely have none are not shuffled.
    """
    names, kinds = docs.columns, docs.schema
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, wish in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                raw = text.as_py()
                if raw is not None and wish:
                    data, offsets = buffer_of(pa.array([raw]))
                    t = int(RangeHash(lower_ascii(data))(offsets[:-1], offsets[1:]).view(np.int64)[0])
                    keep, last = [], 0
                    for a, b in sorted((w["start"], w["end"]) for w in wish if w["t"] == t):
                        keep.append(raw_slice(data, last, a))
                        last = max(last, b)
                    raw = "".join([*keep, raw_slice(data, last, len(data))])
                texts.append(raw)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    key, wanted, met = unused(docs, "key"), unused(docs, "wish"), unused(docs, "met")
    wish = spans.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("t", "start", "end")).alias(wanted))
    keyed = docs.withColumn(key, document_key(F.col("doc_id"), F.col("text")))
    told = met_by(keyed, F.col(key), spans.select("key"), met)
    changed = told.where(F.col(met)).join(wish, key, "left").select(*names, wanted).mapInArrow(cut, kinds)
    return told.where(~F.col(met)).select(*names).unionByName(changed)


def raw_slice(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().decode("utf-8", "replace") if b > a else ""
