"""N-gram Jaccard join (operator 7): size-banded tiles with hashed bitmaps, then exact intersection.

Texts have A-Z lower-cased; words are runs of characters other than space and U+0009..U+000D.
A document's set holds the 64-bit hashes of its distinct SIZE-word shingles (with fewer words,
of the whole sequence). Two documents link when PERCENT * union <= 100 * intersection.

1. Documents with equal sets are one class, and one of them stands for it.
2. A set of n elements overlaps a linked one in at least ``needed`` = ceil(PERCENT * n / 100).
   So the first SHARED common elements, in the order of hashes, lie among the first
   n - needed + SHARED of both sets. Sets with fewer elements there that any other class has
   among its own can link with none and are dropped. Counts use the upper 32 bits of the
   hashes, which can only count too much; two elements of a set that fall together there are
   allowed for by one element less.
3. Tiles on one common element compare each set with a few leaders and link what is
   equal enough. These links only save work: they merge most classes before the next step.
4. Tiles on a common element (its rarest first, without the last SHARED - 1, which the lemma
   spares) compare the bitmaps of sets of different components and of sizes within one band of
   each other: each differing element flips one bit, so the differing bits bound the overlap
   from above. Tiles that hold one component alone have nothing left to find. All tiles with
   the same least set are compared in one task, where a set's bitmap comes once and a pair is
   found once; there are as many such tiles as a set has tiles. Tiles of more than TILE sets
   are dealt to pairs of blocks: the sets of the largest component to blocks that meet
   only those of other sets, and these to pairs of blocks among themselves.
   A first pass takes a spanning forest of what the bounds let pass, so that most links are
   found by few pairs; the second one takes all pairs of components that still differ.
5. Pairs that the bound lets pass are intersected exactly; the links make the components.

* Null and empty texts have empty sets and stay alone. Empty table: empty result.
* Rows that share a doc_id are judged each. Rows without a doc_id link like any other; their
  component_id is the least doc_id among the rows that links reach, null if none has one.
* Ties need no order: components do not depend on it. Extra columns are ignored.
* A text is handled whole in one task, with some 100 bytes of arrays for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import arrays, whole_runs
from tidewell.llm.bytes import RangeHash, buffer_of, groups, lower_ascii, mix, shingle_hashes, words
from tidewell.llm.components import components
from tidewell.llm.tables import discard, met_by, stored

SIZE, PERCENT, SHARED, TILE, LEADERS = 4, 85, 24, 2048, 32


def text_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for low, high in groups(texts):
        data, offsets = buffer_of(texts.slice(low, high - low))
        start, end, of = words(lower_ascii(data), offsets)
        hashes = RangeHash(lower_ascii(data))(start, end)
        grams = shingle_hashes(hashes, size)
        bounds = np.searchsorted(of, np.arange(high - low + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield shingle_hashes(hashes[a:b], b - a) if b > a else grams[:0]


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n elements with any set that it links with."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(elements: np.ndarray) -> bytes:
    """Parity of the number of elements that hash to each of 2 to 4 bits an element.

    Positions are low bits of a hash, so the halves of a bitmap fold to the bitmap of half its length.
    """
    log_bits = max(6, (2 * len(elements) - 1).bit_length())
    at = (mix(elements ^ np.uint64(7)) & np.uint64((1 << log_bits) - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=1 << log_bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def upper_half(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signature(elements: np.ndarray) -> int:
    return int(mix(elements ^ np.uint64(99)).sum(dtype=np.uint64).view(np.int64))


def heads(docs: DataFrame, size: int, percent: int, shared: int) -> DataFrame:
    """Per row: doc_id, t (hash of the text), the size and signature ``c`` of its set, and its first elements."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, first = [], [], []
            for x in text_sets(batch.column(2), size):
                n.append(len(x))
                c.append(signature(x))
                first.append(upper_half(x[: len(x) - needed(len(x), percent) + shared]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(c, pa.int64()), arrays(first, np.int32)],
                ["doc_id", "t", "n", "c", "first"],
            )

    return docs.mapInArrow(take, "doc_id long, t long, n long, c long, first array<int>")


def may_link(own: DataFrame, percent: int, shared: int) -> DataFrame:
    """Row keys, one for each class that shares enough of its first elements with others, and these elements."""
    chosen = own.groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", "t").alias("row"), "n", "first")).alias("one")).select("one.*")
    postings = chosen.select("row", "n", F.explode("first").alias("h"))
    counts = postings.groupBy("h").agg(F.count("*").cast("int").alias("in_all")).where("in_all > 1")
    counts = stored(counts, "counts", large=True)  # joined as a table of its own, a frequent element's rows can be split
    kept = postings.select("h", "row", F.col("n").cast("int").alias("n")).join(counts, "h")
    common = kept.groupBy("row").agg(F.min("n").alias("n"), F.collect_list(F.struct("in_all", "h")).alias("common"))
    least = F.least(F.lit(shared), F.ceil(F.col("n") * percent / 100)) - 1
    return common.where(F.size("common") >= least).select("row", "common")


def whole_sets(docs: DataFrame, chosen: DataFrame, size: int, percent: int, shared: int) -> DataFrame:
    """Per chosen class: c, n, elements, bits, and the common elements (in_all, h) of its tiles.

    Rows that share a row key may come along with it; they are sets of documents all the same.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in groups(batch.column(0)):
                part = batch.slice(low, high - low)
                sets = list(text_sets(part.column(0), size))
                keys = []
                for x, common in zip(sets, part.column(1), strict=True):
                    flat = common.values
                    count, h = np.asarray(flat.field(0)), np.asarray(flat.field(1))
                    mine = np.isin(h, upper_half(x))
                    found = np.unique(np.stack([count[mine], h[mine]], axis=1), axis=0)
                    spared = min(shared, needed(len(x), percent)) - 2
                    keys.append(found[: len(found) - max(0, spared)].astype(np.int32))
                flat = np.concatenate([*keys, np.zeros((0, 2), np.int32)])
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["in_all", "h"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([signature(x) for x in sets], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        arrays([x.view(np.int64) for x in sets], np.int64),
                        pa.array([bitmap(x) for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    ["c", "n", "elements", "bits", "keys"],
                )

    schema = "c long, n long, elements array<long>, bits binary, keys array<struct<in_all:int,h:int>>"
    some = met_by(docs, F.coalesce("doc_id", "t"), chosen.select("row"), "met").where("met")
    again = some.withColumn("row", F.coalesce("doc_id", "t")).join(chosen, "row").dropDuplicates(["row", "t"])
    return again.select("text", "common").mapInArrow(build, schema).where("n > 0")


def leader_links(sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links found by comparing the sets of a tile with at most LEADERS of them. Memory: the leaders."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in batches:
            found = []
            for t, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.asarray(raw.values).view(np.uint64)
                if t != now:
                    now, leaders = t, []
                for other, elements in leaders:
                    small, large = sorted((len(own), len(elements)))
                    if percent * large <= 100 * small and linked(own, elements, percent):
                        found.append((c, other))
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((c, own))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    by_hash = F.array_sort(F.transform("keys", lambda k: F.struct(k["h"].alias("h"), k["in_all"].alias("in_all"))))
    keyed = sets.withColumn("key", F.explode(F.slice(by_hash, 1, 1)))
    part = F.pmod(F.xxhash64("c"), F.ceil(F.col("key.in_all") / tile).cast("long"))
    rows = keyed.select(F.xxhash64("key.h", part).alias("tile"), "c", "elements")
    return rows.repartition("tile").sortWithinPartitions("tile", "c").mapInArrow(compare, "a long, b long")


class Forest:
    """Components of a batch as numbered labels, merged by the pairs that are taken."""

    def __init__(self, root: np.ndarray) -> None:
        names, self.label = np.unique(root, return_inverse=True)
        self.parent = list(range(len(names)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def take(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs join two components that earlier ones have not joined."""
        kept = []
        for k, (x, y) in enumerate(zip(self.label[a].tolist(), self.label[b].tolist(), strict=True)):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[y] = x
                kept.append(k)
        if kept:
            self.label = np.array([self.find(x) for x in range(len(self.parent))])[self.label]
        return np.array(kept, np.int64)


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes: longer ones are folded, half upon half."""
    out = np.zeros((len(bits), width), np.uint8)
    for k, raw in enumerate(bits):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def pairs_within(rows: dict[str, np.ndarray], tile: np.ndarray, at: np.ndarray, bits: list[bytes], percent: int, forest: bool) -> np.ndarray:
    """Pairs of rows that share a tile and are of different components, and that sizes and bitmaps cannot exclude.

    ``at``: the row of each entry of ``tile``, sorted by group and tile. All tiles are compared at once,
    neighbours at distance 1, 2, ... Result: two rows and the least of the tiles that they share here.
    ``forest``: pairs that only join what other pairs have joined are left out.
    """
    n, width = rows["n"], np.array([len(x) for x in bits])
    span = 1 << math.ceil(math.log2(100 / percent))
    found = [np.zeros((3, 0), np.int64)]
    group = rows["g"]
    trees = Forest(rows["root"])
    for w in np.unique(width):
        inside = (width >= w) & (width <= w * span)
        wide = np.zeros((len(bits), max(1, w // 8)), np.uint64)
        wide[inside] = folded([x for x, ok in zip(bits, inside.tolist(), strict=True) if ok], int(w))
        use = inside[at]
        order = np.lexsort((at[use], tile[use], group[at[use]]))
        t, r = tile[use][order], at[use][order]
        k = np.arange(len(t))
        for distance in range(1, len(t)):
            k = k[k + distance < len(t)]
            k = k[(t[k] == t[k + distance]) & (group[r[k]] == group[r[k + distance]])]
            if not len(k):
                break
            i, j = r[k], r[k + distance]
            go = (trees.label[i] != trees.label[j]) & (np.minimum(width[i], width[j]) == w)
            go &= percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
            go &= ~rows["two"][i] | (rows["own"][i] != rows["own"][j])
            i, j, h = i[go], j[go], t[k[go]]
            differ = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1).astype(np.int64)
            total = n[i] + n[j]
            most = np.minimum((total - differ) // 2, np.minimum(n[i], n[j]))
            go = 100 * most >= percent * (total - most)
            i, j, h = i[go], j[go], h[go]
            if forest and len(i):
                kept = trees.take(i, j)
                i, j, h = i[kept], j[kept], h[kept]
            found.append(np.stack([np.minimum(i, j), np.maximum(i, j), h]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
    return pairs[:, new]


def mixed_tiles(sets: DataFrame, roots: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """The sets with their roots, and where those in tiles of several components go: g (group), tile (its element), c, own, two."""
    known = sets.select("c", "n", "bits", "keys").join(roots.withColumnRenamed("node", "c"), "c", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "c")), "known", large=True)
    slim = known.select("c", "root", F.explode("keys.h").alias("h"))
    by_root = slim.groupBy("h", "root").agg(F.count("*").alias("size"), F.min("c").alias("low"))
    totals = [F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("top"), F.min("low").alias("low"), F.count("*").alias("roots")]
    mixed = stored(by_root.groupBy("h").agg(*totals).where("roots > 1").drop("roots"), "mixed", large=True)
    met = slim.join(mixed, "h")
    small = met.where(F.col("size") <= tile).select(F.col("low").alias("g"), F.col("h").cast("long").alias("tile"), "c", F.lit(0).alias("own"), F.lit(False).alias("two"))
    large = met.where(F.col("size") > tile).withColumn("major", F.col("root") == F.col("top.root"))
    large = large.withColumn("p", F.ceil(F.col("top.size") / tile).cast("int")).withColumn("q", F.ceil((F.col("size") - F.col("top.size")) / tile).cast("int"))
    own = F.pmod(F.xxhash64("c"), F.when(F.col("major"), F.col("p")).otherwise(F.col("q"))).cast("int")
    large = large.withColumn("own", own)
    # blocks of the largest component are numbered from -1 down, those of the others from 0 up
    mine = F.when(F.col("major"), -1 - F.col("own")).otherwise(F.col("own"))
    upto = F.sequence(F.lit(0), F.col("q") - 1)
    others = F.when(F.col("major"), upto).otherwise(F.concat(F.sequence(-F.col("p"), F.lit(-1)), upto))
    large = large.withColumn("own", mine).withColumn("other", F.explode(others))
    where = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other"))
    large = large.select(where.alias("g"), F.col("h").cast("long").alias("tile"), "c", "own", (F.col("own") != F.col("other")).alias("two"))
    return known, stored(small.unionByName(large), "met", large=True)


def candidate_pairs(sets: DataFrame, roots: DataFrame, percent: int, forest: bool, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet in a tile and pass the bounds.

    ``forest``: only such that join what no other pair of the same task has joined.
    Otherwise a pair is given in one task, that of the least element for which both sets have a tile.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, 0):
            rows = {x: np.asarray(part[x]) for x in ("g", "c", "n", "root", "own", "two")}
            tiles = part["tiles"].combine_chunks()
            sizes = np.asarray(pc.list_value_length(tiles))
            at = np.repeat(np.arange(len(sizes)), sizes)
            a, b, h = pairs_within(rows, np.asarray(tiles.flatten()), at, part["bits"].to_pylist(), percent, forest)
            if not forest and len(a):
                keys = {k: frozenset(part["keys"][k].as_py()) for k in np.unique([a, b]).tolist()}
                first = [min(keys[x] & keys[y]) == z for x, y, z in zip(a.tolist(), b.tolist(), h.tolist(), strict=True)]
                a, b = a[first], b[first]
            yield pa.RecordBatch.from_arrays([pa.array(rows["c"][a]), pa.array(rows["c"][b])], ["a", "b"])

    known, met = mixed_tiles(sets, roots, tile)
    gathered = met.groupBy("g", "c", "own", "two").agg(F.collect_list("tile").alias("tiles"))
    keys = F.array().cast("array<int>") if forest else F.col("keys.h")
    rows = gathered.join(known.select("c", "n", "root", "bits", keys.alias("keys")), "c")
    rows = rows.select("g", "c", "n", "root", "own", "two", "bits", "tiles", "keys")
    pairs = rows.repartition("g").sortWithinPartitions("g", "c").mapInArrow(compare, "a long, b long")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "pairs", large=True)
    discard(known, met)
    return pairs


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are equal enough, by intersection of sorted arrays."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (
        met_by(sets.select(F.col("c").alias(side), F.col("elements").alias(name)), F.col(side), pairs.select(side), "met").where("met").drop("met")
        for side, name in (("a", "x"), ("b", "y"))
    )
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def jaccard_join(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    shared: int = SHARED,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach), t and root.

    ``t`` is the hash of the text; ``root`` names the component, also where it holds no doc_id; null for empty sets.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = stored(heads(own, size, percent, shared), "heads", large=True)
    classes = found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    chosen = stored(may_link(found.where("n > 0"), percent, shared), "chosen", large=True)
    sets = stored(whole_sets(own, chosen, size, percent, shared), "sets", large=True)
    links = leader_links(sets, percent)
    for forest in (True, False):
        roots = components(links)
        links = exact_links(candidate_pairs(sets, roots, percent, forest), sets, percent)
        links = stored(both_links(roots, links), "links", large=True)
    roots = components(links)
    discard(chosen, sets)
    slim = found.select("doc_id", "t", "n", "c")
    named = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "doc_id", F.coalesce("root", "c").alias("root")
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    labels = stored(named.join(least, "root").select("c", "root", "least"), "labels")
    return slim.join(labels, "c", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "t",
        "root",
    )


def both_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
