"""Merkle manifest of a dataset (operator 11): aligned blocks keep each level of the tree as one hex string.

A leaf is the SHA-256 of a row's fields, each as ``length:value`` or ``-`` for null. The leaves of a language, in
order of doc_id, are cut into blocks of 256. A block holds each of its levels as the digests on end, 64 hex
characters each: a parent is the hash of 128 characters at a fixed place, and the characters beside a node are its
sibling. Blocks have 2**8 leaves, so that pairs never cross them; their roots are the leaves of the next
round, and the languages' roots those of the last one. No group of more than 256 nodes comes to one task.

* Null fields, null doc_ids and a null language are hashed as ``-``; rows without doc_id come first in their
  language, and are never tampered with. A null language comes before all others, the empty one after it.
* Rows that share language and doc_id follow their leaf hashes; repeated rows are leaves of their own.
* n_chars is null after tampering if it has no successor. A language of one row has that leaf as its subroot; one
  language alone has its subroot as the root. Empty table: empty result. Extra columns are ignored.
* Very long texts are hashed in the scan; after it a row has a few hundred bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.order import in_order, with_index
from tidewell.llm.tables import stored

#: Leaves of a block, two to the power of its levels.
LEVELS = 8
BLOCK = 1 << LEVELS

#: The level above the level ``s``: every 128 characters, the last run fewer, become their hash.
PARENTS = "array_join(transform(sequence(0, cast((length({s}) - 1) div 128 as int)), j -> sha2(substring({s}, j * 128 + 1, 128), 256)), '')"
#: What stands before and after node ``at >> l`` in its pair, for each level below the block's root.
FLANKS = """
transform(slice(levels, 1, size(levels) - 1), (s, l) -> named_struct(
  'before', if(shiftright({at}, l) % 2 = 1, substring(s, (shiftright({at}, l) - 1) * 64 + 1, 64), ''),
  'after', if(shiftright({at}, l) % 2 = 0, substring(s, (shiftright({at}, l) + 1) * 64 + 1, 64), '')))
"""
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``key`` (the language, null first), doc_id, the leaf's digest, and the tampered leaf where there is one."""
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("key"),
        "doc_id",
        leaf(F.col("n_chars")).alias("digest"),
        F.when(tampered, leaf(F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered"),
    )


def blocks_of(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block of ``nodes`` (key, i, n, digest): its members in order and its levels, leaves first.

    A group of several blocks takes each of them through all levels; one of a single block ends at its root.
    """
    rows = F.sort_array(F.collect_list(F.struct("i", "digest", *payload)))
    grouped = nodes.groupBy("key", F.expr(f"i div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), rows.alias("rows"))
    steps = F.expr(f"if(n > {BLOCK}, {LEVELS}, if(n = 1, 0, length(bin(n - 1))))")
    up = "aggregate(slice(sequence(1, {n}), 1, steps), array(base), (acc, _) -> array_append(acc, {up}))"
    return (
        grouped.withColumn("base", F.expr("array_join(transform(rows, r -> r.digest), '')"))
        .withColumn("steps", steps)
        .withColumn("levels", F.expr(up.format(n=LEVELS, up=PARENTS.format(s="element_at(acc, -1)"))))
        .drop("base", "steps")
    )


def placed(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """The blocks of ``nodes`` with ``path``, the steps from the block's root to the group's, and that root as ``top``."""
    blocks = stored(blocks_of(nodes, payload), "blocks")
    own = blocks.withColumn("own", F.element_at("levels", -1))
    upper = own.where(F.col("n") > BLOCK).select(
        "key", F.col("block").alias("i"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("own").alias("digest")
    )
    if upper.isEmpty():
        return own.withColumns({"path": F.array().cast(STEPS), "top": F.col("own")}).drop("own")
    above = members(placed(upper, []), []).select("key", F.col("i").alias("block"), F.col("path").alias("above"), F.col("top").alias("above_top"))
    return own.join(above, ["key", "block"], "left").select(
        "key", "block", "n", "rows", "levels",
        F.coalesce("above", F.array().cast(STEPS)).alias("path"), F.coalesce("above_top", "own").alias("top"),
    )


def members(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """One row per node of ``placed`` blocks, with its whole path to the group's root."""
    flanks = FLANKS.format(at=f"cast(r.i % {BLOCK} as int)")
    kept = "".join(f", '{c}', r.{c}" for c in payload)
    each = f"transform(rows, r -> named_struct('i', r.i, 'digest', r.digest{kept}, 'path', concat({flanks}, path)))"
    carried = [c for c in blocks.columns if c not in ("block", "n", "rows", "levels", "path")]
    return blocks.select(*carried, F.expr(f"inline({each})"))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and the root folded from its (tampered) leaf."""
    ordered = in_order(leaves(docs), ["key", "doc_id", "digest"], "leaves")
    blocks = placed(with_index(ordered, "key"), ["doc_id", "tampered"])
    roots = blocks.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), F.col("top").alias("digest")).distinct()
    langs = members(placed(with_index(in_order(roots, ["key", "lang_key"], "roots"), "key"), ["lang_key"]), ["lang_key"])
    langs = langs.select(F.col("lang_key").alias("key"), F.col("path").alias("lang_path"), F.col("top").alias("root"))
    whole = blocks.join(langs, "key").withColumn("path", F.concat("path", "lang_path")).drop("lang_path")
    fold = "aggregate(path, coalesce(tampered, digest), (d, s) -> sha2(concat(s.before, d, s.after), 256))"
    return (
        members(whole, ["doc_id", "tampered"])
        .withColumn("folded_root", F.expr(fold))
        .select(
            "doc_id",
            F.col("digest").alias("leaf"),
            F.col("top").alias("subroot"),
            "root",
            F.expr("sha2(array_join(transform(path, s -> concat(s.before, s.after)), ''), 256)").alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )
