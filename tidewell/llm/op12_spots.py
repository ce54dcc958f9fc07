"""Spot signatures of documents (operator 12): DataFrame functions only.

Common words are anchors. Each anchors a chain: the two content words that follow it, common words passed over. The
start of a text is an anchor, too, and so is every eighth content word after the last anchor, so that lists, junk
and other languages have spots as well. A spot's signature is a hash of anchor and chain, and a text's fingerprint its
sorted distinct signatures. The likeness of two fingerprints is their Jaccard similarity: the ratio of their sizes bounds
it from above, which parts sets by length, and only pairs that the bound leaves are intersected.

Words are runs of characters other than ASCII's that are neither letter nor digit, A-Z lower-cased. An edited text ends in
the first characters of the next document, in order of doc_id. Only keys, lengths and counts are put in order; a
text is moved once, a quarter of it again.

* Null text: empty. A text without words has one signature, its own hash; two empty texts have likeness 1.
* Rows without doc_id come first. Rows of one doc_id follow the SHA-256 of their texts. Of repeated rows, each is followed by
  the next of them and the last one by the next document. The last document is followed by the first, which may be itself.
* Very long texts are fingerprinted whole, in memory. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.op1_quality import let
from tidewell.llm.order import in_order, with_index
from tidewell.llm.tables import stored

#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to a in is that it for was on with be by as this are at from "
    "der die das und den von zu mit sich auf des für ist nicht im dem ein eine als "
    "le la les et un une du que pour est qui par dans sur pas au avec de en "
    "el los las y se del por no con su para es al lo"
).split()
#: Content words of a chain, and of a stretch without anchors.
CHAIN, STRETCH = 2, 8
#: What separates words, as a regular expression.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def hashed(text: Column) -> Column:
    """The first 60 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def spots(words: Column) -> Column:
    """Signatures, in the order of their spots, of texts with words."""
    common = lambda w: w.isin(*COMMON)
    anchors = F.concat(
        F.array(F.lit(-1)), F.filter(F.transform(words, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull())
    )
    found = F.struct(
        words.alias("words"), anchors.alias("anchors"), F.filter(words, lambda w: ~common(w)).alias("content"), F.size(words).alias("n")
    )
    return let(found, lambda x: F.flatten(F.transform(x["anchors"], lambda a, k: stretch(x, a, k))))


def stretch(x: Column, anchor: Column, k: Column) -> Column:
    """Signatures of the spots from the ``k``-th anchor to the next; before a spot there are its position + 1 - k content words."""
    last = F.coalesce(F.get(x["anchors"], k + 1), x["n"]) - 1
    word = F.when(anchor >= 0, F.get(x["words"], anchor)).otherwise("")
    at = F.sequence(anchor, last, F.lit(STRETCH))
    return F.transform(
        at,
        lambda p: hashed(
            F.concat_ws(" ", F.when(p == anchor, word).otherwise(""), F.array_join(F.slice(x["content"], p + 2 - k, CHAIN), " "))
        ),
    )


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text."""
    found = let(words_of(text), lambda w: F.when(F.size(w) > 0, spots(w)).otherwise(F.array(hashed(text))))
    return F.sort_array(F.array_distinct(found))


def fingerprint(found: Column) -> Column:
    """Signatures as text."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures; 0 without a comparison where their sizes show that it is below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(small < least * large, 0.0).otherwise(common / (small + large - common))


def row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per doc_id and text: how often it stands, its length, and the key and length of the one before it."""
    each = docs.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.max("n_chars").alias("n_chars"), F.count("*").alias("times")
    )
    ordered = in_order(each.withColumn("all", F.lit(0)), ["all", "doc_id", "digest"], "keys")
    indexed = stored(with_index(ordered, "all").select("key", "doc_id", "n_chars", "times", "i", "n"), "indexed")
    before = indexed.select(
        ((F.col("i") + 1) % F.col("n")).alias("i"), F.col("key").alias("key_before"), F.col("n_chars").alias("chars_before")
    )
    return indexed.drop("n").join(before, "i").drop("i")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with ``head``, the first characters of the next one that replace its last quarter, and that one's signatures.

    ``rows`` of ``times`` equal rows that share these.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    base = base.withColumn("key", row_key(F.col("doc_id"), F.col("digest")))
    links = stored(neighbours(base.select("key", "doc_id", "digest", F.length("text").cast("long").alias("n_chars"))), "links")
    own = base.groupBy("key").agg(F.first("text").alias("text")).join(links, "key")
    own = own.withColumn("own", signatures(F.col("text")))
    nexts = own.select(
        F.col("key_before").alias("key"), F.expr("left(text, cast(chars_before div 4 as int))").alias("head"), F.col("own").alias("next")
    )
    found = own.join(nexts, "key")
    followers = F.array(
        F.struct("head", "next", F.lit(1).cast("long").alias("rows")),
        F.struct(F.expr("left(text, cast(n_chars div 4 as int))").alias("head"), F.col("own").alias("next"), (F.col("times") - 1).alias("rows")),
    )
    wanted = F.slice(followers, 1, F.when(F.col("times") > 1, 2).otherwise(1))
    return found.select("doc_id", "n_chars", "text", "own", F.inline(wanted))


def spot_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, the edited text's, and the likeness to the edited text and to the next document."""
    text = F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), head)")
    edited = with_next(docs).withColumn("edited", text).drop("text", "head")
    found = edited.withColumn("changed", signatures(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        "rows",
    )
    return found.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows")
