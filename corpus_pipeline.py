"""The corpus pipeline: quality rules, near-duplicate join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of documents. Rows are documents; rows that share a doc_id and a
text count as one document for the stages that remove copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.op1_quality import quality_rules
from tidewell.llm.op3_packing import best_fit_packing
from tidewell.llm.op6_substring import repeated_paragraphs, without_spans
from tidewell.llm.op7_jaccard import jaccard_join
from tidewell.llm.tables import stored, unused


def same_documents(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that share doc_id, null or not, and text with a row of ``found`` (doc_id, t), or those that do not."""
    doc_id, t = unused(docs, "_id"), unused(docs, "_t")
    named = found.select(F.col("doc_id").alias(doc_id), F.col("t").alias(t))
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(t)), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    Null and empty texts fail the base rules. Rows that share a doc_id and a text are judged each with its own
    source and stay if one of them is kept. Null ids take part. Extra columns stay. Empty table: empty.
    """
    kept = quality_rules(docs).where("kept").select("doc_id", "t").distinct()
    return same_documents(docs, kept, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the least doc_id.

    Links are those of operator 7 at five words and a Jaccard similarity of 0.8. Rows without a doc_id link, too,
    and stay only where no row of their group has one; ties go to the least hash of the text. Of rows that share
    doc_id and text, one stays. Null and empty texts link with nothing. Extra columns stay. Empty table: empty.
    """
    found = jaccard_join(docs, size=5, percent=80).select("doc_id", "t", "root")
    found = stored(found, "found", large=True)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("one")).select("one.doc_id", "one.t")
    stays = stored(least.unionByName(found.where("root IS NULL").select("doc_id", "t").distinct()), "stays", large=True)
    repeated = stored(found.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t"), "repeated")
    kept = same_documents(docs, stays, "left_semi")
    if repeated.isEmpty():
        return kept
    once = same_documents(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return same_documents(kept, repeated, "left_anti").unionByName(once)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut out of all documents but the first; emptied ones go.

    Documents with null or empty texts go as well. Rows without a doc_id come after all others; rows that share a doc_id, or have none,
    and a text are one document and cut alike. Extra columns stay; n_chars, if it is there, is counted anew. Empty table: empty.
    """
    spans = stored(repeated_paragraphs(docs).select("key", "t", "start", "end"), "spans", large=True)
    cut = without_spans(docs, spans).where(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "")
    return cut.withColumns({c: F.length("text").cast(kind) for c, kind in docs.dtypes if c == "n_chars"})


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, null texts and ids included, placed in sequences of 2048 tokens; see operator 3."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]

#: MinHash buckets and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
