"""The test tables in the roles of observations, vectors and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.stats import present
from tidewell.operators import lexical
from tidewell.operators.vectors import as_doubles
from tidewell.sources.shared import kept

#: The window is cut in two periods here.
CUT = "2024-01-16 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_period() -> Column:
    return F.col("ts") < F.lit(CUT).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a value of each series ``event_type`` at ``ts``, in one of two periods."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", present(F.col("value")).alias("value"))
    return rows.withColumn("period", F.when(first_period(), "p1").otherwise("p2"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles, in order of vec_id, with a layer for label % 3 and a block of 30 rows."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("v"))
    return rows.where("v IS NOT NULL").withColumns({"layer": F.pmod("label", F.lit(3)), "block": F.floor(F.col("vec_id") / 30)})


def midpoint(df: DataFrame, column: str) -> Column:
    """Half way between the least and the greatest value, as a subquery of one row: the second half begins there."""
    return df.agg((F.min(column) + F.max(column) + 1) / 2).scalar()


def token_maps(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """All tokens of each document (or the k most frequent) with their counts, by language; documents without words are left out.

    The maps are counted once and kept, as all that builds on them names them several times.
    """
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    return kept(docs.select("doc_id", "lang", lexical.token_map(F.col("text"), k).alias("tokens")), "token_maps")
