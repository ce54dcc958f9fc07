"""Tables: reading the inputs, and cutting lineage through shared storage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table of keys (``met_by``): so many for a key, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none, as in tests, a temporary folder is made; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = getattr(spark, "_tidewell_shared", None) or tempfile.mkdtemp(prefix="spark-tidewell-")
        spark._tidewell_shared = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *, large: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then start from files that survive a lost executor, and a table that is
    used twice is computed once. ``large``: the shuffles behind it are large, so Spark is
    asked to clean up what nothing refers to any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        release_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what was built on them is stored itself."""
    for table_ in tables:
        spark = table_.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_._tidewell_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Collect garbage, upon which Spark's cleaner removes shuffle files of finished jobs.

    Spark does so itself when the driver's heap fills, or every ``spark.cleaner.periodicGC.interval``.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def met_by(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean column ``name``: false only where no row of ``keys`` (one column) equals ``key``, which is of the same type.

    A join with ``keys`` then shuffles the rows that may find a partner, and not the whole table. The keys' hashes set
    bits in a table of bounded size, which is broadcast in words of 64 bits (4 MB at most); keys beyond that make it let more rows pass.
    """
    bits = min(MOST_BITS, max(1 << 10, KEY_BITS * keys.count()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slots = keys.select(slot(F.col(keys.columns[0])).alias("slot"))
    word, mask = unused(df, "word"), unused(df, "mask")
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    words = slots.groupBy(F.expr("slot div 64").alias(word)).agg(F.bit_or(bit).alias(mask))
    at = slot(key)
    found = df.withColumn(name, at).join(F.broadcast(words), F.floor(at / 64) == F.col(word), "left")
    met = F.coalesce(F.getbit(F.col(mask), (F.col(name) % 64).cast("int")) == 1, F.lit(False))
    return found.withColumn(name, met).drop(word, mask)
