"""Block-structured text logs to rows, with where in its block each line stood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import beside, running_sums
from tidewell.sources.shared import kept

HEADER = r"(?i)^(?:##\s*)?BASELINE-SHUFFLE obs :: (\S+ \S+) UTC"
#: Fixed line formats of the logs.
NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
COMPARISON = rf"(?i)(surface-mid|mid-residue|surface-residue)\s+real={NUMBER}\s*\|\s*shuffle={NUMBER}\s*\|\s*delta={NUMBER}"
METRICS = r"(?i)\*\*metrics:\*\*"
#: Each value of a metrics line is looked for by itself.
METRIC_VALUES = {"h_raw": rf"(?i)H\(t\)\s*=\s*{NUMBER}", "phi_raw": rf"(?i)phi\(t\)\s*=\s*{NUMBER}", "d_raw": rf"(?i)\bD\(t\)\s*=\s*{NUMBER}"}


#: What stands before each entry of an observation log, and its parts: fixed formats.
ENTRY = "\n## obs :: "
ENTRY_TIME, MOOD, FLAG = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\s*UTC", r"\*\*surface mood:\*\*\s*(.+)", r"(?U)\*\*anomaly flag:\*\*\s*(\w+)"


def read_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, record_no, offset, record) of text files cut at ``separator``, numbered from 0 in each file; offsets are those of records in bytes.

    Spark splits files by size, wherever that is, and a record belongs to the split in which it begins, so one file is many tasks.
    Numbers and offsets are sums within splits, plus what a file's earlier splits hold, one row each.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("record")
    )
    rows = kept(rows, "records")
    amounts = {"record_no": F.lit(1).cast("long"), "offset": F.octet_length("record").cast("long") + len(separator.encode())}
    slim = running_sums(rows.withColumn("size", amounts["offset"]).drop("record"), ["file"], ["split", "at"], {"record_no": amounts["record_no"], "offset": F.col("size")}, bucket=F.col("split"))
    placed = slim.select("at", (F.col("record_no") - 1).alias("record_no"), (F.col("offset") - F.col("size")).alias("offset"))
    return rows.join(placed, "at").select("file", "record_no", "offset", "record")


def read_lines(spark: SparkSession, path: str, source: str = "file") -> DataFrame:
    """(source, line_no, line) of log files, in as many tasks as their size asks for."""
    rows = read_records(spark, path, "\n")
    return rows.select(F.col("file").alias(source), F.col("record_no").alias("line_no"), F.regexp_replace("record", "\r$", "").alias("line"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of observation log files: file, entry, offset, time, mood, flag. What stands before a file's first entry is none."""
    rows = read_records(spark, path, ENTRY)
    start = ENTRY.removeprefix("\n")
    first = (F.col("record_no") == 0) & F.col("record").startswith(start)
    body = F.when(first, F.substr("record", F.lit(len(start) + 1))).when(F.col("record_no") > 0, F.col("record"))
    return entry_parts(rows.withColumn("body", body).where("body IS NOT NULL"), ["file", F.col("record_no").alias("entry"), "offset"])


def entry_parts(rows: DataFrame, keys: list) -> DataFrame:
    """Time, mood (the rest of its line) and flag (one word) of entries; what has no time in UTC is no entry."""
    grab = lambda pattern: F.nullif(F.trim(F.regexp_extract("body", pattern, 1)), F.lit(""))
    return rows.select(*keys, grab(ENTRY_TIME).try_cast("timestamp_ntz").alias("ts"), grab(MOOD).alias("mood"), grab(FLAG).alias("flag")).where("ts IS NOT NULL")


def lines(texts: DataFrame, source: str, text: str) -> DataFrame:
    """(source, line_no, line) of whole texts."""
    return texts.select(source, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def blocks(rows: DataFrame, source: str, header: str = HEADER) -> DataFrame:
    """Adds ``block`` (headers so far) and ``block_time``; lines before the first header go.

    Headers are counted within ranges of lines, and of a source only the ranges are put in order.
    """
    headed = rows.withColumn("_head", F.col("line").rlike(header))
    marked = running_sums(headed.withColumn("line_no", F.col("line_no").cast("long")), [source], ["line_no"], {"block": F.col("_head").cast("long")}).where("block > 0")
    times = marked.where("_head").groupBy(source, "block").agg(F.max(F.regexp_extract("line", header, 1)).try_cast("timestamp").alias("block_time"))
    return beside(marked, times, [source, "block"], ["block_time"]).drop("_head")


def comparisons(rows: DataFrame, source: str) -> DataFrame:
    """Comparison lines: pair, real, shuffle, delta."""
    value = lambda i: F.regexp_extract("line", COMPARISON, i).try_cast("double")
    return rows.where(F.col("line").rlike(COMPARISON)).select(
        source, "block", "block_time", "line_no", F.lower(F.regexp_extract("line", COMPARISON, 1)).alias("pair"), value(2).alias("real"), value(3).alias("shuffle"), value(4).alias("delta")
    )


def why_untrusted(line: Column) -> Column:
    """Reason in fixed priority: awaiting, first run, H not available, carried over."""
    return (
        F.when(line.rlike("(?i)awaiting"), "awaiting").when(line.rlike("(?i)first run"), "first_run").when(line.rlike(r"(?i)H\(t\)\s*=\s*N/A"), "not_available").otherwise("carried")
    )


def quarantined_metrics(rows: DataFrame, source: str) -> DataFrame:
    """Metric lines, kept apart: their values are not the block's. Position is before or after the block's first comparison."""
    seen = F.max(F.col("line").rlike(COMPARISON).cast("int")).over(
        Window.partitionBy(source, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = [F.regexp_extract("line", pattern, 1).try_cast("double").alias(name) for name, pattern in METRIC_VALUES.items()]
    found = rows.withColumn("position", F.when(seen == 1, "after").otherwise("before")).where(F.col("line").rlike(METRICS))
    return found.select(source, "block", "block_time", "line_no", "position", why_untrusted(F.col("line")).alias("reason"), *values)


def anomalies(quarantine: DataFrame) -> DataFrame:
    return quarantine.where("reason = 'first_run' AND h_raw IS NOT NULL")


def wide(found: DataFrame, source: str, pairs: list[str]) -> DataFrame:
    """One row per block with each pair's first shuffle distance."""
    return found.groupBy(source, "block", "block_time").pivot("pair", pairs).agg(F.min_by("shuffle", "line_no"))


def observation_entries(texts: DataFrame, source: str, text: str) -> DataFrame:
    """Entries of observation logs that are rows of whole texts: entry, time, mood, flag."""
    parts = texts.select(source, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), ENTRY)).alias("entry", "body")).where("entry > 0")
    return entry_parts(parts, [source, "entry"])
