"""A total order of rows over range partitions: positions, and indices within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.tables import stored

#: ``pos`` holds the partition above so many bits, and the row's number in it below.
PART_BITS = 33


def part_of(pos: Column) -> Column:
    return F.shiftright(pos, PART_BITS).cast("int")


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` written in the order of ``keys`` (nulls first), with ``pos``, which grows along it.

    Partitions are ranges of the keys; equal rows are told apart by where they were read, so that
    any number of them spreads over partitions.
    """
    at = rows.withColumn("row_at", F.monotonically_increasing_id())
    by = [*keys, "row_at"]
    ranged = at.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ranged.drop("row_at").withColumn("pos", F.monotonically_increasing_id()), name)


def with_index(ordered: DataFrame, group: str) -> DataFrame:
    """Adds ``i``, the row's index within its group from 0 on, and ``n``, the group's rows.

    The order must have the (non-null) group as its first key: then a group's rows in a partition are
    consecutive, and only one count for each partition and group is put in order.
    """
    ordered = ordered.withColumn("part", part_of(F.col("pos")))
    counts = ordered.groupBy("part", group).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_here"))
    along = Window.partitionBy(group).orderBy("part")
    before = F.sum("n_here").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_here")
    begins = counts.withColumns({"before": before, "n": F.sum("n_here").over(Window.partitionBy(group))})
    out = ordered.join(begins.drop("n_here"), ["part", group])
    return out.withColumn("i", F.col("before") + F.col("pos") - F.col("first_pos")).drop("part", "before", "first_pos")
