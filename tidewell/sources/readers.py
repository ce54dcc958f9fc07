"""Typed reading of observation and state files, and small exports."""

from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.ingest import numeric, utc_timestamp


def read_observations(spark: SparkSession, path: str, metrics: list[str], time: str | list[str] = "Timestamp_UTC", fallback: str | None = None) -> DataFrame:
    """CSV with a header, possibly a byte-order mark and comment lines: doubles and a UTC time ``ts``.

    Of several names of ``time`` the first that is there is used. Where ``path`` does not exist, ``fallback`` is read, with a warning.
    """
    try:
        spark.read.text(path)
    except AnalysisException:
        if fallback is None:
            raise
        warnings.warn(f"{path} is not there; reading {fallback}", stacklevel=2)
        path = fallback
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spark.read.option("header", True).option("comment", "#").csv(path).columns])
    raw = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    names = [time] if isinstance(time, str) else time
    time = next((c for c in names if c in raw.columns), names[0])
    missing = [c for c in [*metrics, time] if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return raw.select(utc_timestamp(F.col(time)).alias("ts"), *[numeric(F.col(c)).alias(c) for c in metrics])


def read_status(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """JSON status files, one object each over any number of lines, with the DDL ``fields``; a field that is missing is NULL.

    A file that is no JSON gives a row of NULLs.
    """
    return spark.read.schema(fields).option("multiLine", True).json(path)


def read_states(spark: SparkSession, path: str, columns: list[str] | None = None, time: str = "Timestamp_UTC") -> DataFrame:
    """CSV of states with JSON columns in quotes: all columns or the named ones as text, and a UTC time ``ts``.

    Only named columns are parsed from the file.
    """
    raw = spark.read.option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(utc_timestamp(F.col(time)).alias("ts"), *[c for c in columns or raw.columns if c != time])


def parse_vector(text: Column, size: int | None = None) -> Column:
    """JSON array to array of doubles; NULL if malformed, of another length, or not finite."""
    v = F.from_json(text, "array<double>")
    good = ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return F.when(good & (F.size(v) == size) if size else good, v)


def parse_layers(text: Column, names: list[str], size: int | None = None, *, strict: bool = True) -> Column:
    """JSON object of arrays to a struct of vectors. ``strict``: NULL unless all layers are there and none is all zero."""
    raw = F.from_json(text, ", ".join(f"`{n}` array<double>" for n in names))
    parts = F.struct(*[F.when(F.size(raw[n]) == size if size else raw[n].isNotNull(), raw[n]).alias(n) for n in names])
    if not strict:
        return parts
    whole = F.lit(True)
    for n in names:
        whole = whole & F.coalesce(F.exists(parts[n], lambda x: F.abs(x) > 1e-8), F.lit(False))
    return F.when(whole, parts)


def parse_tokens(text: Column) -> Column:
    """JSON object of counts to a map, without the reserved total."""
    return F.map_filter(F.from_json(text, "map<string,bigint>"), lambda k, v: k != "__total__")


def tokens_json(tokens: Column) -> Column:
    """Map of counts to a JSON object in the order of its tokens; NULL for NULL."""
    whole = F.transform_values(tokens, lambda k, v: v.cast("bigint"))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(whole))))


def replace_table(df: DataFrame, path: str, *, form: str = "parquet", **options: str | bool) -> None:
    """Write ``df`` in place of the table at ``path``: whole, or not at all.

    The new table is written beside the old one and takes its place by renames, so a job that fails leaves the old one as it was. It
    may read the old table. Between the two renames (on an object store: copies) readers find no table, never half of one.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    staged, aside = (f"{path}.{what}-{uuid.uuid4().hex}" for what in ("staged", "old"))
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.format(form).options(**options).save(staged)
        had = files.exists(place(path))
        if had and not files.rename(place(path), place(aside)):
            raise OSError(f"{path} cannot be moved aside")
        try:
            moved = files.rename(place(staged), place(path))
        except Exception:
            moved = False
        if not moved:
            if had:
                files.rename(place(aside), place(path))
            raise OSError(f"the new table cannot be moved to {path}")
        if had:
            files.delete(place(aside), True)
    finally:
        files.delete(place(staged), True)


def write_csv(df: DataFrame, path: str) -> None:
    """One small table as a single CSV part with a header, in place of the old one."""
    replace_table(df.coalesce(1), path, form="csv", header=True)
