"""Gates on tables: missing columns, missing values and frozen counts, checked in the pass that the job makes anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table is not what it was agreed to be."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself; an error before any job if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GateError(f"missing columns: {', '.join(missing)}")
    return df


def require_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with a stop in the plan: the first row without a value in one of the columns fails the job that reads it."""
    stop = lambda c: F.raise_error(F.lit(f"no value in column {c}")).cast(df.schema[c].dataType)
    return df.withColumns({c: F.when(F.col(c).isNull(), stop(c)).otherwise(F.col(c)) for c in columns})


def require_count(summary: DataFrame, count: str, expected: int) -> DataFrame:
    """A table of counts with a stop in the plan where ``count`` is not the frozen number."""
    said = F.concat(F.lit(f"{count} is "), F.col(count).cast("string"), F.lit(f", not {expected}"))
    return summary.withColumn(count, F.when(F.col(count) == expected, F.col(count)).otherwise(F.raise_error(said).cast("bigint")))


def observed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """``df``, and what its next action sees on the way: ``n_rows`` and for each column the rows without a value, ``no_<column>``."""
    seen = Observation()
    counts = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts), seen


def check_observed(seen: Observation, *, n_rows: int | None = None, missing: dict[str, int] | None = None) -> dict[str, int]:
    """The counts after an action; an error if they are not the frozen ones."""
    found = seen.get
    wanted = ({} if n_rows is None else {"n_rows": n_rows}) | {f"no_{c}": n for c, n in (missing or {}).items()}
    wrong = {k: (found[k], n) for k, n in wanted.items() if found[k] != n}
    if wrong:
        raise GateError("; ".join(f"{k} is {a}, not {b}" for k, (a, b) in wrong.items()))
    return found


def verdicts(df: DataFrame, keys: list[str], gates: dict[str, tuple[Column, int]]) -> DataFrame:
    """Per key and gate, in one pass: rows that break it, how many it allows, and whether it holds."""
    names = list(gates)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(gates[g][0], F.lit(True))).alias(f"_g{i}") for i, g in enumerate(names)])
    each = [F.struct(F.lit(g).alias("gate"), F.col(f"_g{i}").alias("n_broken"), F.lit(gates[g][1]).cast("bigint").alias("allowed")) for i, g in enumerate(names)]
    return counts.select(*keys, "n_rows", F.inline(F.array(*each))).withColumn("holds", F.col("n_broken") <= F.col("allowed"))
