"""Bounded tables of keys before large joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.llm import op6_substring, tables


@pytest.mark.parametrize("most", [tables.MOST_BITS, 1 << 10])
def test_met_by_loses_no_row_and_keeps_others_away(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_BITS", most)
    rows = spark.range(20_000).select(F.expr("IF(id = 7, NULL, id * 977 - 9000000)").alias("k"), F.lit("x").alias("word"), F.lit(1).alias("mask"))
    keys = rows.where("k IS NULL OR k % 20 = 0").select(F.col("k").alias("other"))
    found = tables.met_by(rows, F.col("k"), keys, "met")
    assert found.columns == [*rows.columns, "met"] and found.count() == 20_000
    assert found.where("NOT met AND (k IS NULL OR k % 20 = 0)").count() == 0
    others = found.where("met AND k % 20 <> 0").count()
    assert others < (19_000 if most < 1 << 20 else 2_500)
    assert tables.met_by(rows, F.col("k"), keys.where("false"), "met").where("met").count() == 0


def test_documents_without_spans_are_not_shuffled(spark):
    """Before, all texts went through the shuffle of the join with the spans."""
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spans = spark.createDataFrame([(5, 0, 0, 4)], "key long, t long, start long, end long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op6_substring.without_spans(docs, spans)
        assert sorted(r.text for r in out.collect()) == sorted(r.text for r in docs.collect())  # no text has the span's hash
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.startswith("Union") and "Filter NOT coalesce(" in plan
