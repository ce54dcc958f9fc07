"""Stages of the pipeline against plain Python over small tables."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import SF
from tidewell.llm.op1_quality import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.fixture(scope="module")
def groups():
    """Documents with near copies, exact copies, repeated rows and rows without an id."""
    rng = random.Random(5)
    rows = []
    for _ in range(5):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(80)] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy), "a"))
    rows += [rows[0], (None, rows[4][1], "a"), (None, "x y z " * 9 + "end", "b"), (None, "x y z " * 9 + "end", "c"), (90, None, "a"), (91, "", "a")]
    return rows


def test_near_duplicates_keep_one_row_of_each_component(spark, groups):
    texts = sorted({(i is None, i or 0, t or "", i) for i, t, _ in groups}, key=lambda r: r[:3])
    sets = {r: shingles(r[2]) for r in texts}
    root = {r: r for r in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[a] = root[b] = min(root[a], root[b], key=lambda r: r[:3])
    want = sorted((r[:3] for r in set(root.values())))
    df = documents(spark, groups).withColumn("root", F.lit(1)).withColumn("t", F.lit("clash"))
    got = corpus_pipeline.near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == want


def test_quality_keeps_what_the_operator_keeps(spark, groups):
    df = documents(spark, groups)
    want = {(r.doc_id, r.t) for r in quality_rules(df).where("kept").collect()}
    got = corpus_pipeline.quality(spark, df, SF).withColumn("h", F.xxhash64("text"))
    assert {(r.doc_id, r.h) for r in got.collect()} == want and got.drop("h").columns == df.columns


def test_substrings_cut_the_later_copy(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage, own = words(60), [words(30) for _ in range(3)]
    rows = [(1, f"{own[0]} {passage}", "a"), (2, f"{passage} {own[1]}", "a"), (3, own[2], "a"), (4, passage, "a"), (5, None, "a"), (None, passage, "a")]
    got = {(r.doc_id, " ".join(r.text.split()), r.n_chars == len(r.text)) for r in corpus_pipeline.substrings(spark, documents(spark, rows), SF).collect()}
    assert got == {(1, f"{own[0]} {passage}", True), (2, own[1], True), (3, own[2], True)}  # 4 and the row without an id hold nothing else


def test_stages_of_an_empty_table(spark, groups):
    docs = documents(spark, groups).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length").orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in found} < {r.doc_id for r in docs.select("doc_id").collect()}
    for _, pieces in itertools.groupby(found, key=lambda r: r.doc_id):
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 2048
            at += r.length


def test_stages_keep_columns_of_any_name(spark, groups):
    df = documents(spark, groups).withColumns({c: F.lit("clash") for c in ("_id", "_ID_", "_t", "wish", "bands", "key", "h", "n", "c", "start")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert out.where("wish <> 'clash' OR _t <> 'clash' OR _id <> 'clash'").count() == 0
    assert corpus_pipeline.substrings(spark, df.drop("n_chars"), SF).columns == df.drop("n_chars").columns
    assert corpus_pipeline.packing(spark, df, SF).count() > 0
