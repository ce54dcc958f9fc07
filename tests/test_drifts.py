"""Mean drifts by tiles of stored blocks against the drift of tables that are shuffled whole, with blocks and tasks of a few rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import drifts, lexical, vectors


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = ["a", "The", "the", "ÉTÉ", "tide", "1 2", "Σίσυφος", "x;y", lexical.TOTAL_KEY, *(f"w{i}" for i in range(30))]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b ", "\r\n"]) for _ in range(rng.randint(1, 40)))
    rows = [(10 * i, "en" if i % 3 else "fr", text()) for i in range(60)]
    odd = [(1, "en", None), (2, "en", " \n"), (3, "fr", ""), (4, "en", lexical.TOTAL_KEY), (5, "de", "alone"), (6, None, "no series"), (7, None, "no series"), (8, "fr", rows[0][2])]
    return spark.createDataFrame([*rows, *odd], "doc_id long, lang string, text string")


@pytest.mark.parametrize(("entries", "pairs"), [(1 << 22, 300_000), (40, 50)])
def test_drifts_of_tiles_are_those_of_shuffled_tables(texts, monkeypatch, entries, pairs):
    monkeypatch.setattr(drifts, "ENTRIES", entries)
    monkeypatch.setattr(drifts, "PAIRS", pairs)
    found = {(r.lang, r.rep): r.js for r in drifts.mean_drifts(texts, ["lang"], "doc_id", "text", 7, 42).collect()}
    maps = texts.where(F.col("text").rlike(r"\S") & F.col("lang").isNotNull()).select("doc_id", "lang", lexical.token_map(F.col("text")).alias("tokens"))
    own = lexical.drift(maps, ["lang"], "doc_id").select("lang", F.lit(0).alias("rep"), "js")
    shuffled = lexical.drift(vectors.permuted(maps, ["lang"], "doc_id", ["tokens"], 7, 42), ["lang", "rep"], "doc_id").select("lang", "rep", "js")
    want = {(r.lang, r.rep): r.js for r in own.unionByName(shuffled).groupBy("lang", "rep").agg(F.avg("js").alias("js")).collect()}
    assert found.keys() == want.keys() and len(want) == 16
    assert all(found[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_rows_do_not_travel_to_their_pairs(texts, monkeypatch):
    monkeypatch.setattr(drifts, "ENTRIES", 40)
    table = drifts.blocks(drifts.counted_words(texts, ["lang"], "doc_id", "text"), ["lang"], "doc_id")
    assert table.count() > 10 and table.agg(F.sum("rows")).first()[0] == 63  # each row once, however many orders there are
    series = table.groupBy("lang").agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("first", "file"))).alias("blocks"))
    pairs = drifts.tiled_pairs(series, ["lang"], 7, 42)
    assert pairs.agg(F.sum(F.octet_length("i") + F.octet_length("j"))).first()[0] == 8 * 8 * (63 - 3)  # eight orders, eight bytes a pair
