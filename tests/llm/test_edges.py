"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import op9_chat
from tidewell.llm.op1_quality import quality_rules
from tidewell.llm.op2_url import url_filter
from tidewell.llm.op3_packing import best_fit_packing
from tidewell.llm.op4_bpe import bpe_round_trip
from tidewell.llm.op5_topk import top_k
from tidewell.llm.op6_substring import repeated_paragraphs, without_spans
from tidewell.llm.op7_jaccard import jaccard_join
from tidewell.llm.op8_suffix import remove_repeats
from tidewell.llm.op10_tokens import document_token_counts

LINE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, LINE, "a"), (4, LINE, "a"), (5, LINE, None), (6, "x" * 20_000, "b"),
    (7, (LINE + " ") * 30, "b"), (8, "Ωmega <|endoftext|> 'tis", "b"), (9, "one two", "b"), (10, None, "b"),
]
DOC_OPERATORS = [quality_rules, best_fit_packing, bpe_round_trip, jaccard_join, remove_repeats, document_token_counts]


@pytest.fixture(scope="module")
def docs(spark):
    names = ["h", "n", "c", "t", "rank", "length", "sequence_id", "host", "words", "kept", "salt", "root", "f", "low", "first"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.mark.parametrize("operator", DOC_OPERATORS, ids=lambda f: f.__name__)
def test_one_row_per_document_row(docs, operator):
    got = sorted(r.doc_id for r in operator(docs).collect())
    want = sorted(r[0] for r in ROWS)
    assert sorted(set(got)) == sorted(set(want)) if operator is best_fit_packing else got == want


@pytest.mark.parametrize("operator", DOC_OPERATORS, ids=lambda f: f.__name__)
def test_rows_without_doc_id_stay(docs, operator):
    own = docs.where("doc_id IN (1, 2, 4, 9)").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where("doc_id IN (5, 8)"))
    got = operator(own).select("doc_id").collect()
    assert sum(r.doc_id is None for r in got) == 5 and {r.doc_id for r in got} == {None, 5, 8}


def test_rows_without_doc_id_link_and_are_cut(docs):
    rows = docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where("doc_id = 5"))
    assert {(r.doc_id, r.component_id) for r in jaccard_join(rows).collect()} == {(None, 5), (5, 5)}
    assert {r.n_removed for r in remove_repeats(rows).collect()} == {len(LINE)}


@pytest.mark.parametrize("operator", [*DOC_OPERATORS, repeated_paragraphs], ids=lambda f: f.__name__)
def test_empty_table(docs, operator):
    assert operator(docs.where("false")).count() == 0


def test_quality_of_edges(docs):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].n_words == 60 and not got[4].base_failed and got[4].n_repeat_words == 0
    assert got[7].n_repeat_words == 1800 and got[7].base_failed


def test_copies_link_and_empty_texts_do_not(docs):
    got = {r.doc_id: r for r in jaccard_join(docs).collect()}
    assert got[5].component_id == 4 and got[4].component_id == 4
    assert [got[i].component_id for i in (1, 2, 3, 10)] == [1, 2, 3, 10] and got[2].n_shingles == 0 and got[9].n_shingles == 1


def test_whole_copies_are_removed_byte_by_byte(docs):
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert got[4].n_removed == len(LINE) == got[5].n_removed and got[4].n_spans == 1
    assert got[6].n_removed == 20_000 and got[1].n_bytes == 0 and got[8].n_removed == 0


def test_paragraphs_of_rows_without_doc_id(spark):
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, LINE), (None, LINE), (1, LINE), (None, other), (None, other + "\n" + LINE), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("wish", "key", "bands", "t")})
    spans = repeated_paragraphs(docs)
    assert {(r.doc_id, r.of_doc_id) for r in spans.where(F.col("of_doc_id").isNotNull()).collect()} == {(None, 1)}
    left = without_spans(docs, spans)
    assert left.columns == docs.columns and left.where("wish <> 'wish' OR key <> 'key'").count() == 0
    texts = [(r.doc_id, (r.text or "").strip()) for r in left.collect()]
    assert (1, LINE) in texts and texts.count((None, "")) == 4 and texts.count((None, other)) == 1 and len(texts) == 6


def test_repeated_paragraphs_keep_the_first(docs):
    spans = repeated_paragraphs(docs)
    assert {(r.doc_id, r.of_doc_id) for r in spans.collect()} == {(5, 4), (7, 4)}  # the line said thirty times has the same shingles but four
    left = {r.doc_id: r.text for r in without_spans(docs.select("doc_id", "text", "source"), spans).collect()}
    assert left[5] == "" and left[4] == LINE and left[1] is None


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Net/x"), (4, "http://sub.example.net/en/1?q#z"), (5, "http://net"), (6, "x://example.com/de/a"), (6, "x://example.com/de/a"), (7, "http://notnet/"), (8, "http://b.org/fr/?x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("grams", F.lit(1))
    got = {r.page_id: r for r in url_filter(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.net", "/x", "net/", "block")
    assert (got[4].rule, got[4].verdict, got[4].path) == ("example.net/en/", "allow", "/en/1")
    assert got[5].rule is None and got[7].rule is None and got[6].rule == "example.com/de/" and got[8].rule == "org/fr/"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter(df.where("false")).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, None), (20, [-0.5, 1.0]), (40, [None, 1.0]), (5, [1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(0))
    got = top_k(df, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0] == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]
    assert {r.query_id for r in got} == {0, 20} and top_k(df.where("false")).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be\\good <s> <\\s>"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST]"), (2, None, None, "a"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "ro\nle", "x" * 30_000), (4, 1, "assistant", "done"), (4, 2, "assistant", "y" * 9_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("w", F.lit(0)).withColumn("i", F.lit(0))
    read = op9_chat.read_back(op9_chat.format_windows(df))
    got = {r.conv_id: r for r in read.collect()}
    for conv in (1, 2, 3, 4):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_text == "".join(t for r, t in want if r == "assistant")
    assert op9_chat.digests(op9_chat.read_back(op9_chat.format_windows(df.where("false")))).count() == 0
    windows = op9_chat.format_windows(df.where("conv_id = 1"), budget=4, history=1).orderBy("w").collect()
    assert len(windows) > 1 and all("be\\\\good" in w.formatted for w in windows)


def test_chat_windows_keep_to_the_budget_but_for_long_turns(spark):
    rng = random.Random(4)
    budget, rows = 60, []
    for conv in range(30):
        rows += [(conv, 0, "system" if conv % 2 else "user", "s" * rng.randint(0, 30))]
        rows += [(conv, t, ("user", "assistant")[t % 2], "x" * rng.choice([0, 3, 20, 50, 90, 300])) for t in range(1, 25)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = op9_chat.shown(op9_chat.spans(turns, budget), budget, 2).collect()
    tokens = {(c, t): -(-len(x) // 4) + 1 for c, t, _, x in rows}
    windows = {}
    for r in shown:
        windows.setdefault((r.conv_id, r.w), []).append((r.i, r.new))
    for (conv, w), held in windows.items():
        system = tokens[conv, 0] if conv % 2 else 0
        new = [i for i, is_new in held if is_new]
        assert new == list(range(min(new), max(new) + 1))
        assert not system or (0 in [i for i, _ in held])
        longest = max(tokens[conv, i] for i in new)
        if longest <= (budget - system) // 2:
            assert sum(tokens[conv, i] for i, _ in held) <= budget
        else:  # then nothing but the system turn and the new turns
            assert sum(tokens[conv, i] for i in new) < (budget - system) // 2 + longest
        if longest + (system if max(new) else 0) <= budget:
            assert sum(tokens[conv, i] for i, _ in held) <= budget
        else:
            assert len(new) == 1
        repeated = [i for i, is_new in held if not is_new and (i or not system)]
        assert repeated == list(range(min(new) - len(repeated), min(new))) and len(repeated) <= 2
    assert any(not is_new and i for held in windows.values() for i, is_new in held)


def test_chat_turns_that_fit_a_window_of_their_own_get_one(spark):
    rows = [(1, 0, "user", "x" * 249 * 4), (1, 1, "assistant", "y" * 450 * 4), (1, 2, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = {}
    for r in op9_chat.shown(op9_chat.spans(turns, 512), 512, 2).collect():
        held[r.w] = held.get(r.w, 0) + r.n
    assert len(held) == 3 and max(held.values()) <= 512


def test_scores_beyond_doubles_are_exact_and_beyond_longs_end_there(spark):
    rng = random.Random(8)
    vectors = {i: [rng.choice([0.0, 1.5, -2e4, 3e6, 1e7]) + rng.random() for _ in range(6)] for i in range(60)}
    vectors |= {60: [1e200, 1.0], 61: [-1e200], 62: [1e200, -1e200, 1e200, 1.0, 2.0, 3.0]}
    df = spark.createDataFrame([*vectors.items(), (None, [1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    top = 2**63 - 1
    scaled = {i: [max(-top - 1, min(top, math.floor(64 * x))) for x in v] for i, v in vectors.items()}
    for q in (0, 20, 40, 60):
        score = {i: max(-top, min(top, sum(int(float(a)) * int(float(b)) for a, b in zip(scaled[q], v, strict=False)))) for i, v in scaled.items() if i != q}
        assert got[q] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
