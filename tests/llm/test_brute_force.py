"""Operators against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.oracle import SF, same
from tidewell.llm import op4_bpe, op6_substring, registry
from tidewell.llm.components import components
from tidewell.llm.op2_url import url_filter
from tidewell.llm.op3_packing import best_fit_runs
from tidewell.llm.op4_bpe import VOCABULARY, encode_texts, vocabulary
from tidewell.llm.op5_topk import top_members
from tidewell.llm.op6_substring import repeated_paragraphs, without_spans
from tidewell.llm.op7_jaccard import jaccard_join
from tidewell.llm.op8_suffix import remove_repeats
from tidewell.llm.op10_tokens import file_blocks, token_counts

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_says_what_its_sql_says(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_bpe_equals_the_library(spark, texts, tokenizer):
    got = {r.doc_id: r for r in registry.QUERIES["op4_bpe_round_trip"](spark, SF).collect()}
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        back = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (*want, back)


def test_bpe_on_odd_texts(tokenizer):
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "世", "'s", "12", "<|endoftext|>", "!", "\x1c", "\r\n", " ing", "\U0001f600", "​", "\x85", "\x01", "x" * 60]
    odd = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    flat, at = encode_texts(vocabulary(PATH), pa.array(odd))
    for k, text in enumerate(odd):
        assert flat[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(spark, texts, tokenizer):
    got = registry.QUERIES["op3_best_fit_packing"](spark, SF).toPandas()
    total = 0
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == list(own.length.cumsum() - own.length)
        assert list(own.ids_crc32) == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
        assert (own.length.iloc[1:] == 2048).all()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.sequence_id.nunique() <= -(-total // 2048) * 1.02 + 1


def one_by_one(lengths: list[int], capacity: int) -> int:
    """Sequences of best fit over single pieces, the longest first."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_runs_equal_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2048): rng.randint(1, 30) for _ in range(rng.randint(1, 40))} | ({2048: 3, 1: 5} if seed else {})
    runs = best_fit_runs(counts, 2048)
    held: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        own = sorted(r for r in runs.tolist() if r[0] == length)
        assert own[0][1] == 0 and all(r[1] < n for r in own)
        for (_, rank, first, offset), end in zip(own, [*[r[1] for r in own[1:]], n], strict=True):
            for i in range(end - rank):
                held.setdefault(first + i, []).append((offset, length))
    for places in held.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(held) == one_by_one([n for n, count in counts.items() for _ in range(count)], 2048)


def test_url_rules_on_every_page(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    own = [(i, f"{scheme}{host}{path}") for i, (scheme, host, path) in enumerate(itertools.product(["http://", "", "a://b://"], ["Net", "x.NET", "example.net", "www.Example.com", "org", "torg", "é.org"], ["", "/", "/en/", "/EN/", "/de/x?y#z", "/fr", "?/fr/", "#a", "/fr/é"]))]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for table in (pages, own):
        got = {r.page_id: r for r in url_filter(spark.createDataFrame(table, "page_id long, url string")).collect()}
        assert len(got) == len(table)
        for page, url in table:
            rest = (url or "").partition("://")[2]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:].split("?")[0].split("#")[0]
            fitting = [r for r in rules if path.startswith("/" + r.partition("/")[2]) and ("." + host).endswith("." + r.partition("/")[0])]
            rule = max(fitting, key=len, default=None)
            r = got[page]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (rules[rule] if rule else "block" if r.block_score >= 0.5 else "allow")


def test_the_cache_of_pieces_is_emptied_by_size(tokenizer, monkeypatch):
    monkeypatch.setattr(op4_bpe, "CACHED", 5_000)
    v = op4_bpe.Vocabulary(PATH)
    for k in range(20):
        words = " ".join(f"word{k}x{i}" for i in range(50))
        flat, _ = encode_texts(v, pa.array([words]))
        assert flat.tolist() == tokenizer.encode(words, add_special_tokens=False).ids and v.held < 30_000


def test_top_members_hold_the_best():
    rng = np.random.default_rng(0)
    rows, queries = rng.integers(-30, 30, (500, 16)).astype(float), rng.integers(-30, 30, (9, 16)).astype(float)
    own = np.zeros((9, 500), bool)
    for q, (at, score) in enumerate(top_members(queries, rows, own, 20, 8)):
        want = np.sort(rows @ queries[q])[::-1][:20]
        assert (np.sort(score)[::-1][:20] == want).all() and (score == rows[at] @ queries[q]).all()


@pytest.mark.parametrize("group_windows", [1 << 20, 100])
def test_repeats_against_all_windows(spark, group_windows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(4)]
        parts.insert(rng.randint(0, 4), rng.choice(shared)[rng.randint(0, 30) :])
        docs.append((i, "".join(parts)))
    docs += [(90, docs[0][1]), (91, ""), (92, None)]
    length = 60
    raw = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[s : s + length] for b in raw.values() for s in range(len(b) - length + 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in remove_repeats(df, length=length, kmer=15, group_windows=group_windows).collect():
        b, gone = raw[r.doc_id], set()
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone |= set(range(s, s + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_rows_without_id_share_strings(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, copied = text(400), text(900)
    docs = [(None, text(70) + shared + text(80)), (1, text(300) + shared + text(60)), (None, copied), (None, copied), (None, text(500)), (2, text(500)), (None, None)]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 0, 0), (0, 500, 0), (0, 550, 400), (0, 900, 900), (0, 900, 900), (1, 760, 400), (2, 500, 0)]


def shingles(text: str, size: int) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_jaccard_components_against_all_pairs(spark):
    rng = random.Random(3)
    docs = []
    for base in range(6):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(rng.choice([6, 40, 120, 130]))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(copy)))
    sets = {i: shingles(t, 4) for i, t in docs}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in jaccard_join(df).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_planted_passages_are_caught_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"p{rng.randint(0, 10**6)}" + ("." if i % 9 == 8 else "") for i in range(n))
    passage = prose(63)
    near = passage.split()
    near[30] = "other"
    docs = [(i, prose(80) + "\n" + prose(40)) for i in range(20)]
    docs += [(100, prose(30) + "\n" + passage), (101, passage + "\n" + prose(30)), (102, prose(25) + " " + passage + " " + prose(25)), (103, prose(33) + "\n" + " ".join(near))]
    found = repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {101, 102, 103} and {r.of_doc_id for r in found} == {100}


def test_near_paragraphs_among_a_family_of_templates(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(71)]  # 67 of 76 shingles: two of the family have a similarity of 67 / 85
    own = lambda: [f"o{rng.randint(0, 10**9)}" for _ in range(9)]
    rows = [common + own() for _ in range(300)]
    for k in range(200):  # like one of the family in all but the last word
        rows.append([*rows[100 + k][:-1], "other"])
    docs = [(i, " ".join(words)) for i, words in enumerate(rows)]
    found = repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.of_doc_id) for r in found} == {(300 + k, 100 + k) for k in range(200)}


def test_passages_of_any_lines_and_sentences_are_cut(spark):
    rng = random.Random(9)
    words = lambda n: [f"q{rng.randint(0, 10**9)}" for _ in range(n)]
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    stops = lambda w: [x + "." * (i % 4 == 3) for i, x in enumerate(w)]
    a, b, c, d = words(60), words(50), stops(words(55)), words(49)
    docs = [(1, wrapped(words(10) + a + words(10), 8)), (2, wrapped(words(15) + a + words(7), 9))]  # hard-wrapped
    docs += [(3, " ".join(words(40) + b + words(33))), (4, " ".join(words(31) + b + words(40)))]  # no sentence ends
    docs += [(5, " ".join(words(30) + c + words(30))), (6, " ".join(words(44) + c + words(12)))]  # short sentences
    docs += [(7, " ".join(words(30) + d + words(30))), (8, " ".join(words(30) + d + words(30)))]  # too short
    docs += [(10 + i, " ".join(words(20 + i) + b + words(30))) for i in range(5)]
    text = dict(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = repeated_paragraphs(df)
    left = {r.doc_id: (r.text or "").split() for r in without_spans(df, spans).collect()}
    seen, want = set(), {}
    for doc in sorted(text):
        w = text[doc].split()
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {i + k for i, r in enumerate(runs) if r in seen for k in range(50)}
        seen |= set(runs)
        want[doc] = [x for i, x in enumerate(w) if i not in gone]
    assert left == want
    assert {(r.doc_id, r.of_doc_id) for r in spans.collect()} == {(2, 1), (4, 3), (6, 5), *((10 + i, 3) for i in range(5))}


@pytest.mark.parametrize("block", [4096, 7])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(op6_substring, "BLOCK", block)
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 200, 60) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(60) < 0.09, rng.integers(0, 200, 60), bases[i % 6])) for i in range(60)]
    rows = [(i, [i % 2, 2], x.tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, buckets array<long>, shingles array<long>")
    root, got = {i: i for i in range(60)}, components(op6_substring.links_left(df, spark.createDataFrame([], "node long, root long")))
    near = [(a, b) for a, b in itertools.combinations(range(60), 2) if 10 * len(set(sets[a]) & set(sets[b])) >= 8 * len(set(sets[a]) | set(sets[b]))]
    assert 20 < len(near) < 200
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in got.collect()} == {i: r for i, r in root.items() if i != r}


def test_url_model_separates_seeded_hosts(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abcdefgh", k=8))
    rows = [(i, f"http://{name()}.{'casino' if i % 3 == 0 else 'books'}.example.org/en/{i}") for i in range(600)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    right = sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got)
    assert right / len(got) > 0.97


def test_documents_count_their_tokens(spark, texts):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in registry.QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got == {doc: len(plain.encode(text or "", add_special_tokens=False).ids) for doc, text in texts}


def test_flat_files_stitch_over_blocks(spark, tmp_path):
    rng = np.random.default_rng(6)
    want = {}
    for name in ("a", "b"):
        lengths = rng.integers(0, 40, 50).tolist()
        ids = np.concatenate([np.append(rng.integers(1, 100, n), 0) for n in lengths] + [rng.integers(1, 100, 7)])
        ids.astype("<u2").tofile(tmp_path / f"{name}.bin")
        want[name] = [*lengths, 7]
    got = token_counts(file_blocks(spark, str(tmp_path), block=16, end=0)).toPandas().sort_values(["file", "ordinal"])
    for (_, part), lengths in zip(got.groupby("file"), want.values(), strict=True):
        assert part.n_tokens.tolist() == lengths and part.ended.tolist() == [True] * 50 + [False]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 130)}
