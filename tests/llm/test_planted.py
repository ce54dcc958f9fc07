"""What removal of repeated bytes says of planted passages."""

from __future__ import annotations

import hashlib
import random

from tidewell.llm.op8_suffix import remove_repeats, without_repeats


def test_planted_passages_show_in_n_removed_and_n_bytes_is_the_whole_text(spark):
    """Passages of 60 words: those of 400 bytes or more go in both documents, shorter ones stay; clean documents lose nothing."""
    rng = random.Random(8)
    words = lambda n, size: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))
    texts, want = [], []
    for k in range(40):
        passage = words(60, 8 if k % 2 else 4)
        for _ in range(2):
            texts.append(f"{words(40, 6)}#{k}# {passage} #{words(40, 6)}")
            want.append(k % 2 == 1)
    texts, want = [*texts, *(words(150, 6) for _ in range(40))], want + [False] * 40
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].n_removed > 0 for i in range(len(texts))] == want
    assert [rows[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]


def test_spans_and_texts_show_what_goes(spark):
    """Real outputs of the operator: spans of bytes, the bytes left, and a text without the characters that a span cuts in two."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = words(60)
    # both passages follow the second byte of a character: equal there, but the characters differ
    texts = [f"{words(30)}\u00e8{passage}\u00e9!", f"{words(20)}\u0168{passage}\u00ea?", words(100), "", None]
    rows = {r.doc_id: r for r in without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts[:2]):
        raw = text.encode()
        at = raw.index(passage.encode())
        start, end = at - 1, at + len(passage) + 1
        assert [(s.start, s.end) for s in rows[i].spans] == [(start, end)]
        assert bytes(rows[i].kept) == raw[:start] + raw[end:]
        assert rows[i].text == text[: text.index(passage) - 1] + text[-1]
    assert [(rows[i].spans, bytes(rows[i].kept), rows[i].text) for i in (2, 3, 4)] == [([], t.encode(), t) for t in (texts[2], "", "")]


def test_digests_are_those_of_the_operators_outputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r for r in without_repeats(docs).collect()}
    cut = 0
    for r in remove_repeats(docs).collect():
        spans, kept = want[r.doc_id].spans, bytes(want[r.doc_id].kept)
        n_removed = sum(s.end - s.start for s in spans)
        digests = (len(kept) + n_removed, n_removed, len(spans), hashlib.sha256(kept).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans, r.text) == (*digests, spans, want[r.doc_id].text)
        cut += n_removed > 0
    assert 0 < cut < len(want)
