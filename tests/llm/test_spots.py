"""Operator 12 against plain Python, on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import functions as F

from tests.oracle import SF
from tidewell.llm import registry
from tidewell.llm.op12_spots import COMMON, spot_fingerprints

LINE = "The cat sat on the mat, and a dog in der Küche ist für alle da. "
ROWS = [
    (None, None), (None, "!!!"), (None, "no id here"), (3, ""), (3, ""), (4, LINE * 3), (4, LINE * 3), (4, LINE), (5, "the"), (6, "of the"),
    (7, "\U0001f600 é x-y " * 7), (8, "w" * 100_000), (9, " ".join(f"item{i}" for i in range(50))), (10, LINE * 1_000), (11, "ab"),
]


def signatures(text: str) -> list[int]:
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not words:
        spots = [text]
    else:
        spots, since = [], 0
        for i, word in enumerate(["", *words]):
            anchor = i == 0 or word in COMMON
            since = 0 if anchor else since + 1
            if since % 8 == 0:
                chain = itertools.islice((words[j] for j in range(i, len(words)) if words[j] not in COMMON), 2)
                spots.append(f"{word if anchor else ''} {' '.join(chain)}")
    return sorted({int(hashlib.md5(s.encode()).hexdigest()[:15], 16) for s in spots})


def plain(rows) -> list[tuple]:
    rows = sorted(((d is not None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for d, t in rows))
    near = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    out = []
    for k, (has, doc, _, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, changed = signatures(text), signatures(edited)
        prints = [" ".join(f"{x:x}" for x in s) for s in (own, changed)]
        out.append((doc if has else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, near(own, changed), near(own, signatures(following))))
    return sorted(out, key=str)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "digest", "i", "n", "pos", "all", "own", "head", "rows", "n_chars")})
    assert sorted(map(tuple, spot_fingerprints(docs).collect()), key=str) == plain(ROWS)
    assert sorted(map(tuple, spot_fingerprints(docs.where("doc_id = 11")).collect())) == plain([(11, "ab")])
    assert spot_fingerprints(docs.where("false")).count() == 0


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = registry.QUERIES["op12_spot_fingerprints"](spark, SF).where("n_chars >= 200").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)
    assert sorted(r.near_edited for r in rows)[len(rows) // 2] > 0.55 and sorted(r.near_next for r in rows)[len(rows) // 2] < 0.05
