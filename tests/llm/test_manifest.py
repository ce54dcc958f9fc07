"""Operator 11 against a plain Merkle tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import op11_manifest
from tidewell.llm.op11_manifest import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "x", None, None, None), (None, "x", None, None, 1), (7, None, None, "s", 3), (5, "", "", "s", 9), (5, "", "", "s", 9), (5, "é" * 9, "", "s", 2),
    (14, "lone", "zz", "s", 2**63 - 1), (21, "a" * 200_000, "-", "-", 0), (-35, "neg", "-", "", 1), (28, "\x00", "-", "é", 5),
]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append((level[j] if j < i else "", level[j] if i < j < len(level) else ""))
        i //= 2
    return out


def plain(rows) -> list[tuple]:
    langs = {}
    for r in rows:
        own = leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        tampered = own
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None:
            tampered = leaf(r.doc_id, r.source, r.lang, r.n_chars + 1 if r.n_chars + 1 < 2**63 else None, r.text)
        langs.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, own, tampered))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(langs[k])]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for a, k in enumerate(names):
        for i, (has, doc, own, folded) in enumerate(sorted(langs[k])):
            steps = path(trees[k], i) + path(top, a)
            for before, after in steps:
                folded = digest(before + folded + after)
            proof = digest("".join(b + e for b, e in steps))
            out.append((doc if has else None, own, trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "i", "n", "pos", "digest", "path", "top", "levels")})
    assert sorted(map(tuple, manifest(docs).collect()), key=str) == plain(docs.collect())
    assert manifest(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 700])
def test_sizes_around_a_block(spark, n):
    docs = spark.range(n).selectExpr("id doc_id", "concat('t', id) text", "if(id % 5 = 4, 'b', 'a') lang", "'s' source", "id n_chars")
    assert sorted(map(tuple, manifest(docs).collect()), key=str) == plain(docs.collect())


def test_blocks_of_blocks(spark, monkeypatch):
    """Blocks of four leaves: three rounds above the leaves."""
    monkeypatch.setattr(op11_manifest, "LEVELS", 2)
    monkeypatch.setattr(op11_manifest, "BLOCK", 4)
    docs = spark.range(150).selectExpr("id doc_id", "concat('t', id) text", "if(id % 3 = 0, null, 'a') lang", "'s' source", "id n_chars")
    assert sorted(map(tuple, manifest(docs).collect()), key=str) == plain(docs.collect())
