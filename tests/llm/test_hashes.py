"""Range hashes: arithmetic modulo the prime, and texts built so that a hash modulo 2**64 would call them equal."""

from __future__ import annotations

import random

import numpy as np

from tidewell.llm import bytes as B
from tidewell.llm.op7_jaccard import jaccard_join
from tidewell.llm.op8_suffix import remove_repeats


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_arithmetic():
    rng = random.Random(1)
    prime = int(B.PRIME)
    a, b = ([0, 1, prime - 1, *[rng.randrange(prime) for _ in range(500)]] for _ in range(2))
    assert B.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % prime for x, y in zip(a, b, strict=True)]
    up, down = B.powers(1 << 10)
    assert up[777] == pow(B.BASE, 777, prime) and all(int(x) * int(y) % prime == 1 for x, y in zip(up, down, strict=True))


def test_equal_ranges_and_long_ones(monkeypatch):
    data = np.frombuffer(b"abcabcabc" * 500, np.uint8)
    hashes = B.RangeHash(data)
    start = np.arange(0, 3000, 3)
    assert len(np.unique(hashes(start, start + 900))) == 1 and len(np.unique(hashes(start, start + 901))) == 1
    assert len(np.unique(hashes(np.arange(3), np.arange(3) + 900))) == 3
    whole = hashes(np.array([0, 3]), np.array([4000, 4003]))
    monkeypatch.setattr(B.RangeHash, "STEP", 64)
    assert (B.RangeHash(data)(np.array([0, 3]), np.array([4000, 4003])) == whole).all()
    words = np.array([5, 6, 7, 5, 6, 7], np.uint64) * B.ODD
    assert B.RangeHash(words)(np.array([0]), np.array([3])) == B.RangeHash(words)(np.array([3]), np.array([6]))


def test_cancelling_patterns_stay_apart(spark):
    one, other = thue_morse(256, "'u"), thue_morse(256, "u'")
    rng = random.Random(2)
    for _ in range(40):
        keys = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=128))
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (one + keys + other, other + keys + one))
        assert B.RangeHash(a)(np.array([0]), np.array([640])) != B.RangeHash(b)(np.array([0]), np.array([640]))
    docs = spark.createDataFrame([(1, one + keys + other), (2, other + keys + one)], "doc_id long, text string")
    assert {r.n_removed for r in remove_repeats(docs).collect()} == {0}
    docs = spark.createDataFrame([(1, thue_morse(1024, "ab")), (2, thue_morse(1024, "ba"))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join(docs).collect()} == {(1, 1), (2, 2)}
    words = [np.array([11 if c == "a" else 29 for c in thue_morse(1024, x)], np.uint64) * B.ODD for x in ("ab", "ba")]
    assert B.RangeHash(words[0])(np.array([0]), np.array([1024])) != B.RangeHash(words[1])(np.array([0]), np.array([1024]))
