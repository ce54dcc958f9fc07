"""Recall of operator 6 on planted near copies of paragraphs."""

from __future__ import annotations

import random

import pytest

from tidewell.llm.op6_substring import repeated_paragraphs


def similarity(a: list[str], b: list[str]) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("rate", [0.01, 0.02, 0.05])
def test_near_copies_are_found(spark, rate):
    rng = random.Random(11)
    words = lambda n: rng.choices([f"w{i}" for i in range(5000)], k=n)
    rows, near = [], set()
    for doc in range(100):
        own = words(rng.randint(60, 160))
        copy = list(own)
        for i in rng.sample(range(len(own)), round(rate * len(own))):
            copy[i] = f"x{rng.random()}"
        for key, middle in ((doc, own), (doc + 1000, copy)):
            rows.append((key, "\n".join(" ".join(w) for w in (words(40), middle, words(40)))))
        if similarity(own, copy) >= 0.8:
            near.add(doc + 1000)
    found = {r.doc_id for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d >= 1000 for d in found) and len(found & near) >= 0.9 * len(near)
