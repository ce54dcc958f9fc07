"""Operator 13 against a plain search over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import sys
import zlib

from pyspark.sql import functions as F

from tests.oracle import SF
from tidewell.llm import op13_repair, registry
from tidewell.llm.op13_repair import chunk_audits, chunk_segment, last_state, repaired_conversations

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            yield from [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))


def cheapest(rows) -> tuple[int, str]:
    """Least cost, then least audit, by suffixes: rows are (initial, fault)."""

    sys.setrecursionlimit(20_000)

    @functools.lru_cache(maxsize=None)
    def best(i: int, state: str, inserts: int):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            cost, audit = best(i, NEXT[state], inserts + 1)
            ways.append((cost + 3, "I" + audit))
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                cost, audit = best(i + 1, NEXT[state], 0)
                ways.append((cost + 3 + extra, "R" + audit))
                if initial == NEXT[state] or (initial == "s" and state == ""):
                    cost, audit = best(i + 1, initial, 0)
                    ways.append((cost + extra, "K" + audit))
        return min(ways) if ways else (10**9, "")

    return best(0, "", 0)


def plain(conv, rows) -> tuple:
    after = sorted(damage(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
    faults, seen = [], set()
    for _, role, text in after:
        solid = "".join(c for c in text if c not in SPACES)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(after, faults, strict=True)))
    state, lines, left = "", [], list(after)
    for letter in audit:
        row = None if letter == "I" else left.pop(0)
        if letter != "D":
            state = "s" if letter == "K" and state == "" and row[1][:1] == "s" else NEXT[state]
            role = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{row[2] if row else ''}")
    turns = [t for t, *_ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:], strict=False)]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps if gaps < 2**63 else None, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def check(spark, rows) -> None:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "at", "pos", "start", "end", "kind", "digest", "n")})
    got = sorted((tuple(r) for r in repaired_conversations(df).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == sorted((plain(c, g) for c, g in groups.items()), key=str)


def test_halving_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(3000):
        codes = "".join(rng.choices("suaSUA-+x", k=rng.randint(1, 12)))
        rows = tuple((c.lower(), "blank" if c == "x" else "truncated" if c in "SUA+" else "") for c in codes)
        cost, state = last_state(chunk_segment(codes))
        assert (cost, "".join(chunk_audits(codes, 0, state)) + op13_repair.ENDS[state]) == cheapest(rows)


def random_rows(rng, convs, longest):
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    texts = ["Yes.", "No", " \n", "", None, "Really?", "é!", "same.", "same.", "x" * 300 + "."]
    for conv in convs:
        for k in range(rng.randint(1, longest)):
            yield (conv, rng.choice([None, k, k, k, k, k + 3, 0]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts))


def test_random_conversations(spark):
    rows = list(random_rows(random.Random(5), [*range(200), None, -3], 14))
    check(spark, [*rows, (900, 2**63 - 1, "user", "a."), (900, -(2**63), "assistant", "b."), (901, None, "user", "hm " * 20_000)])


def test_conversations_of_many_chunks(spark, monkeypatch):
    """Chunks of two rows and two levels of larger segments, over several partitions."""
    monkeypatch.setattr(op13_repair, "CHUNK", 1)
    monkeypatch.setattr(op13_repair, "SHIFTS", [3, 6, 34, 40, 63])
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), f"t{rng.randint(0, 900)}" + rng.choice([".", "", "!"])) for k in range(500)]
    check(spark, [*rows, *random_rows(rng, range(5, 40), 9)])


def test_dropped_and_empty(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Gone.")])
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_conversations(df).count() == 0


def test_query_over_the_whole_table(spark):
    groups = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r[0], []).append(tuple(r))
    got = sorted((tuple(r) for r in registry.QUERIES["op13_conversation_repair"](spark, SF).collect()), key=str)
    assert got == sorted((plain(c, g) for c, g in groups.items()), key=str)
