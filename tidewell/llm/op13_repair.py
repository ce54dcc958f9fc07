"""Conversation structure repair (operator 13): Hirschberg's divide and conquer over four states.

A conversation is cut to ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant. Its rows may be
kept (0), given the role that fits (3), or deleted (4), and empty turns inserted (3); of all cheapest edits
those with the ASCII-least audit, the edits' initials in order, are taken. The states are: nothing yet, system, user,
assistant. What a run of rows can do is a segment: for each state before and each one after it the least cost, and
the order of the least audits among the states after. Two segments on end make one (``joined``), so rows are summed up in
chunks, chunks in larger ones, and only the segments of 2**8 rows or 2**12 chunks of one conversation meet in a task.
On the way back a crossing is chosen in the middle of each run, from forward and backward costs, and both halves are
solved by themselves; in a chunk these halves go down to single rows. Memory is linear in a chunk.

Two audits to different states after the same rows differ before either ends, since both end with the same row's edit. So
the order of the least audits is that of the crossings, then that of what follows.

* Null conv_id, turn, role and text: damage and hashes take one space for them; turns are ordered nulls first.
  Rows without conv_id are one conversation, whose conv_id is null in the result.
* Rows of one conversation and turn follow their roles, then the SHA-256 of their texts; repeated rows are duplicates.
* Empty and blank texts are deleted. A chunk holds 256 rows with their texts, however long; the repaired text of a
  conversation passes through its hash chunk by chunk, and its audit must fit a string.
* gaps is null where it exceeds a long. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.order import PART_BITS, in_order
from tidewell.llm.tables import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: Rows of one chunk, and how far positions are shifted for the larger segments, as powers of two.
CHUNK = 8
SHIFTS = [20, 41, 53, 63]

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or a rerole'd turn.
FOLLOWS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that end a conversation from each state.
ENDS = ["", "II", "I", ""]
FAR = 1 << 60

#: A segment: (cost, order) for each pair of states, row by row.
Segment = tuple[tuple[tuple[int, int], ...], ...]


def ranked(found: list[tuple[int, object] | None]) -> tuple[tuple[int, int], ...]:
    """Costs with the order of the audits in place of the audits."""
    audits = sorted(x[1] for x in found if x is not None)
    return tuple((FAR, 0) if x is None else (x[0], audits.index(x[1])) for x in found)


def row_edits(code: str, before: int) -> dict[int, tuple[int, str]]:
    """The cheapest, then least edits of one row from the state ``before``, by the state after it.

    ``code``: the role's initial if it is s, u or a, else ``-``; upper case: truncated; ``x``: must be deleted.
    """
    found: dict[int, tuple[int, str]] = {}

    def offer(state: int, cost: int, audit: str) -> None:
        found[state] = min(found.get(state, (FAR, "")), (cost, audit))

    state, inserts = before, ""
    for _ in range(3):
        cost = INSERT * len(inserts)
        offer(state, cost + DELETE, inserts + "D")
        if code != "x":
            extra = TRUNCATED * (code in "SUA+")
            role = code.lower()
            if role in "ua" and "-sua".index(role) == FOLLOWS[state]:
                offer(FOLLOWS[state], cost + KEEP + extra, inserts + "K")
            if role == "s" and state == NOTHING:
                offer(SYSTEM, cost + KEEP + extra, inserts + "K")
            offer(FOLLOWS[state], cost + REROLE + extra, inserts + "R")
        state, inserts = FOLLOWS[state], inserts + "I"
    return found


@functools.lru_cache(maxsize=16)
def row_segment(code: str) -> Segment:
    return tuple(ranked([row_edits(code, a).get(b) for b in range(4)]) for a in range(4))


def joined(first: Segment, second: Segment) -> Segment:
    """The segment of two runs on end."""
    out = []
    for row in first:
        found: list[tuple[int, tuple[int, int]] | None] = []
        for after in range(4):
            ways = [(row[m][0] + second[m][after][0], (row[m][1], second[m][after][1])) for m in range(4)]
            best = min(ways)
            found.append(best if best[0] < FAR else None)
        out.append(ranked(found))
    return tuple(out)


def whole(segments: list[Segment]) -> Segment:
    return functools.reduce(joined, segments)


def forward(segments: list[Segment], low: int, high: int, start: int) -> tuple[tuple[int, int], ...]:
    """Costs and orders of the four states before segment ``high``, from state ``start`` before segment ``low``."""
    vector = segments[low][start]
    for k in range(low + 1, high):
        vector = joined((vector,), segments[k])[0]
    return vector


def backward(segments: list[Segment], low: int, high: int, end: int) -> list[int]:
    """Costs from each of the four states before segment ``low`` to state ``end`` after the last of them."""
    costs = [row[end][0] for row in segments[high - 1]]
    for k in range(high - 2, low - 1, -1):
        costs = [min(row[m][0] + costs[m] for m in range(4)) for row in segments[k]]
    return costs


def crossings(segments: list[Segment], start: int, end: int) -> list[int]:
    """The states between ``segments`` on the cheapest, then audit-least way: the middle one first, then each half's."""
    states = [start, *[-1] * (len(segments) - 1), end]
    spans = [(0, len(segments))]
    while spans:
        low, high = spans.pop()
        if high - low < 2:
            continue
        mid = (low + high) // 2
        before, after = forward(segments, low, mid, states[low]), backward(segments, mid, high, states[high])
        states[mid] = min(range(4), key=lambda s: (before[s][0] + after[s], before[s][1]))
        spans += [(low, mid), (mid, high)]
    return states


def last_state(segment: Segment) -> tuple[int, int]:
    """Cost of a whole conversation and its state before the closing inserts."""
    ways = [(segment[NOTHING][s][0] + INSERT * len(ENDS[s]), segment[NOTHING][s][1], s) for s in range(4)]
    cost, _, state = min(ways)
    return cost, state


@functools.lru_cache(maxsize=4096)
def chunk_segment(codes: str) -> Segment:
    return whole([row_segment(c) for c in codes])


@functools.lru_cache(maxsize=4096)
def chunk_audits(codes: str, start: int, end: int) -> list[str]:
    """The edits of each row of a chunk, inserts before it included."""
    states = crossings([row_segment(c) for c in codes], start, end)
    return [row_edits(c, a)[b][1] for c, a, b in zip(codes, states[:-1], states[1:], strict=True)]


def flat(segment: Segment) -> list[int]:
    return [x for row in segment for pair in row for x in pair]


def segment_of(values: list[int]) -> Segment:
    pairs = list(zip(values[::2], values[1::2], strict=True))
    return tuple(tuple(pairs[4 * a : 4 * a + 4]) for a in range(4))


def key_of(conv_id: Column) -> Column:
    """A conversation's key: null apart from all others."""
    return F.coalesce(F.concat(F.lit("1"), conv_id.cast("string")), F.lit("0"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage, with what the repair asks of each: ``key`` of the conversation, digest, blank, truncated."""
    space = F.lit(" ")
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    base = rows.select(
        key_of(F.col("conv_id")).alias("key"),
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = base.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    hurt = hurt.withColumn("times", F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))"))).drop("kind", "times")
    solid = F.translate("text", SPACES, "")
    return hurt.withColumns(
        {"digest": F.sha2("text", 256), "blank": solid == "", "truncated": ~F.substring(solid, -1, 1).isin(".", "!", "?")}
    )


def turn_gaps(turns: DataFrame) -> DataFrame:
    """Turn numbers missing between the least and the greatest; one row per conversation and turn meets another."""
    each = turns.where("turn IS NOT NULL").select("key", "turn").distinct()
    wide = [F.col(c).cast("decimal(38,0)") for c in ("high", "low", "n")]
    found = each.groupBy("key").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("*").alias("n"))
    return found.select("key", (wide[0] - wide[1] + 1 - wide[2]).alias("gap")).select("key", F.expr("try_cast(gap AS bigint)").alias("gaps"))


def coded(turns: DataFrame) -> DataFrame:
    """One slim row per turn: its fault and its code. A duplicate is a row that is not the first of its role and text."""
    first = turns.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    slim = turns.select("key", "pos", F.substring("role", 1, 1).alias("initial"), "blank", "truncated").join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    hurt = F.when(role == "-", "+").otherwise(F.upper(role))
    code = F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", hurt).otherwise(role)
    return slim.select("key", "pos", fault.alias("fault"), role.alias("role"), code.alias("code"))


def illegal(before: Column, after: Column) -> Column:
    """Whether two neighbouring role initials are not allowed; null before the first row."""
    return before.isNotNull() & ~F.concat(before, after).isin("su", "ua", "au")


def chunks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and 2**CHUNK positions: codes in order, faults, and illegal neighbours within."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "role", "code")))
    count = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    grouped = coded(turns).groupBy("key", F.shiftright("pos", CHUNK).alias("at")).agg(*count.values(), rows.alias("rows"))
    pairs = F.transform("rows", lambda r, k: illegal(F.when(k > 0, F.get(F.col("rows"), k - 1)["role"]), r["role"]).cast("int"))
    return grouped.select(
        "key", "at", *count,
        F.array_join(F.col("rows.code"), "").alias("codes"),
        F.get(F.col("rows"), F.lit(0))["role"].alias("first_role"),
        F.element_at("rows", -1)["role"].alias("last_role"),
        F.aggregate(pairs, F.lit(0), lambda n, x: n + x).cast("long").alias("illegal"),
    )


def with_segments(chunks: DataFrame) -> DataFrame:
    """Adds each chunk's segment."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [flat(chunk_segment(c)) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "segment"])

    return chunks.mapInArrow(each, f"{', '.join(f'`{c}` {t}' for c, t in chunks.dtypes)}, segment array<bigint>")


def grouped_by(segments: DataFrame, shift: int) -> DataFrame:
    """Segments that one larger segment spans, as an array in order."""
    at = F.expr(f"shiftright(at, {shift})")
    parts = F.sort_array(F.collect_list(F.struct("at", "segment")))
    return segments.groupBy("key", at.alias("above")).agg(parts.alias("parts"))


def routed(segments: DataFrame, level: int = 0) -> DataFrame:
    """(key, at, start, end, cost) of each segment: its states before and after on its conversation's best way.

    Segments that are the only one of their conversation are solved where they are; the others are summed up in larger
    ones, solved in turn, and take their states from those.
    """
    counted = segments.groupBy("key").agg(F.count("*").alias("n"))
    counted = stored(segments.join(counted, "key"), "segments")
    alone = counted.where("n = 1").select("key", "at", "segment").mapInArrow(finish, "key string, at bigint, start int, end int, cost bigint")
    several = counted.where("n > 1").select("key", "at", "segment")
    if several.isEmpty():
        return alone
    shift = SHIFTS[level] - (SHIFTS[level - 1] if level else CHUNK)
    larger = stored(grouped_by(several, shift), "larger")
    summed = larger.select("key", F.col("above").alias("at"), "parts").mapInArrow(sums, "key string, at bigint, segment array<bigint>")
    above = routed(summed, level + 1).withColumnRenamed("at", "above")
    split = larger.join(above, ["key", "above"]).select("key", "parts", "start", "end", "cost")
    return alone.unionByName(split.mapInArrow(descend, "key string, at bigint, start int, end int, cost bigint"))


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [last_state(segment_of(x)) for x in batch.column("segment").to_pylist()]
        columns = [batch.column("key"), batch.column("at"), pa.array([NOTHING] * len(ends), pa.int32())]
        columns += [pa.array([s for _, s in ends], pa.int32()), pa.array([c for c, _ in ends], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "start", "end", "cost"])


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [flat(whole([segment_of(p["segment"]) for p in parts])) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(found, pa.list_(pa.int64()))], names=["key", "at", "segment"])


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "at", "start", "end", "cost"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        for row in batch.to_pylist():
            states = crossings([segment_of(p["segment"]) for p in row["parts"]], row["start"], row["end"])
            ends = list(zip([p["at"] for p in row["parts"]], states[:-1], states[1:], strict=True))
            values = zip(*[(row["key"], at, a, b, row["cost"]) for at, a, b in ends], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def repaired_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each chunk and its repaired turns, joined by newlines, with what a conversation's last chunk adds."""
    roles = {USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        audits, texts = [], []
        for row in batch.to_pylist():
            state, lines = row["start"], []
            edits = chunk_audits(row["codes"], row["start"], row["end"])
            for turn, letters in zip(row["turns"], edits, strict=True):
                for letter in letters:
                    if letter == "D":
                        continue
                    state = SYSTEM if letter == "K" and state == NOTHING and turn["role"][:1] == "s" else FOLLOWS[state]
                    role = turn["role"] if letter == "K" else roles[state]
                    lines.append(f"{role}:{'' if letter == 'I' else turn['text']}")
            closing = ENDS[row["end"]] if row["is_last"] else ""
            for _ in closing:
                state = FOLLOWS[state]
                lines.append(f"{roles[state]}:")
            audits.append("".join(edits) + closing)
            texts.append("\n".join(lines) if lines else None)
        columns = [batch.column("key"), batch.column("at"), pa.array(audits, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "audit", "repaired"])


def chained_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired chunks, in the order of a sorted partition, one chunk in memory at a time."""
    last, digest, begun = None, hashlib.sha256(), False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("repaired"), strict=True):
            key = key.as_py()
            if key != last:
                if last is not None:
                    yield out()
                last, digest, begun = key, hashlib.sha256(), False
            if text.is_valid:
                digest.update(b"\n" * begun)
                digest.update(text.as_buffer())
                begun = True
    if last is not None:
        yield out()


def neighbours(chunks: DataFrame) -> DataFrame:
    """Of each chunk, whether its first row and the one before it are illegal together, and whether it is the last.

    Chunks are put in order within a partition of positions, and of each partition only the last one among the partitions.
    """
    chunks = chunks.select("key", "at", F.shiftright("at", PART_BITS - CHUNK).alias("part"), "first_role", "last_role")
    within, along = Window.partitionBy("key", "part").orderBy("at"), Window.partitionBy("key").orderBy("part")
    parts = chunks.groupBy("key", "part").agg(F.max_by("last_role", "at").alias("last_role"))
    parts = parts.select(
        "key", "part", F.lag("last_role").over(along).alias("part_before"), F.lead("part").over(along).isNull().alias("last_part")
    )
    ends = chunks.select(
        "key", "at", "part", "first_role", F.lag("last_role").over(within).alias("before"), F.lead("at").over(within).isNull().alias("last_here")
    )
    across = illegal(F.coalesce("before", "part_before"), F.col("first_role")).cast("long")
    return ends.join(parts, ["key", "part"]).select("key", "at", across.alias("across"), (F.col("last_here") & F.col("last_part")).alias("is_last"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the conversations after damage: chunks of repaired turns (key, at, audit, repaired), their faults and costs, gaps."""
    turns = in_order(damaged(rows), ["key", "turn", "role", "digest"], "turns")
    chunks = stored(with_segments(chunks_of(turns)), "chunks")
    route = routed(chunks.select("key", "at", "segment")).join(neighbours(chunks), ["key", "at"])
    route = stored(route.join(chunks.drop("segment", "first_role", "last_role"), ["key", "at"]), "route")
    texts = turns.groupBy("key", F.shiftright("pos", CHUNK).alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    ready = texts.join(route.select("key", "at", "codes", "start", "end", "is_last"), ["key", "at"])
    made = stored(ready.mapInArrow(repaired_chunks, "key string, at bigint, audit string, repaired string"), "repaired")
    counts = route.select("key", "at", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("across")).alias("illegal"), "cost")
    return made, counts, turn_gaps(turns)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and hash of the repaired turns."""
    made, counts, gaps = repair(rows)
    sums_ = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    totals = counts.groupBy("key").agg(*sums_, F.max("cost").alias("cost"))
    parts = F.sort_array(F.collect_list(F.struct("at", "audit")))
    audits = made.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    hashes = made.select("key", "at", "repaired").repartition("key").sortWithinPartitions("key", "at")
    hashes = hashes.select("key", "repaired").mapInArrow(chained_hashes, "key string, repaired_sha256 string")
    found = rows.select("conv_id", key_of(F.col("conv_id")).alias("key")).distinct()
    for more in (totals, audits, hashes, gaps.withColumn("has_gaps", F.lit(True))):
        found = found.join(more, "key", "left")
    return found.select(
        "conv_id",
        F.when(F.col("has_gaps"), F.col("gaps")).otherwise(0).alias("gaps"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
