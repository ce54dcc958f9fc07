"""BPE encoding and decoding (operator 4) on contiguous rank arrays.

A text is cut into pieces before each space and around each newline, so that no word of the
pre-tokenizer's pattern spans two pieces; texts with longer runs of white space, where that
does not hold, are one piece. Each distinct piece is encoded once per batch, and a bounded
number of pieces per Python worker is kept.

Words of at most SHORT bytes are encoded together: a matrix holds each word's parts, another
the rank of each adjacent pair. Until no pair has a rank, the leftmost minimum of each row is
found by a scan, its boundary is deleted, and the two neighbouring ranks are looked up anew.
Longer words keep their boundaries in linked lists with a heap of ranks.

* Null and empty texts have no tokens. Special tokens inside a text are cut out first.
* Empty table: empty result. Repeated rows are encoded each. Extra columns are ignored.
* Equal ranks go to the leftmost pair. A text is encoded whole in one task, however long it is.
* The vocabulary file is a parameter; executors read it by that path.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Longest word, in bytes, of the matrices; characters and ids' bytes that the piece cache holds, some 100 bytes an entry counted in; texts encoded at once.
SHORT, CACHED, BATCH = 48, 128_000_000, 512
NONE = np.iinfo(np.int32).max
#: Fixed pattern of byte-level BPE, from the tokenizer's documentation.
PATTERN = public_tokenizers.PATTERN
#: White space beyond ASCII's and the controls that some engines count as such (Unicode's White_Space).
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = "\x01"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 letters stand for themselves, the other bytes for letters from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, ids of single bytes, and the merges as sorted arrays."""

    def __init__(self, path: str, special: bool = True) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *added.values()])
        self.token_bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if token not in added else token.encode()
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.special = added if special else {}
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = model["vocab"][letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([model["vocab"][a] << 32 | model["vocab"][b] for a, b in pairs], np.int64)
        made = np.array([model["vocab"][a + b] for a, b in pairs], np.int32)
        self.merges = dict(zip(keys.tolist(), zip(range(len(keys)), made.tolist(), strict=True), strict=True))
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.decimal = [str(i) for i in range(size)]
        #: Texts that aren't cut into pieces: runs of white space that pieces would cut differently
        #: (three or more, or two at the end), the cut mark, and special tokens.
        self.odd = "|".join([SPACE + "{3}", SPACE + r"{2}\z", r"\x01", *map(re.escape, self.special)])
        self.forget()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position in the merge list of each pair, NONE where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def forget(self) -> None:
        """Empty the cache of pieces, but for special tokens."""
        self.held = 0
        self.cache: dict[str, bytes] = {"": b""} | {t: np.int32(i).tobytes() for t, i in self.special.items()}

    @functools.cached_property
    def made_by_rank(self) -> np.ndarray:
        out = np.empty(len(self.made), np.int32)
        out[self.ranks] = self.made
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, special: bool = True) -> Vocabulary:
    """One vocabulary per Python worker. Without ``special``, strings of special tokens are ordinary text."""
    return Vocabulary(path, special)


def encode_short(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Little-endian 32-bit ids of words of about one length, through matrices of parts and adjacent ranks."""
    n, width = np.array([len(w) for w in words]), max(map(len, words))
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    parts = v.byte_ids[flat]
    ranks = np.full((len(words), width), NONE, np.int32)
    if width > 1:
        ranks[:, :-1] = v.rank_of(parts[:, :-1], parts[:, 1:])
    ranks[np.arange(width) >= n[:, None] - 1] = NONE
    rows = np.arange(len(words))
    while len(rows):
        at = ranks[rows].argmin(axis=1)
        best = ranks[rows, at]
        go = best != NONE
        rows, at, best = rows[go], at[go], best[go]
        if not len(rows):
            break
        parts[rows, at] = v.made_by_rank[best]
        columns = np.arange(width - 1)
        shifted = columns + (columns > at[:, None])  # everything right of the boundary moves left by one
        parts[rows[:, None], columns] = parts[rows[:, None], shifted]
        ranks[rows[:, None], columns] = ranks[rows[:, None], shifted]
        ranks[rows, width - 1] = NONE
        n[rows] -= 1
        left = at > 0
        ranks[rows[left], at[left] - 1] = v.rank_of(parts[rows[left], at[left] - 1], parts[rows[left], at[left]])
        right = at < n[rows] - 1
        ranks[rows[right], at[right]] = v.rank_of(parts[rows[right], at[right]], parts[rows[right], at[right] + 1])
        last = ~right
        ranks[rows[last], at[last]] = NONE
    raw, first = parts.astype("<i4", copy=False).tobytes(), np.arange(len(words)) * 4 * width
    return [raw[a:b] for a, b in zip(first.tolist(), (first + 4 * n).tolist(), strict=True)]


def encode_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """Ids of one word of any length: boundaries in linked lists, ranks in a heap."""
    part = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    after = [*range(1, len(part)), -1]
    before = list(range(-1, len(part) - 1))
    alive = [True] * len(part)
    heap = [(m[0], i, part[i], part[i + 1]) for i in range(len(part) - 1) if (m := v.merges.get(part[i] << 32 | part[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or part[i] != a or part[j] != b:
            continue
        part[i] = v.merges[a << 32 | b][1]
        alive[j], after[i] = False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and (y := after[x]) >= 0 and (m := v.merges.get(part[x] << 32 | part[y])):
                heapq.heappush(heap, (m[0], x, part[x], part[y]))
    return np.array([p for p, a in zip(part, alive, strict=True) if a], np.int32)


def encode_words(v: Vocabulary, words: list[str]) -> dict[str, bytes]:
    """Little-endian 32-bit ids of each word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(w) for w in raw])
    out: dict[str, bytes] = {}
    for low in range(0, SHORT, 4):
        of = np.flatnonzero((size > low) & (size <= low + 4))
        for k in range(0, len(of), 20_000):
            some = of[k : k + 20_000].tolist()
            out.update(zip([words[i] for i in some], encode_short(v, [raw[i] for i in some]), strict=True))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[words[i]] = encode_long(v, raw[i]).tobytes()
    return out


def words_of(v: Vocabulary, piece: str) -> list[str]:
    """The pre-tokenizer's words of a piece, with special tokens cut out."""
    if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece]
    if piece[-1] in ",." and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece[:-1], piece[-1]]
    if not v.special_pattern or "<" not in piece:
        return v.words.findall(piece)
    out, at = [], 0
    for m in v.special_pattern.finditer(piece):
        out += [*v.words.findall(piece[at : m.start()]), m[0]]
        at = m.end()
    return out + v.words.findall(piece[at:])


def encode_pieces(v: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each piece; new pieces and their words enter the cache, which is emptied once it holds too many bytes."""
    if v.held > CACHED:
        v.forget()
    known = v.cache
    out = list(map(known.get, pieces))
    if None not in out:
        return out
    words, made = set(), {}
    for p, ids in zip(pieces, out, strict=True):
        if ids is None:
            if len(ws := words_of(v, p)) > 1:
                made[p] = ws
            words.update(ws)
    new = encode_words(v, [w for w in words if w not in known])
    known |= new
    for p, ws in made.items():
        new[p] = known[p] = b"".join([known[w] for w in ws])
    v.held += sum(100 + len(p) + len(ids) for p, ids in new.items())
    return [known[p] if ids is None else ids for p, ids in zip(pieces, out, strict=True)]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of the texts in it (one more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.asarray(pc.match_substring_regex(texts, v.odd))
    plain = pc.if_else(pa.array(~odd), texts, "")
    cut = pc.replace_substring(pc.replace_substring(plain, " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
    lists = pc.split_pattern(cut, CUT)
    coded = pc.dictionary_encode(lists.flatten())
    at = np.array(coded.indices, np.int64)
    ids = encode_pieces(v, coded.dictionary.to_pylist())
    whole = np.flatnonzero(odd)
    first = np.asarray(lists.offsets)
    at[first[whole]] = len(ids) + np.arange(len(whole))
    ids += [b"".join(encode_pieces(v, words_of(v, texts[i].as_py()))) for i in whole.tolist()]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    pool = np.frombuffer(b"".join(ids), "<i4")
    flat = gather(pool, (np.cumsum(sizes) - sizes)[at], sizes[at])
    ends = np.concatenate([[0], np.cumsum(sizes[at])])
    return flat, ends[first]


def decode(v: Vocabulary, ids: list[int]) -> str:
    return b"".join(map(v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: number of tokens, digest of its ids, and digest of the text decoded from them."""
    path = path or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                n, ids_sha, text_sha = [], [], []
                flat, at = encode_texts(v, part.column(1))
                for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[low:high].tolist()
                    n.append(high - low)
                    ids_sha.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decode(v, ids).encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(encode, schema)
