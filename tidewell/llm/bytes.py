"""Vectorised words and window hashes over a batch of texts, as NumPy arrays."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
PRIME, BASE = np.uint64((1 << 61) - 1), 0x1C69B3F74AC4AE35
LOW31, LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Texts are handled in groups of about so many bytes.
GROUP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for factors below it, by halves of 31 bits; 2**61 is 1."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & LOW31, b >> np.uint64(31), b & LOW31
    mid = a_low * b_high + a_high * b_low
    return reduced(np.uint64(2) * a_high * b_high + (mid >> np.uint64(30)) + ((mid & LOW30) << np.uint64(31)) + a_low * b_low)


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo PRIME; n is a power of two."""
    out = []
    for base in (BASE, pow(BASE, -1, int(PRIME))):
        found = np.ones(1, np.uint64)
        while len(found) < n:
            found = np.concatenate([found, times(found, np.uint64(pow(base, len(found), int(PRIME))))])
        out.append(found)
    return out[0], out[1]


class RangeHash:
    """Hashes of any range of a buffer of bytes, or of hashes, in constant time, equal for equal ranges.

    A range is a polynomial modulo the prime 2**61 - 1 at a fixed point: two ranges of n items share it by chance with a probability of
    n / 2**61 at most, whatever their pattern. (Modulo 2**64, patterns can be built that cancel at every odd point.)
    """

    #: Items whose sums of low halves surely fit 64 bits.
    STEP = 1 << 24

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(1 << max(10, int(len(data)).bit_length()))
        up = up[: len(data)]
        if data.dtype == np.uint8:
            item = data.astype(np.uint64) + np.uint64(1)
            halves = (up & LOW31) * item, (up >> np.uint64(31)) * item
        else:
            item = times(reduced(data), up)
            halves = item & LOW31, item >> np.uint64(31)
        self.low, self.high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in halves)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = reduced(self.low[end] - self.low[start]), reduced(self.high[end] - self.high[start])
        return reduced(low + ((high & LOW30) << np.uint64(31)) + (high >> np.uint64(30)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sizes = (end - start).astype(np.uint64)
        if len(sizes) and sizes.max() > self.STEP:
            total, at = np.zeros(len(sizes), np.uint64), start
            while (at < end).any():
                total = reduced(total + self.part(at, np.minimum(at + self.STEP, end)))
                at = np.minimum(at + self.STEP, end)
        else:
            total = self.part(start, end)
        return mix(times(total, self.down[start]) + sizes * np.uint64(0xD1B54A32D192ED03))


def groups(texts: pa.Array, size: int = GROUP) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    out, low, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            out.append((low, i))
            low, total = i, 0
        total += n
    if low < len(lengths):
        out.append((low, len(lengths)))
    return out


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offsets of the texts in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.array([], np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: a run of bytes other than space and 9..13, inside one text."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][(offsets[1:] > 0)] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; shorter by size - 1 than the words."""
    n = max(0, len(word_hash) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * ODD + word_hash[k : k + n])
    return out
