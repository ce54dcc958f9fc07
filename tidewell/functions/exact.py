"""Exact null distributions of two-sample tests, by counting recurrences."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Sizes up to which the exact distributions stand in for the limits: of the smaller sample for ranks without
#: ties, of the larger one for distribution distances.
SMALL_RANKS, SMALL_DISTANCES = 8, 10_000


@functools.lru_cache(maxsize=256)
def rank_sum_tails(n_a: int, n_b: int) -> np.ndarray:
    """P(U >= u) for u = 0..n_a * n_b, by the coefficients of the Gaussian binomial.

    The number of arrangements with a given U is a coefficient of the product of (1 - q^(b + j)) / (1 - q^j) over
    j = 1..a; each factor is a difference and a running sum over integers, which stay exact.
    """
    a, b = sorted((n_a, n_b))
    ways = np.zeros(a * b + 1, dtype=object)
    ways[0] = 1
    for j in range(1, a + 1):
        if b + j < len(ways):
            ways[b + j :] = ways[b + j :] - ways[: len(ways) - b - j]
        for r in range(min(j, len(ways))):
            ways[r::j] = np.cumsum(ways[r::j])
    above = np.cumsum(ways[::-1])[::-1]
    total = math.comb(a + b, a)
    return np.array([int(x) / total for x in above])


def rank_sum_two_sided(u: float, n_a: int, n_b: int) -> float:
    """Twice the tail from the larger U of both samples on; no ties."""
    return min(1.0, 2 * float(rank_sum_tails(n_a, n_b)[round(max(u, n_a * n_b - u))]))


def distance_tail(d: float, n_a: int, n_b: int) -> float:
    """P(D >= d) of the two-sample distance: the share of lattice paths that reach the band's edge.

    The paths from (0, 0) to (a, b) are followed by their diagonals, only inside |x / a - y / b| < d. A step goes to the first
    sample with the probability of what is left of it, so numbers stay below 1 and what leaves the band is summed up as it is,
    without cancellation.
    """
    a, b = sorted((int(n_a), int(n_b)))
    g = math.gcd(a, b)
    up, across = b // g, a // g
    edge = round(d * up * a)
    if edge <= 0:
        return 1.0
    inside, left = np.zeros(a + 2), 0.0
    inside[1] = 1.0  # shifted by one: inside[x + 1]
    low, high = 0, 0
    for s in range(1, a + b + 1):
        rest = a + b - s + 1
        low, high = max(low, s - b), min(high + 1, a)
        x = np.arange(low, high + 1)
        y = s - x
        now = (inside[x] * (a - x + 1) + inside[x + 1] * np.maximum(b - y + 1, 0)) / rest
        out = np.abs(x * up - y * across) >= edge
        left += float(now[out].sum())
        now[out] = 0.0
        inside[max(low, 1)] = 0.0
        inside[x + 1] = now
        kept = np.flatnonzero(~out)
        if not len(kept):
            return 1.0
        inside[low] = 0.0
        low, high = low + int(kept[0]), low + int(kept[-1])
        inside[low] = 0.0
    return min(1.0, left)
