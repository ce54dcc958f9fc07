"""Tail probabilities and one-dimensional fits, on plain numbers or NumPy arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov(d: float, n_a: int, n_b: int) -> float:
    """Two-sided p of the two-sample statistic by the asymptotic series."""
    x = math.sqrt(n_a * n_b / (n_a + n_b)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * x) ** 2) for j in range(1, 101))))


def binomial_at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k, n + 1)
    ]
    return min(1.0, sum(map(math.exp, logs)))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi_square(statistic: float, dof: int) -> float:
    return gamma_upper(dof / 2, statistic / 2)


def beta_regular(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regular(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def student_two_sided(t: float, dof: float) -> float:
    return beta_regular(dof / (dof + t * t), dof / 2, 0.5)


def golden(f, low: float, high: float, steps: int = 80) -> float:
    """Minimum of a one-dimensional function: the best of a grid, then golden section around it."""
    grid = np.linspace(low, high, 61)
    at = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(0, at - 1)], grid[min(60, at + 1)]
    r = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = b - r * (b - a), a + r * (b - a)
        a, b = (a, y) if f(x) < f(y) else (x, b)
    return (a + b) / 2


def r_squared(y: np.ndarray, fitted: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fitted) ** 2).sum() / spread) if spread > 0 else float("nan")


def fit_exponential(hours: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau and R2 of y = exp(-t / tau), tau within [0.1, 1e5]."""
    best = golden(lambda u: ((y - np.exp(-hours / math.exp(u))) ** 2).sum(), math.log(0.1), math.log(1e5))
    tau = math.exp(best)
    return tau, r_squared(y, np.exp(-hours / tau))


def amplitude_and_floor(e: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Least squares of y = A e + C with A in [0, 2] and C in [-1, 1]; returns A, C and the error."""
    found = []
    spread = ((e - e.mean()) ** 2).sum()
    trial = [] if spread < 1e-18 else [((e - e.mean()) * (y - y.mean())).sum() / spread]
    for a in [*trial, 0.0, 2.0]:
        a = min(2.0, max(0.0, a))
        c = min(1.0, max(-1.0, float((y - a * e).mean())))
        found.append((((y - a * e - c) ** 2).sum(), a, c))
    for c in (-1.0, 1.0):
        a = min(2.0, max(0.0, float(((y - c) * e).sum() / max((e * e).sum(), 1e-18))))
        found.append((((y - a * e - c) ** 2).sum(), a, c))
    error, a, c = min(found)
    return a, c, error


def fit_decay_to_floor(hours: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """A, tau, C and R2 of y = A exp(-t / tau) + C: tau by search, A and C by bounded least squares."""
    error = lambda u: amplitude_and_floor(np.exp(-hours / math.exp(u)), y)[2]
    tau = math.exp(golden(error, math.log(0.1), math.log(1e5)))
    e = np.exp(-hours / tau)
    a, c, _ = amplitude_and_floor(e, y)
    return a, tau, c, r_squared(y, a * e + c)


def golden_many(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, n: int, steps: int = 60) -> np.ndarray:
    """The minima of n functions at once, as ``golden`` finds them; ``f`` gives each its own value."""
    grid = np.linspace(low, high, 61)
    at = np.stack([f(np.full(n, x)) for x in grid]).argmin(axis=0)
    a, b = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, 60)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        left = f(x) < f(y)
        a, b = np.where(left, a, x), np.where(left, y, b)
    return (a + b) / 2


def fit_exponentials(hours: np.ndarray, y: np.ndarray) -> np.ndarray:
    """tau of each row of y (NaN where missing), as ``fit_exponential``; NaN below three values."""
    decay = lambda u: np.exp(-hours / np.exp(u)[:, None])
    tau = np.exp(golden_many(lambda u: np.nansum((y - decay(u)) ** 2, axis=1), math.log(0.1), math.log(1e5), len(y)))
    return np.where((~np.isnan(y)).sum(axis=1) >= 3, tau, np.nan)


def fit_decays_to_floor(hours: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tau and C of each row of y (NaN where missing), as ``fit_decay_to_floor``; NaN below three values."""
    there = ~np.isnan(y)
    n = np.maximum(there.sum(axis=1), 1)
    mean = lambda x: np.where(there, x, 0.0).sum(axis=1) / n

    def best(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(-hours / np.exp(u)[:, None])
        me, my = mean(e), mean(y)
        spread = mean((e - me[:, None]) ** 2)
        free = mean((e - me[:, None]) * (y - my[:, None])) / np.where(spread < 1e-18, np.inf, spread)
        trials = []
        for a in (free, np.zeros(len(y)), np.full(len(y), 2.0)):
            a = np.clip(a, 0.0, 2.0)
            trials.append((a, np.clip(my - a * me, -1.0, 1.0)))
        for c in (-1.0, 1.0):
            a = np.clip(mean((y - c) * e) / np.maximum(mean(e * e), 1e-18), 0.0, 2.0)
            trials.append((a, np.full(len(y), c)))
        errors = np.stack([mean((y - a[:, None] * e - c[:, None]) ** 2) for a, c in trials])
        at = errors.argmin(axis=0)
        return errors.min(axis=0), np.stack([c for _, c in trials])[at, np.arange(len(y))]

    u = golden_many(lambda u: best(u)[0], math.log(0.1), math.log(1e5), len(y))
    enough = there.sum(axis=1) >= 3
    return np.where(enough, np.exp(u), np.nan), np.where(enough, best(u)[1], np.nan)
