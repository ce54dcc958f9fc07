"""Column expressions for statistics that stay NULL where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 0.6745 scales a deviation in units of the median absolute deviation to a normal z.
MAD_SCALE = 0.6745
NORMAL_MAD = 1.4826


def present(x: Column) -> Column:
    """NaN counts as missing: NULL inside, so that aggregates skip it."""
    return F.when(F.isnan(x), None).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are there; NULL if either is constant. An aggregate."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    return F.lit(MAD_SCALE) * (x - median) / F.nullif(mad, F.lit(0.0))


def normal_mad_z(x: Column, median: Column, mad: Column) -> Column:
    return (x - median) / F.nullif(mad * NORMAL_MAD, F.lit(0.0))


def cohens_d(kind: str, n_a: Column, n_b: Column, mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    """Effect size (mean_a - mean_b) / s. ``kind``:

    ``pooled``: s from sample variances weighted by n - 1; ``average``: root of the mean of the
    two population variances. Variances are sample ones for the first, population ones for the second.
    """
    if kind == "pooled":
        s = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / F.nullif(n_a + n_b - 2, F.lit(0)))
    elif kind == "average":
        s = F.sqrt((var_a + var_b) / 2)
    else:
        raise ValueError(kind)
    return (mean_a - mean_b) / F.nullif(s, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL if a vector is shorter than 1e-12."""
    na, nb = norm(a), norm(b)
    return F.when((na >= 1e-12) & (nb >= 1e-12), 1 - dot(a, b) / (na * nb))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - cosine_distance(a, b))))
