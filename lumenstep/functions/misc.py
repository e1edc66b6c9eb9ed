"""Conversion, macro and random functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import formats
from ..values import col
from . import function


@function("PUT")
def put(x, fmt, catalog=None) -> Column:
    """The formatted text of a value."""
    return formats.put(col(x), fmt, catalog)


@function("INPUT")
def input_(x, informat, catalog=None) -> Column:
    """The value that an informat reads from text."""
    return formats.read(col(x), informat, catalog)


@function("SYMGET")
def symget(symbols: dict, name: str) -> Column:
    """The macro variable's text where the plan is built."""
    return F.lit(symbols[name.upper()])


@function("DIM")
def dim(array) -> Column:
    return F.lit(len(array)) if isinstance(array, (list, tuple)) else F.size(col(array))


def _seed(seed) -> int | None:
    return None if seed is None or seed <= 0 else int(seed)


@function("RANUNI")
def ranuni(seed=None) -> Column:
    return F.rand(_seed(seed))


@function("RANNOR")
def rannor(seed=None) -> Column:
    return F.randn(_seed(seed))


@function("RANEXP")
def ranexp(seed=None) -> Column:
    return -F.ln(1 - F.rand(_seed(seed)))


@function("RANBIN")
def ranbin(n: int, p: float, seed=None) -> Column:
    """Successes in n draws."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.when(F.rand(_seed(seed)) < p, 1).otherwise(0)), F.lit(0), lambda a, b: a + b) if seed is None else _inverse_binomial(n, p, seed)


def _inverse_binomial(n: int, p: float, seed) -> Column:
    from ..stats import dists

    u, out = F.rand(_seed(seed)), F.lit(n)
    for k in range(n - 1, -1, -1):
        out = F.when(u <= dists.binom_cdf(p, n, k), k).otherwise(out)
    return out


@function("RAND")
def rand(dist: str, *q, seed=None) -> Column:
    """UNIFORM, NORMAL, EXPONENTIAL, POISSON or BINOMIAL draws; the stream is Spark's own."""
    from ..stats import dists

    name = dist.upper()[:4]
    if name == "UNIF":
        low, high = q if q else (0.0, 1.0)
        return F.lit(low) + (high - low) * F.rand(_seed(seed))
    if name == "NORM":
        mean, sd = q if q else (0.0, 1.0)
        return F.lit(mean) + sd * F.randn(_seed(seed))
    if name == "EXPO":
        return ranexp(seed)
    if name == "BINO":
        return _inverse_binomial(int(q[1]), float(q[0]), seed if seed is not None else 0)
    if name == "POIS":
        most = int(q[0] + 12 * max(1.0, q[0]) ** 0.5 + 12)
        u, out = F.rand(_seed(seed)), F.lit(most)
        for k in range(most - 1, -1, -1):
            out = F.when(u <= dists.poisson_cdf(q[0], k), k).otherwise(out)
        return out
    raise ValueError(f"unknown distribution {dist}")
