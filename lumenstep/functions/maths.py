"""Mathematical functions; arguments outside the domain give missing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stats import dists
from ..values import col
from . import function

# plain one-argument functions
for _name, _fn in {"ABS": F.abs, "EXP": F.exp, "CEIL": F.ceil, "FLOOR": F.floor, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh}.items():
    function(_name)(lambda x, fn=_fn: fn(col(x)))


@function("SQRT")
def sqrt(x) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def _log(fn, x) -> Column:
    return F.when(col(x) > 0, fn(col(x)))


function("LOG")(lambda x: _log(F.ln, x))
function("LOG2")(lambda x: _log(F.log2, x))
function("LOG10")(lambda x: _log(F.log10, x))


@function("INT")
def int_(x) -> Column:
    x = col(x)
    return F.signum(x) * F.floor(F.abs(x))


@function("SIGN")
def sign(x) -> Column:
    return F.signum(col(x))


def _unit(x, unit, fn) -> Column:
    x, unit = col(x), col(unit)
    return F.when(unit == 0, x).otherwise(fn(F.abs(x) / F.when(unit != 0, F.abs(unit))) * F.abs(unit) * F.signum(x))


@function("ROUND")
def round_(x, unit=1) -> Column:
    """Half away from zero, to a multiple of unit."""
    return _unit(x, unit, lambda v: F.floor(v + 0.5))


@function("ROUNDZ")
def roundz(x, unit=1) -> Column:
    """Ties toward zero."""
    return _unit(x, unit, lambda v: F.ceil(v - 0.5))


@function("MOD")
def mod(x, y) -> Column:
    """Sign of the dividend; a zero divisor is missing."""
    y = col(y)
    return col(x) % F.when(y != 0, y)


@function("ARSIN")
def arsin(x) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.asin(col(x)))


@function("ARCOS")
def arcos(x) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.acos(col(x)))


@function("ATAN2")
def atan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def batch(fn, *args, many=None) -> Column:
    """A scalar function of doubles as an Arrow-batched function; any missing argument is missing. many: the same over
    whole arrays; where it gives NaN or an argument is infinite, fn decides."""

    def one(*row):
        if any(v is None or v != v for v in row):
            return None
        try:
            out = fn(*row)
        except (ValueError, OverflowError, ZeroDivisionError):
            return None
        return None if out is None or out != out else float(out)

    def column(*series: pd.Series) -> pd.Series:
        if many is None:
            return pd.Series([one(*row) for row in zip(*series, strict=True)], dtype="float64")
        rows = [s.to_numpy(dtype=float) for s in series]
        out, good = np.full(len(rows[0]), np.nan), np.isfinite(rows).all(axis=0)
        with np.errstate(all="ignore"):
            out[good] = many(*[r[good] for r in rows])
        for k in np.flatnonzero(np.isnan(out) & ~np.isnan(rows).any(axis=0)).tolist():
            value = one(*[float(r[k]) for r in rows])
            out[k] = np.nan if value is None else value
        return pd.Series(out)

    n = len(args)
    if n == 1:

        @F.pandas_udf("double")
        def run(a: pd.Series) -> pd.Series:
            return column(a)
    elif n == 2:

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return column(a, b)
    elif n == 3:

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return column(a, b, c)
    else:

        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return column(a, b, c, d)

    return F.nanvl(run(*[col(a).cast("double") for a in args]), F.lit(None).cast("double"))


function("GAMMA")(lambda x: batch(math.gamma, x))
function("LGAMMA")(lambda x: batch(lambda v: math.lgamma(v) if v > 0 else None, x))
function("DIGAMMA")(lambda x: batch(dists.digamma, x))
function("TRIGAMMA")(lambda x: batch(dists.trigamma, x))
function("BETA")(lambda a, b: batch(lambda p, q: math.exp(math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)) if p > 0 and q > 0 else None, a, b))


@function("FACT")
def fact(x) -> Column:
    """Exact to 20!, by the product in double precision beyond."""
    x = col(x).cast("double")
    ok = (x >= 0) & (x == F.floor(x)) & (x <= 170)
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(ok, x).otherwise(1).cast("int"))), F.lit(1.0), lambda a, b: a * b)
    return F.when(ok, product)


def _choose(n, k, divide: bool) -> Column:
    n, k = col(n).cast("double"), col(k).cast("double")
    ok = (n >= 0) & (k >= 0) & (n == F.floor(n)) & (k == F.floor(k))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(ok & (k <= n), k).otherwise(1).cast("int")))
    out = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / (i if divide else F.lit(1)))
    return F.when(ok, F.when(k > n, 0.0).when(k == 0, 1.0).otherwise(F.round(out) if divide else out))


function("COMB")(lambda n, k: _choose(n, k, True))
function("PERM")(lambda n, k=None: fact(n) if k is None else _choose(n, k, False))
