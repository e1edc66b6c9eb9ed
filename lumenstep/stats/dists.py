"""Distribution functions from series and continued fractions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_TINY = 1e-300
_CLOSE = 4e-16  # two units of rounding: a factor may never come closer to one


def digamma(x: float) -> float:
    if x <= 0 and x == math.floor(x):
        raise ValueError("pole")
    if x < 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    if x <= 0 and x == math.floor(x):
        raise ValueError("pole")
    if x < 0:
        return -trigamma(1 - x) + (math.pi / math.sin(math.pi * x)) ** 2
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _CLOSE:
            break
    return max(0.0, 1 - front * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    # where both sides are at the border by rounding, either fraction converges
    return 1 - _beta_fraction(b, a, 1 - x) if x >= (a + 1) / (a + b + 2) else _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, which converges fast below (a + 1) / (a + b + 2)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _CLOSE:
            break
    return front * h / a


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def chi_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def poisson_cdf(m: float, k: float) -> float:
    return 0.0 if k < 0 else 1 - gamma_p(math.floor(k) + 1, m)


def binom_cdf(p: float, n: float, k: float) -> float:
    k = math.floor(k)
    return 0.0 if k < 0 else 1.0 if k >= n else beta_i(n - k, k + 1, 1 - p)


def cdf(name: str, x: float, *q: float) -> float:
    name = name.upper()[:4]
    if name in ("NORM", "GAUS"):
        mean, sd = (q + (0.0, 1.0)[len(q) :])[:2]
        return norm_cdf((x - mean) / sd)
    if name == "T":
        return t_cdf(x, q[0])
    if name == "F":
        return f_cdf(x, q[0], q[1])
    if name in ("CHIS", "CHI"):
        return chi_cdf(x, q[0])
    if name == "BETA":
        return beta_i(q[0], q[1], x)
    if name == "GAMM":
        return gamma_p(q[0], x / (q[1] if len(q) > 1 else 1.0))
    if name == "BINO":
        return binom_cdf(q[0], q[1], x)
    if name == "POIS":
        return poisson_cdf(q[0], x)
    raise ValueError(f"unknown distribution {name}")


def pdf(name: str, x: float, *q: float) -> float:
    name = name.upper()[:4]
    if name in ("NORM", "GAUS"):
        mean, sd = (q + (0.0, 1.0)[len(q) :])[:2]
        return norm_pdf((x - mean) / sd) / sd
    if name == "T":
        n = q[0]
        return math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
    if name == "F":
        a, b = q[0], q[1]
        if x <= 0:
            return 0.0
        logd = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b) + (a / 2 - 1) * math.log(x) - (a + b) / 2 * math.log1p(a * x / b)
        return math.exp(logd)
    if name in ("CHIS", "CHI"):
        return pdf("GAMMA", x, q[0] / 2, 2.0)
    if name == "BETA":
        a, b = q[0], q[1]
        return 0.0 if not 0 < x < 1 else math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x))
    if name == "GAMM":
        a, s = q[0], q[1] if len(q) > 1 else 1.0
        return 0.0 if x <= 0 else math.exp((a - 1) * math.log(x / s) - x / s - math.lgamma(a)) / s
    if name == "BINO":
        p, n = q[0], q[1]
        return 0.0 if x < 0 or x > n or x != math.floor(x) else math.comb(int(n), int(x)) * p**x * (1 - p) ** (n - x)
    if name == "POIS":
        return 0.0 if x < 0 or x != math.floor(x) else math.exp(-q[0] + x * math.log(q[0]) - math.lgamma(x + 1))
    raise ValueError(f"unknown distribution {name}")


def norm_quantile(p: float) -> float:
    return quantile("NORMAL", p)


def quantile(name: str, p: float, *q: float) -> float:
    """Inverse distribution function by bisection."""
    if not 0 < p < 1:
        raise ValueError("p outside (0, 1)")
    short = name.upper()[:4]
    if short in ("BINO", "POIS"):
        k = 0
        while cdf(name, k, *q) < p:
            k += 1
        return float(k)
    if short in ("NORM", "GAUS"):
        mean, sd = (q + (0.0, 1.0)[len(q) :])[:2]
        return mean + sd * _bisect(norm_cdf, p, -40.0, 40.0)
    if short == "BETA":
        return _bisect(lambda x: cdf(name, x, *q), p, 0.0, 1.0)
    low, high = (-1.0, 1.0) if short == "T" else (0.0, 1.0)
    while cdf(name, high, *q) < p:
        high *= 2
    while short == "T" and cdf(name, low, *q) > p:
        low *= 2
    return _bisect(lambda x: cdf(name, x, *q), p, low, high)


def _bisect(fn, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if fn(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return quantile("T", p, df)


def t_p(t: float, df: float) -> float:
    """Two-sided p-value."""
    return float("nan") if df <= 0 or t != t else 2 * (1 - t_cdf(abs(t), df)) if abs(t) < 5 else beta_i(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return float("nan") if f != f or d1 <= 0 or d2 <= 0 else 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi_p(x: float, df: float) -> float:
    return float("nan") if x != x or df <= 0 else max(0.0, 1 - chi_cdf(x, df))


def norm_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


# Whole arrays ------------------------------------------------------------------------------------------------------------
# The functions above over arrays of doubles, all of one length. NaN stands where the scalar function has to decide.
def _each(fn: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(fn, x.tolist()), dtype=float, count=len(x))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.full(len(x), math.lgamma(x[0])) if len(x) and (x == x[0]).all() else _each(math.lgamma, x)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > _TINY, x, _TINY)


def _repeat(step: Callable, state: list[np.ndarray], rounds: int = 10_000) -> np.ndarray:
    """Runs step(k, *state) -> (state, done) until every element is done; done elements leave. The last array is returned."""
    out, at = np.full(len(state[0]), np.nan), np.arange(len(state[0]))
    for k in range(1, rounds):
        if not len(at):
            break
        state, done = step(k, *state)
        if done.any():
            out[at[done]] = state[-1][done]
            state, at = [v[~done] for v in state], at[~done]
    out[at] = state[-1]
    return out


def gamma_p_many(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(x <= 0, 0.0, np.nan)
    near, far = (x > 0) & (a > 0) & (x < a + 1), (x > 0) & (a > 0) & (x >= a + 1)
    front = lambda p, v: np.exp(-v + p * np.log(v) - _lgamma(p))

    def series(_, k, v, term, total):
        k = k + 1
        term = term * v / k
        total = total + term
        return [k, v, term, total], np.abs(term) <= np.abs(total) * 1e-16

    if near.any():
        p, v = a[near], x[near]
        out[near] = np.minimum(1.0, front(p, v) * _repeat(series, [p, v, 1 / p, 1 / p], 1_000_000))

    def fraction(i, p, b, c, d, h):
        an = -i * (i - p)
        b = b + 2
        d = 1 / _away(an * d + b)
        c = _away(b + an / c)
        h = h * d * c
        return [p, b, c, d, h], np.abs(d * c - 1) < _CLOSE

    if far.any():
        p, v = a[far], x[far]
        b = v + 1 - p
        out[far] = np.maximum(0.0, 1 - front(p, v) * _repeat(fraction, [p, b, np.full(len(p), 1 / _TINY), 1 / b, 1 / b]))
    return out


def beta_i_many(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    own = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if not own.any():
        return out
    a, b, x = a[own], b[own], x[own]
    turn = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))

    def fraction(m, p, q, y, c, d, h):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _away(1 + num * d)
            c = _away(1 + num / c)
            h = h * d * c
        return [p, q, y, c, d, h], np.abs(d * c - 1) < _CLOSE

    d = 1 / _away(1 - (p + q) * y / (p + 1))
    got = front * _repeat(fraction, [p, q, y, np.ones(len(p)), d, d]) / p
    out[own] = np.where(turn, 1 - got, got)
    return out


def norm_cdf_many(x: np.ndarray) -> np.ndarray:
    return 0.5 * _each(math.erfc, -x / math.sqrt(2))


def t_cdf_many(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        tail = 0.5 * beta_i_many(df / 2, np.full(len(x), 0.5), np.where(df > 0, df / (df + x * x), np.nan))
    return np.where(x > 0, 1 - tail, tail)


def f_cdf_many(x: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.where(x <= 0, 0.0, beta_i_many(d1 / 2, d2 / 2, np.where((d1 > 0) & (d2 > 0), d1 * x / (d1 * x + d2), np.nan)))


def poisson_cdf_many(m: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.where(k < 0, 0.0, 1 - gamma_p_many(np.floor(np.maximum(k, 0)) + 1, m))


def binom_cdf_many(p: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    k = np.floor(k)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, beta_i_many(n - k, k + 1, 1 - p)))


def cdf_many(name: str, x: np.ndarray, *q: np.ndarray) -> np.ndarray:
    """NaN throughout for names and numbers of parameters that only the scalar function knows."""
    short = name.upper()[:4]
    if short in ("NORM", "GAUS"):
        with np.errstate(all="ignore"):
            z = (x - q[0] if q else x) / (q[1] if len(q) > 1 else 1.0)
        return norm_cdf_many(z)
    if short == "GAMM" and len(q) == 2:
        with np.errstate(all="ignore"):
            return gamma_p_many(q[0], np.where(q[1] > 0, x / q[1], np.nan))
    known = {"T": (1, t_cdf_many), "F": (2, f_cdf_many), "CHIS": (1, lambda v, n: gamma_p_many(n / 2, v / 2)), "CHI": (1, lambda v, n: gamma_p_many(n / 2, v / 2)), "BETA": (2, lambda v, a, b: beta_i_many(a, b, v)), "GAMM": (1, lambda v, a: gamma_p_many(a, v)), "BINO": (2, lambda v, p, n: binom_cdf_many(p, n, v)), "POIS": (1, lambda v, m: poisson_cdf_many(m, v))}
    count, fn = known.get(short, (-1, None))
    return fn(x, *q) if len(q) == count else np.full(len(x), np.nan)


def quantile_many(name: str, p: np.ndarray, *q: np.ndarray) -> np.ndarray:
    """Bisection of all elements at once, for the T, F, CHISQ, GAMMA and BETA distributions."""
    short = name.upper()[:4]
    out = np.full(len(p), np.nan)
    own = (p > 0) & (p < 1)
    for v in q:
        own &= v > 0
    if short not in ("T", "F", "CHIS", "CHI", "GAMM", "BETA") or not own.any():
        return out
    p, q = p[own], [v[own] for v in q]
    fn = lambda x, k: cdf_many(name, x, *[v[k] for v in q])
    every = np.arange(len(p))
    low, high = np.full(len(p), -1.0 if short == "T" else 0.0), np.ones(len(p))
    for end, short_of in () if short == "BETA" else ((high, lambda v, k: fn(v, k) < p[k]), *([(low, lambda v, k: fn(v, k) > p[k])] if short == "T" else [])):
        at = every
        while len(at := at[short_of(end[at], at)]):
            end[at] *= 2
    at = every
    for _ in range(200):
        mid = (low[at] + high[at]) / 2
        at = at[(mid != low[at]) & (mid != high[at])]
        if not len(at):
            break
        mid = (low[at] + high[at]) / 2
        value = fn(mid, at)
        under = value < p[at]
        low[at[under]], high[at[~under]] = mid[under], mid[~under]
        low[at[np.isnan(value)]] = np.nan
        at = at[~np.isnan(value)]
    out[own] = (low + high) / 2
    return out
