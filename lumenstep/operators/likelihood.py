"""Maximum-likelihood models: LOGISTIC, GENMOD, MIXED and GLIMMIX.

Rows are first collapsed to distinct covariate patterns with weights (one aggregate). Models without subjects then
iterate on the driver while the patterns are few, and otherwise run one distributed aggregate of weighted cross products
for each Newton step. Models with subjects reduce each subject to small sufficient statistics in Arrow groups.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stats import dists
from ..stats.optim import nelder_mead

MOST_PATTERNS = 50_000


def design(df: DataFrame, x: Sequence[str], classes: Sequence[str] = ()) -> tuple[dict[str, Column], dict[str, list]]:
    """Named design columns with an intercept; class variables are indicators against their last level."""
    out: dict[str, Column] = {"Intercept": F.lit(1.0)}
    levels: dict[str, list] = {}
    for c in x:
        if c in classes:
            levels[c] = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(10_001).collect())
            if len(levels[c]) > 10_000:
                raise ValueError(f"{c} has too many levels")
            for v in levels[c][:-1]:
                out[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
        else:
            out[c] = F.col(c).cast("double")
    return out, levels


def patterns(df: DataFrame, cols: dict[str, Column], y: Column, weight: str | None) -> DataFrame:
    """(x0.., y, w): distinct rows with their weights."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.select(*[c.alias(f"x{k}") for k, c in enumerate(cols.values())], y.alias("y"), w.alias("w")).na.drop().where("w > 0")
    return own.groupBy(*[f"x{k}" for k in range(len(cols))], "y").agg(F.sum("w").alias("w"), F.count("*").alias("rows"))


class _Data:
    """Weighted cross products for Newton steps: on the driver for few patterns, in Spark otherwise."""

    def __init__(self, df: DataFrame, p: int, most: int = MOST_PATTERNS):
        self.df, self.p = df, p
        pdf = df.limit(most + 1).toPandas()
        self.local = None
        if len(pdf) <= most:
            self.local = (pdf[[f"x{k}" for k in range(p)]].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), pdf["w"].to_numpy(dtype=float))
        else:
            self.df = df.persist()

    def step(self, beta: np.ndarray, terms, column_terms) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, score, information). terms(eta, y) -> (l, dl/deta, weight) in numpy, column_terms in Columns."""
        if self.local is not None:
            x, y, w = self.local
            ll, u, h = terms(x @ beta, y)
            return float((w * ll).sum()), x.T @ (w * u), (x * (w * h)[:, None]).T @ x
        xs = [F.col(f"x{k}") for k in range(self.p)]
        eta = sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
        ll, u, h = column_terms(eta, F.col("y"))
        w = F.col("w")
        pairs = list(itertools.combinations_with_replacement(range(self.p), 2))
        row = self.df.agg(F.sum(w * ll).alias("ll"), *[F.sum(w * u * x).alias(f"u{k}") for k, x in enumerate(xs)], *[F.sum(w * h * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        info = np.zeros((self.p, self.p))
        for i, j in pairs:
            info[i, j] = info[j, i] = row[f"h{i}_{j}"]
        return row["ll"], np.array([row[f"u{k}"] for k in range(self.p)]), info


def newton(data: _Data, start: np.ndarray, terms, column_terms, rounds: int = 50, tol: float = 1e-10):
    beta = start.copy()
    ll, u, h = data.step(beta, terms, column_terms)
    for _ in range(rounds):
        move = np.linalg.pinv(h, hermitian=True) @ u
        size = 1.0
        while True:
            new = data.step(beta + size * move, terms, column_terms)
            if new[0] >= ll - 1e-12 * abs(ll) or size < 1e-6:
                break
            size /= 2
        beta = beta + size * move
        done = abs(new[0] - ll) <= tol * (abs(ll) + 1e-8) and float(np.abs(size * move).max(initial=0)) < 1e-8 * (1 + np.abs(beta).max())
        ll, u, h = new
        if done:
            break
    return beta, ll, h


# LOGISTIC ----------------------------------------------------------------------------------------------------------------
def _phi(x):
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


_VEC = np.vectorize(dists.norm_cdf)


def _binary(link: str):
    def terms(eta, y):
        if link == "LOGIT":
            mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            d = mu * (1 - mu)
        elif link == "PROBIT":
            mu, d = np.clip(_VEC(eta), 1e-15, 1 - 1e-15), _phi(eta)
        else:
            e = np.exp(np.clip(eta, -700, 30))
            mu, d = np.clip(-np.expm1(-e), 1e-15, 1 - 1e-15), np.exp(np.clip(eta, -700, 30) - e)
        mu = np.clip(mu, 1e-15, 1 - 1e-15)
        v = mu * (1 - mu)
        return y * np.log(mu) + (1 - y) * np.log(1 - mu), (y - mu) * d / v, d * d / v

    def column_terms(eta, y):
        if link != "LOGIT":
            raise ValueError("only LOGIT runs over more patterns than the driver takes")
        mu = 1 / (1 + F.exp(-eta))
        v = mu * (1 - mu)
        return y * F.ln(mu) + (1 - y) * F.ln(1 - mu), y - mu, v

    return terms, column_terms


def logistic(df: DataFrame, y: str, x: Sequence[str], classes: Sequence[str] = (), event=None, link: str = "LOGIT", freq: str | None = None, alpha: float = 0.05) -> dict:
    """Binary response: parameters, standard errors, Wald tests, odds ratios, global LR, score and Wald tests."""
    cols, levels = design(df, x, classes)
    values = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().limit(3).collect())
    if len(values) != 2:
        raise ValueError("the response has not two levels; use logistic_ordinal for more")
    event = values[0] if event is None else event
    data = _Data(patterns(df, cols, F.when(F.col(y) == F.lit(event), 1.0).when(F.col(y).isNotNull(), 0.0), freq), len(cols))
    terms = _binary(link.upper())
    beta, ll, h = newton(data, np.zeros(len(cols)), *terms)
    cov = np.linalg.pinv(h, hermitian=True)
    null_start = np.zeros(len(cols))
    null = _Data(patterns(df, {"Intercept": F.lit(1.0)}, F.when(F.col(y) == F.lit(event), 1.0).when(F.col(y).isNotNull(), 0.0), freq), 1)
    b0, ll0, _ = newton(null, np.zeros(1), *terms)
    null_start[0] = b0[0]
    _, u, h0 = data.step(null_start, *terms)
    q = len(cols) - 1
    score = float(u @ np.linalg.pinv(h0, hermitian=True) @ u)
    wald = float(beta[1:] @ np.linalg.pinv(cov[1:, 1:], hermitian=True) @ beta[1:]) if q else 0.0
    z = dists.norm_quantile(1 - alpha / 2)
    se = np.sqrt(np.diag(cov))
    rows = [{"VARIABLE": n, "ESTIMATE": float(b), "STDERR": float(s), "WALD": float((b / s) ** 2) if s else math.nan, "P": dists.chi_p(float((b / s) ** 2), 1) if s else math.nan, "ODDS": math.exp(b), "ODDS_LOWER": math.exp(b - z * s), "ODDS_UPPER": math.exp(b + z * s)} for n, b, s in zip(cols, beta, se, strict=True)]
    return {"parameters": rows, "loglik": ll, "loglik0": ll0, "LR": 2 * (ll - ll0), "SCORE": score, "WALD": wald, "DF": q, "P_LR": dists.chi_p(2 * (ll - ll0), q), "P_SCORE": dists.chi_p(score, q), "P_WALD": dists.chi_p(wald, q), "AIC": -2 * ll + 2 * len(cols), "beta": beta, "cov": cov, "columns": cols, "levels": levels, "link": link.upper(), "event": event}


def logistic_output(df: DataFrame, fit: dict, p: str = "P_1", xbeta: str = "XBETA") -> DataFrame:
    """XBETA and the event probability of each row."""
    from ..functions.distribution import batch

    eta = sum((c * float(b) for c, b in zip(fit["columns"].values(), fit["beta"], strict=True)), F.lit(0.0))
    out = df.withColumn(xbeta, eta)
    link = {"LOGIT": lambda e: 1 / (1 + F.exp(-e)), "PROBIT": lambda e: batch(dists.norm_cdf, e), "CLOGLOG": lambda e: 1 - F.exp(-F.exp(e))}[fit["link"]]
    return out.withColumn(p, link(F.col(xbeta)))


def logistic_ordinal(df: DataFrame, y: str, x: Sequence[str], classes: Sequence[str] = (), freq: str | None = None) -> dict:
    """Proportional odds: P(Y <= k) = logistic(a_k + x b), over the collapsed patterns."""
    cols, _ = design(df, x, classes)
    slopes = {k: c for k, c in cols.items() if k != "Intercept"}
    values = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().limit(1001).collect())
    if len(values) > 1000:
        raise ValueError("an ordinal response has at most 1000 levels")
    code = F.lit(None).cast("double")
    for k, v in enumerate(values):
        code = F.when(F.col(y) == F.lit(v), float(k)).otherwise(code)
    pdf = patterns(df, slopes, code, freq).limit(MOST_PATTERNS + 1).toPandas()
    if len(pdf) > MOST_PATTERNS:
        raise ValueError("too many covariate patterns")
    xs = pdf[[f"x{k}" for k in range(len(slopes))]].to_numpy(dtype=float)
    yk, w = pdf["y"].to_numpy(dtype=int), pdf["w"].to_numpy(dtype=float)
    m, q = len(values) - 1, len(slopes)
    share = np.cumsum(np.bincount(yk, w, m + 1))[:-1] / w.sum()
    theta = np.concatenate([np.log(share / (1 - share)), np.zeros(q)])

    def parts(t):
        eta = t[:m][None, :] + (xs @ t[m:])[:, None]
        g = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        full = np.column_stack([np.zeros(len(g)), g, np.ones(len(g))])
        dens = np.column_stack([np.zeros(len(g)), g * (1 - g), np.zeros(len(g))])
        r = np.arange(len(yk))
        p = np.maximum(full[r, yk + 1] - full[r, yk], 1e-300)
        jac = np.zeros((len(yk), m + q))
        hi, lo = dens[r, yk + 1], dens[r, yk]
        up = yk < m
        jac[r[up], yk[up]] += hi[up]
        down = yk > 0
        jac[r[down], yk[down] - 1] -= lo[down]
        jac[:, m:] = (hi - lo)[:, None] * xs
        # expected information from all categories
        info = np.zeros((m + q, m + q))
        for k in range(m + 1):
            pk = np.maximum(full[:, k + 1] - full[:, k], 1e-300)
            jk = np.zeros((len(yk), m + q))
            if k < m:
                jk[:, k] += dens[:, k + 1]
            if k > 0:
                jk[:, k - 1] -= dens[:, k]
            jk[:, m:] = (dens[:, k + 1] - dens[:, k])[:, None] * xs
            info += (jk * (w / pk)[:, None]).T @ jk
        return float((w * np.log(p)).sum()), (jac * (w / p)[:, None]).sum(0), info

    ll, u, h = parts(theta)
    ll0 = ll
    for _ in range(100):
        move, size = np.linalg.solve(h, u), 1.0
        while size > 1e-6 and (new := parts(theta + size * move))[0] < ll:
            size /= 2
        theta = theta + size * move
        change = abs(new[0] - ll)
        ll, u, h = new
        if change < 1e-11 * (abs(ll) + 1):
            break
    cov = np.linalg.inv(h)
    names = [f"Intercept_{v}" for v in values[:-1]] + list(slopes)
    rows = [{"VARIABLE": n, "ESTIMATE": float(b), "STDERR": float(math.sqrt(v)), "WALD": float(b * b / v), "P": dists.chi_p(float(b * b / v), 1)} for n, b, v in zip(names, theta, np.diag(cov), strict=True)]
    return {"parameters": rows, "loglik": ll, "loglik0": ll0, "LR": 2 * (ll - ll0), "DF": q, "beta": theta, "cov": cov}


# GENMOD ------------------------------------------------------------------------------------------------------------------
_FAMILIES = {
    "NORMAL": (lambda m: m * 0 + 1, lambda y, m: (y - m) ** 2, "IDENTITY"),
    "POISSON": (lambda m: m, lambda y, m: 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - (y - m)), "LOG"),
    "BINOMIAL": (lambda m: m * (1 - m), lambda y, m: 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) + np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / (1 - m)), 0)), "LOGIT"),
    "GAMMA": (lambda m: m * m, lambda y, m: 2 * (-np.log(y / m) + (y - m) / m), "INVERSE"),
}
_LINKS = {
    "IDENTITY": (lambda m: m, lambda e: e, lambda e: e * 0 + 1),
    "LOG": (np.log, np.exp, np.exp),
    "LOGIT": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2),
    "INVERSE": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / e**2),
}


def genmod(df: DataFrame, y: str, x: Sequence[str], dist: str = "NORMAL", link: str | None = None, classes: Sequence[str] = (), freq: str | None = None, scale: str | None = None) -> dict:
    """Generalised linear models by iterative weighting over the collapsed patterns: deviance, Pearson, AIC, BIC; scale
    DEVIANCE or PEARSON rescales the covariance."""
    dist = dist.upper()
    variance, unit_deviance, canonical = _FAMILIES[dist]
    g, inv, slope = _LINKS[(link or canonical).upper()]
    cols, levels = design(df, x, classes)
    pdf = patterns(df, cols, F.col(y).cast("double"), freq).limit(MOST_PATTERNS * 20 + 1).toPandas()
    if len(pdf) > MOST_PATTERNS * 20:
        raise ValueError("too many distinct rows for this model's driver solver")
    xs, ys, w = pdf[[f"x{k}" for k in range(len(cols))]].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), pdf["w"].to_numpy(dtype=float)
    n = float(w.sum())
    mean = (w * ys).sum() / n
    mu = (ys + mean) / 2 if dist != "BINOMIAL" else (ys + 0.5) / 2
    mu = np.maximum(mu, 1e-8) if dist in ("POISSON", "GAMMA") else mu
    eta, dev = g(mu), math.inf
    for _ in range(200):
        d = slope(eta)
        z, ww = eta + (ys - mu) / d, w * d * d / variance(mu)
        a = (xs * ww[:, None]).T @ xs
        beta = np.linalg.pinv(a, hermitian=True) @ (xs.T @ (ww * z))
        eta = xs @ beta
        mu = inv(eta)
        mu = np.clip(mu, 1e-12, 1 - 1e-12) if dist == "BINOMIAL" else np.maximum(mu, 1e-12) if dist in ("POISSON", "GAMMA") else mu
        new = float((w * unit_deviance(ys, mu)).sum())
        if abs(new - dev) < 1e-12 * (abs(new) + 1):
            break
        dev = new
    dev = new
    pearson, dof = float((w * (ys - mu) ** 2 / variance(mu)).sum()), n - len(cols)
    if dist == "NORMAL":
        phi = dev / n
        ll = -n / 2 * (math.log(2 * math.pi * phi) + 1)
    elif dist == "POISSON":
        phi, ll = 1.0, float((w * (ys * np.log(mu) - mu - np.array([math.lgamma(v + 1) for v in ys]))).sum())
    elif dist == "BINOMIAL":
        phi, ll = 1.0, float((w * (ys * np.log(mu) + (1 - ys) * np.log(1 - mu))).sum())
    else:
        low, high = 1e-6, 1e8
        mean_dev = dev / n / 2
        for _ in range(200):  # ln v - digamma(v) falls with v
            mid = math.sqrt(low * high)
            low, high = (mid, high) if math.log(mid) - dists.digamma(mid) > mean_dev else (low, mid)
        v = math.sqrt(low * high)
        phi = 1 / v
        ll = float((w * (v * np.log(v * ys / mu) - v * ys / mu - np.log(ys) - math.lgamma(v))).sum())
    use = {"DEVIANCE": dev / dof, "PEARSON": pearson / dof}.get((scale or "").upper(), phi)
    cov = np.linalg.pinv(a, hermitian=True) * use
    k = len(cols) + (dist in ("NORMAL", "GAMMA"))
    rows = [{"VARIABLE": name, "ESTIMATE": float(b), "STDERR": float(math.sqrt(max(0, v))), "CHISQ": float(b * b / v) if v else math.nan, "P": dists.chi_p(float(b * b / v), 1) if v else math.nan} for name, b, v in zip(cols, beta, np.diag(cov), strict=True)]
    return {"parameters": rows, "DEVIANCE": dev, "PEARSON": pearson, "DF": dof, "LOGLIK": ll, "AIC": -2 * ll + 2 * k, "BIC": -2 * ll + k * math.log(n), "SCALE": phi, "beta": beta, "cov": cov, "columns": cols, "levels": levels}


# MIXED -------------------------------------------------------------------------------------------------------------------
def _subjects(df: DataFrame, y: str, cols: dict[str, Column], subject: str, time: str | None) -> pd.DataFrame:
    own = df.select(F.col(subject).alias("s"), F.col(y).cast("double").alias("y"), *[c.alias(f"x{k}") for k, c in enumerate(cols.values())], (F.col(time) if time else F.lit(0)).cast("double").alias("t"))
    return own.na.drop()


def mixed(df: DataFrame, y: str, x: Sequence[str], subject: str, classes: Sequence[str] = (), structure: str = "VC", method: str = "REML", time: str | None = None, most_shapes: int = 20_000) -> dict:
    """Linear mixed models. structure VC or CS: a random intercept per subject; AR(1) or UN: repeated measures in the
    order of `time` (UN needs the same times for every subject).

    For VC/CS a subject reduces to counts, sums and cross products, and subjects add up by size: one row for each
    distinct size reaches the driver. AR(1) reduces by exact sums of lagged products, UN by sums over pairs of times."""
    structure, method = structure.upper(), method.upper()
    cols, _ = design(df, x, classes)
    p = len(cols)
    rows = _subjects(df, y, cols, subject, time)
    names = [f"x{k}" for k in range(p)] + ["y"]
    pairs = list(itertools.combinations_with_replacement(range(p + 1), 2))
    c = [F.col(n) for n in names]
    if structure in ("VC", "CS"):
        own = rows.groupBy("s").agg(F.count("*").alias("m"), *[F.sum(v).alias(f"s{k}") for k, v in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs])
        shaped = own.groupBy("m").agg(F.count("*").alias("k"), *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs]).limit(most_shapes + 1).collect()
        if len(shaped) > most_shapes:
            raise ValueError("too many subject sizes")
        parts = [(r["m"], r["k"], _sym(r, "p", p + 1), _sym(r, "q", p + 1)) for r in shaped]
        n = sum(m * k for m, k, _, _ in parts)

        def given(theta):  # log variance ratio of the subject to the residual
            ratio = math.exp(theta[0])
            a, logdet = np.zeros((p + 1, p + 1)), 0.0
            for m, k, pp, qq in parts:
                a += pp - ratio / (1 + m * ratio) * qq
                logdet += k * math.log(1 + m * ratio)
            return a, logdet

        start, names_theta = np.zeros(1), ["ratio"]
    elif structure in ("AR(1)", "AR"):
        from .datastep import by_window

        w = by_window(["s"], ["t"])
        lagged = rows.withColumns({"__first": F.row_number().over(w) == 1, **{f"l_{v}": F.lag(v).over(w) for v in names}})
        lags = [F.col(f"l_{v}") for v in names]
        row = lagged.agg(F.count("*").alias("n"), F.sum(F.col("__first").cast("int")).alias("k"), *[F.sum(c[i] * c[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.coalesce(c[i] * lags[j] + lags[i] * c[j], F.lit(0.0))).alias(f"b{i}_{j}") for i, j in pairs], *[F.sum(F.coalesce(lags[i] * lags[j], F.lit(0.0))).alias(f"d{i}_{j}") for i, j in pairs], *[F.sum(F.when(F.col("__first"), c[i] * c[j]).otherwise(0.0)).alias(f"f{i}_{j}") for i, j in pairs]).first()
        n, k = row["n"], row["k"]
        aa, bb, dd, ff = (_sym(row, s, p + 1) for s in "abdf")

        def given(theta):
            rho = math.tanh(theta[0])
            a = ff + ((aa - ff) - rho * bb + rho * rho * dd) / (1 - rho * rho)
            return a, (n - k) * math.log(1 - rho * rho)

        start, names_theta = np.zeros(1), ["rho"]
    elif structure == "UN":
        times = [r[0] for r in rows.select("t").distinct().orderBy("t").limit(41).collect()]
        if len(times) > 40:
            raise ValueError("an unstructured covariance takes at most 40 times")
        m = len(times)
        wide = rows.groupBy("s").agg(F.count("*").alias("m"), *[F.max(F.when(F.col("t") == float(tt), F.col(v))).alias(f"{v}_{i}") for i, tt in enumerate(times) for v in names]).where(F.col("m") == m)
        grid = [(i, j) for i in range(m) for j in range(m)]
        row = wide.agg(F.count("*").alias("k"), *[F.sum(F.col(f"{names[u]}_{i}") * F.col(f"{names[v]}_{j}")).alias(f"g{i}_{j}_{u}_{v}") for i, j in grid for u in range(p + 1) for v in range(p + 1)]).first()
        k = row["k"]
        n = k * m
        g = np.array([[[[row[f"g{i}_{j}_{u}_{v}"] for v in range(p + 1)] for u in range(p + 1)] for j in range(m)] for i in range(m)])

        def chol(theta):
            low = np.zeros((m, m))
            low[np.tril_indices(m)] = theta
            low[np.diag_indices(m)] = np.exp(np.diag(low))
            return low

        def given(theta):
            low = chol(theta)
            inv = np.linalg.inv(low @ low.T)
            return np.einsum("ij,ijuv->uv", inv, g), 2 * k * np.log(np.diag(low)).sum()

        base = np.linalg.lstsq(sum(g[i, i, :p, :p] for i in range(m)), sum(g[i, i, :p, p] for i in range(m)), rcond=None)[0]
        resid = np.array([[g[i, j, p, p] - base @ g[i, j, :p, p] - g[i, j, p, :p] @ base + base @ g[i, j, :p, :p] @ base for j in range(m)] for i in range(m)]) / k
        low0 = np.linalg.cholesky(resid + 1e-9 * np.eye(m))
        low0[np.diag_indices(m)] = np.log(np.diag(low0))
        start, names_theta = low0[np.tril_indices(m)], [f"L{i}_{j}" for i, j in zip(*np.tril_indices(m), strict=True)]
    else:
        raise ValueError(f"the structure {structure} is not available")
    free = structure != "UN"  # the residual variance is profiled out

    def solved(theta):
        a, logdet = given(theta)
        xx, xy = a[:p, :p], a[:p, p]
        beta = np.linalg.solve(xx, xy)
        rss = a[p, p] - beta @ xy
        dof = n - p if method == "REML" else n
        s2 = max(rss / dof, 1e-300) if free else 1.0  # an exact fit
        value = logdet + (dof * math.log(s2) + dof if free else rss) + dof * math.log(2 * math.pi)
        if method == "REML":
            value += np.linalg.slogdet(xx)[1]
        return value, beta, s2, xx

    theta, value = nelder_mead(lambda th: solved(th)[0], start)
    _, beta, s2, xx = solved(theta)
    cov = np.linalg.inv(xx) * s2
    if structure in ("VC", "CS"):
        parms = {"SUBJECT": s2 * math.exp(theta[0]), "RESIDUAL": s2}
    elif free:
        parms = {"RHO": math.tanh(theta[0]), "RESIDUAL": s2}
    else:
        v = chol(theta) @ chol(theta).T
        parms = {f"UN({i + 1},{j + 1})": float(v[i, j]) for i in range(m) for j in range(i + 1)}
    rows_out = [{"EFFECT": nm, "ESTIMATE": float(b), "STDERR": float(math.sqrt(vv)), "T": float(b / math.sqrt(vv))} for nm, b, vv in zip(cols, beta, np.diag(cov), strict=True)]
    del names_theta
    parms = {k: float(v) for k, v in parms.items()}
    return {"fixed": rows_out, "covariance": parms, "NEG2LL": float(value), "N": n, "beta": beta, "cov": cov}


def _sym(row, prefix: str, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i, j in itertools.combinations_with_replacement(range(size), 2):
        out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"]
    return out


def glimmix(df: DataFrame, y: str, x: Sequence[str], subject: str, dist: str = "BINARY", classes: Sequence[str] = (), method: str = "RSPL", rounds: int = 60, most_rows: int = 500_000) -> dict:
    """Generalised linear mixed models with a random intercept: RSPL (pseudo-likelihood) or LAPLACE, for NORMAL,
    POISSON and BINARY responses; distinct rows per subject come to the driver, behind a checked number."""
    dist, method = dist.upper(), method.upper()
    if dist not in ("NORMAL", "POISSON", "BINARY"):
        raise ValueError(f"the distribution {dist} is not available")
    cols, _ = design(df, x, classes)
    p = len(cols)
    rows = _subjects(df, y, cols, subject, None).groupBy("s", "y", *[f"x{k}" for k in range(p)]).agg(F.count("*").alias("w")).limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError("too many rows for this model's driver solver")
    xs, ys, w = rows[[f"x{k}" for k in range(p)]].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float), rows["w"].to_numpy(dtype=float)
    ids = pd.factorize(rows["s"])[0]
    k = ids.max() + 1 if len(ids) else 0

    def mean(eta):
        if dist == "NORMAL":
            return eta, np.ones_like(eta)
        if dist == "POISSON":
            m = np.exp(np.clip(eta, -30, 30))
            return m, m
        m = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        return m, np.maximum(m * (1 - m), 1e-10)

    beta, b, tau = np.zeros(p), np.zeros(k), 1.0
    phi = float(np.var(ys)) if dist == "NORMAL" else 1.0

    def modes(beta, tau, phi, b):
        for _ in range(100):
            m, v = mean(xs @ beta + b[ids])
            grad = np.bincount(ids, w * (ys - m) / phi, k) - b / tau
            hess = np.bincount(ids, w * v / phi, k) + 1 / tau
            step = grad / hess
            b = b + step
            if np.abs(step).max(initial=0) < 1e-10:
                break
        return b, hess

    if method == "LAPLACE":

        def objective(theta):
            bt, t = theta[:p], math.exp(min(20, max(-20, theta[p])))
            ph = math.exp(theta[p + 1]) if dist == "NORMAL" else 1.0
            mode, hess = modes(bt, t, ph, np.zeros(k))
            eta = xs @ bt + mode[ids]
            if dist == "NORMAL":
                ll = w @ (-0.5 * np.log(2 * math.pi * ph) - (ys - eta) ** 2 / (2 * ph))
            elif dist == "POISSON":
                ll = w @ (ys * eta - np.exp(np.clip(eta, -30, 30)) - np.array([math.lgamma(v + 1) for v in ys]))
            else:
                ll = w @ (ys * eta - np.logaddexp(0, eta))
            return -2 * (ll - 0.5 * (mode**2 / t).sum() - 0.5 * k * math.log(t) - 0.5 * np.log(hess).sum())

        start = np.concatenate([beta, [0.0], [math.log(phi)] if dist == "NORMAL" else []])
        theta, value = nelder_mead(objective, start)
        return {"fixed": dict(zip(cols, map(float, theta[:p]), strict=True)), "covariance": {"SUBJECT": math.exp(theta[p])}, "NEG2LL": float(value)}
    for _ in range(rounds):
        eta = xs @ beta + b[ids]
        m, v = mean(eta)
        z, ww = eta + (ys - m) / v, w * v

        def neg(theta, z=z, ww=ww):
            t, s = math.exp(theta[0]), math.exp(theta[1]) if dist == "NORMAL" else 1.0
            sw = np.bincount(ids, ww, k) / s
            f = t / (1 + t * sw)
            sx = np.stack([np.bincount(ids, ww * xs[:, j], k) for j in range(p)]) / s
            sz = np.bincount(ids, ww * z, k) / s
            a = (xs * (ww / s)[:, None]).T @ xs - (sx * f) @ sx.T
            c = xs.T @ (ww * z) / s - (sx * f) @ sz
            bt = np.linalg.solve(a, c)
            rss = (ww * z * z).sum() / s - (f * sz * sz).sum() - bt @ c
            return np.log1p(t * sw).sum() + len(z) * math.log(s) + rss + np.linalg.slogdet(a)[1], bt

        theta, value = nelder_mead(lambda th: neg(th)[0], np.array([math.log(tau), math.log(phi)] if dist == "NORMAL" else [math.log(tau)]), tol=1e-13)
        new = neg(theta)[1]
        tau, phi = math.exp(theta[0]), math.exp(theta[1]) if dist == "NORMAL" else 1.0
        change = np.abs(new - beta).max(initial=0)
        beta = new
        sw = np.bincount(ids, ww, k) / phi
        b = tau / (1 + tau * sw) * np.bincount(ids, ww * (z - xs @ beta), k) / phi
        if change < 1e-8:
            break
    return {"fixed": dict(zip(cols, map(float, beta), strict=True)), "covariance": {"SUBJECT": tau, **({"RESIDUAL": phi} if dist == "NORMAL" else {})}, "NEG2PL": float(value)}
