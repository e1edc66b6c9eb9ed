"""Linear models from one distributed pass of cross products; matrices and solvers are on the driver (p x p)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stats import dists
from .inference import moments


@dataclass
class Fit:
    """A least-squares fit and the sums it came from. Index 0 of beta is the intercept if there is one."""

    y: str
    x: list[str]
    intercept: bool
    n: float
    means: np.ndarray
    cp: np.ndarray  # centred cross products of x then y
    beta: np.ndarray
    inverse: np.ndarray  # (X'X)^-1 in the order of beta
    sse: float
    sst: float
    weight: str | None = None

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def dfe(self) -> float:
        return self.n_rows - self.p

    @property
    def mse(self) -> float:
        return self.sse / self.dfe if self.dfe > 0 else math.nan

    n_rows: int = 0

    def names(self) -> list[str]:
        return (["Intercept"] if self.intercept else []) + self.x

    def stderr(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.mse * np.diag(self.inverse)))

    def anova(self) -> dict:
        dfm = self.p - self.intercept
        ssm = self.sst - self.sse
        f = ssm / dfm / self.mse if dfm and self.mse else math.nan
        r2 = ssm / self.sst if self.sst else math.nan
        adj = 1 - (self.n_rows - self.intercept) / self.dfe * (1 - r2) if self.dfe else math.nan
        return {"DF_MODEL": dfm, "DF_ERROR": self.dfe, "SS_MODEL": ssm, "SS_ERROR": self.sse, "F": f, "P": dists.f_p(f, dfm, self.dfe), "RMSE": math.sqrt(self.mse) if self.mse >= 0 else math.nan, "RSQUARE": r2, "ADJRSQ": adj, "MEAN": self.means[-1]}

    def predict(self) -> Column:
        """The fitted value as a row expression."""
        b = list(self.beta)
        out = F.lit(float(b.pop(0))) if self.intercept else F.lit(0.0)
        for c, k in zip(self.x, b, strict=True):
            out = out + F.col(c).cast("double") * float(k)
        return out

    def leverage(self) -> Column:
        cols = ([F.lit(1.0)] if self.intercept else []) + [F.col(c).cast("double") for c in self.x]
        out = F.lit(0.0)
        for i, j in itertools.product(range(self.p), repeat=2):
            out = out + cols[i] * cols[j] * float(self.inverse[i, j])
        return out * F.col(self.weight) if self.weight else out


def _solve(y: str, x: list[str], intercept: bool, w: float, means: np.ndarray, cp: np.ndarray, n_rows: int, weight: str | None) -> Fit:
    k = len(x)
    if intercept:
        sxx, sxy, sst = cp[:k, :k], cp[:k, k], cp[k, k]
        inv = np.linalg.pinv(sxx, hermitian=True) if k else np.zeros((0, 0))
        slopes = inv @ sxy
        mx = means[:k]
        beta = np.concatenate([[means[k] - slopes @ mx], slopes])
        full = np.zeros((k + 1, k + 1))
        full[0, 0] = 1 / w + mx @ inv @ mx
        full[0, 1:] = full[1:, 0] = -inv @ mx
        full[1:, 1:] = inv
        sse = sst - slopes @ sxy
    else:
        raw = cp + w * np.outer(means, means)
        full = np.linalg.pinv(raw[:k, :k], hermitian=True)
        beta = full @ raw[:k, k]
        sst = raw[k, k]
        sse = sst - beta @ raw[:k, k]
    return Fit(y, list(x), intercept, w, means, cp, beta, full, max(0.0, float(sse)), float(sst), weight, n_rows=n_rows)


def regress(df: DataFrame, y: str, x: Sequence[str], intercept: bool = True, weight: str | None = None, freq: str | None = None) -> Fit:
    """OLS or weighted least squares over complete rows."""
    cols = [*x, y]
    w, means, cp = moments(df, cols, weight or freq)
    rows = df.select(*cols, *([weight or freq] if weight or freq else [])).na.drop()
    n = int(rows.agg(F.sum(freq)).first()[0]) if freq else (rows.where(F.col(weight) > 0) if weight else rows).count() if weight else int(round(w))
    return _solve(y, list(x), intercept, w, means, cp, n, weight)


def subset(fit: Fit, x: Sequence[str]) -> Fit:
    """The fit of fewer regressors, from the same sums."""
    keep = [fit.x.index(c) for c in x] + [len(fit.x)]
    return _solve(fit.y, list(x), fit.intercept, fit.n, fit.means[keep], fit.cp[np.ix_(keep, keep)], fit.n_rows, fit.weight)


def estimates(df: DataFrame, fit: Fit) -> DataFrame:
    """Parameter estimates: ESTIMATE, STDERR, T, P, sequential and partial SS, standardised, partial and semi-partial
    correlations, tolerance and VIF."""
    se, rows = fit.stderr(), []
    k = len(fit.x)
    inter = int(fit.intercept)
    full = fit.sst - fit.sse
    before = 0.0
    for n, name in enumerate(fit.names()):
        b, s = float(fit.beta[n]), float(se[n])
        t = b / s if s else math.nan
        row = [name, b, s, t, dists.t_p(t, fit.dfe)]
        if n < inter:
            ss1 = fit.n * fit.means[-1] ** 2
            row += [ss1, b * b / fit.inverse[0, 0], None, None, None, None, None]
        else:
            part = subset(fit, fit.x[: n - inter + 1])
            seq = part.sst - part.sse
            ss2 = b * b / fit.inverse[n, n]
            sx, sy = fit.cp[n - inter, n - inter], fit.cp[k, k]
            others = subset(fit, [c for c in fit.x if c != name]) if k > 1 else None
            tol = 1 / (fit.inverse[n, n] * sx) if fit.intercept and sx else None
            row += [seq - before, ss2, b * math.sqrt(sx / sy) if sy else None, ss2 / (ss2 + fit.sse), ss2 / fit.sst if fit.sst else None, tol, 1 / tol if tol else None]
            before = seq
            del others
        rows.append(tuple(None if isinstance(v, float) and math.isnan(v) else v if isinstance(v, str) or v is None else float(v) for v in row))
    del full
    return df.sparkSession.createDataFrame(rows, "VARIABLE string, ESTIMATE double, STDERR double, T double, P double, SS1 double, SS2 double, STB double, PCORR2 double, SCORR2 double, TOL double, VIF double")


def output(df: DataFrame, fit: Fit, alpha: float = 0.05) -> DataFrame:
    """Row diagnostics as expressions: P R STDP STDR STDI limits STUDENT RSTUDENT COOKD H PRESS DFFITS COVRATIO."""
    t = dists.t_quantile(1 - alpha / 2, fit.dfe)
    mse, p, n = fit.mse, fit.p, fit.n_rows
    w = F.col(fit.weight).cast("double") if fit.weight else F.lit(1.0)
    out = df.withColumn("P", fit.predict()).withColumn("R", F.col(fit.y) - F.col("P")).withColumn("H", fit.leverage())
    h, r = F.col("H"), F.col("R") * F.sqrt(w)
    out = out.withColumns({"STDP": F.sqrt(h * mse / w), "STDR": F.sqrt((1 - h) * mse / w), "STDI": F.sqrt((1 + h) * mse / w)})
    out = out.withColumns({"LCLM": F.col("P") - t * F.col("STDP"), "UCLM": F.col("P") + t * F.col("STDP"), "LCL": F.col("P") - t * F.col("STDI"), "UCL": F.col("P") + t * F.col("STDI")})
    out = out.withColumn("STUDENT", F.try_divide(F.col("R"), F.col("STDR")))
    loo = F.sqrt((F.lit(fit.sse) - r * r / (1 - h)) / (fit.dfe - 1))
    out = out.withColumns({"PRESS": F.col("R") / (1 - h), "COOKD": F.col("STUDENT") * F.col("STUDENT") * h / (1 - h) / p, "RSTUDENT": F.try_divide(r, loo * F.sqrt(1 - h))})
    s = F.col("RSTUDENT")
    return out.withColumns({"DFFITS": s * F.sqrt(h / (1 - h)), "COVRATIO": 1 / (F.pow((n - p - 1 + s * s) / (n - p), p) * (1 - h))})


def dfbetas(df: DataFrame, fit: Fit) -> DataFrame:
    """Scaled change of each coefficient when the row is left out."""
    cols = ([F.lit(1.0)] if fit.intercept else []) + [F.col(c).cast("double") for c in fit.x]
    out = output(df, fit)
    for j, name in enumerate(fit.names()):
        c = sum((cols[i] * float(fit.inverse[j, i]) for i in range(fit.p)), F.lit(0.0))
        out = out.withColumn(f"DFB_{name}", F.col("RSTUDENT") * c / F.sqrt((1 - F.col("H")) * float(fit.inverse[j, j])))
    return out


def collinearity(fit: Fit, intercept: bool = True) -> list[tuple]:
    """(eigenvalue, condition index, variance proportions) of the scaled cross products; without intercept centred."""
    k = len(fit.x)
    if intercept and fit.intercept:
        raw = np.zeros((k + 1, k + 1))
        raw[0, 0], raw[0, 1:], raw[1:, 0] = fit.n, fit.n * fit.means[:k], fit.n * fit.means[:k]
        raw[1:, 1:] = fit.cp[:k, :k] + fit.n * np.outer(fit.means[:k], fit.means[:k])
    else:
        raw = fit.cp[:k, :k]
    d = np.sqrt(np.diag(raw))
    val, vec = np.linalg.eigh(raw / np.outer(d, d))
    order = np.argsort(-val)
    val, vec = np.maximum(val[order], 1e-300), vec[:, order]
    part = vec**2 / val
    part = part / part.sum(1, keepdims=True)
    return [(float(v), math.sqrt(val[0] / v), *map(float, part[:, i])) for i, v in enumerate(val)]


def durbin_watson(df: DataFrame, fit: Fit, order: Sequence[str]) -> dict:
    """Durbin-Watson statistic in row order and the first-order autocorrelation."""
    from .datastep import row_numbers

    r = row_numbers(df.select(*order, fit.y, *fit.x).na.drop(), order, "__n").select("__n", (F.col(fit.y) - fit.predict()).alias("r"))
    # the row before by an equi-join on the row number: no window over the whole table
    before = r.select((F.col("__n") + 1).alias("__n"), F.col("r").alias("b"))
    row = r.join(before, "__n", "left").agg(F.sum((F.col("r") - F.col("b")) ** 2).alias("d"), F.sum(F.col("r") ** 2).alias("s"), F.sum(F.col("r") * F.col("b")).alias("c")).first()
    d, rho, n, p = row["d"] / row["s"], row["c"] / row["s"], fit.n_rows, fit.p
    z = (d - 2) / (2 / math.sqrt(n)) if n else math.nan
    return {"DW": d, "AUTOCORR": rho, "P_POSITIVE": dists.norm_cdf(z), "P_NEGATIVE": 1 - dists.norm_cdf(z), "N": n, "PARMS": p}


def white(df: DataFrame, fit: Fit) -> tuple[np.ndarray, dict]:
    """The heteroscedasticity-consistent covariance (HC0) and White's specification test, in two more passes."""
    cols = fit.names()
    e2 = (F.col(fit.y) - fit.predict()) ** 2
    c = ([F.lit(1.0)] if fit.intercept else []) + [F.col(x).cast("double") for x in fit.x]
    pairs = list(itertools.combinations_with_replacement(range(fit.p), 2))
    own = df.select(fit.y, *fit.x).na.drop()
    row = own.agg(*[F.sum(e2 * c[i] * c[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((fit.p, fit.p))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    terms = {f"t{i}_{j}": c[i] * c[j] for i, j in pairs if not (fit.intercept and i == j == 0)}
    aux = own.select(e2.alias("e2"), *[v.alias(k) for k, v in terms.items()])
    f = regress(aux, "e2", list(terms))
    chi = f.n_rows * (1 - f.sse / f.sst)
    rank = int(np.linalg.matrix_rank(f.cp[:-1, :-1])) if terms else 0
    del cols
    return fit.inverse @ meat @ fit.inverse, {"DF": rank, "CHISQ": chi, "P": dists.chi_p(chi, rank)}


def select(fit: Fit, method: str, entry: float | None = None, stay: float | None = None, include: int = 0, stop: int | None = None) -> tuple[Fit, list[tuple]]:
    """FORWARD, BACKWARD, STEPWISE, MAXR, MINR on one set of sums: the final fit and the steps (action, variable, R2)."""
    method = method.upper()
    entry = {"FORWARD": 0.5, "STEPWISE": 0.15}.get(method, 0.5) if entry is None else entry
    stay = {"BACKWARD": 0.1, "STEPWISE": 0.15}.get(method, 0.1) if stay is None else stay
    fixed = fit.x[:include]
    now = list(fit.x) if method == "BACKWARD" else list(fixed)
    steps: list[tuple] = []
    r2 = lambda xs: 1 - subset(fit, xs).sse / fit.sst

    def p_of(xs: list[str], c: str) -> float:
        big, small = subset(fit, xs), subset(fit, [v for v in xs if v != c])
        return dists.f_p((small.sse - big.sse) / big.mse, 1, big.dfe) if big.mse > 0 else 0.0

    for _ in range(4 * len(fit.x) + 4):
        moved = False
        if method in ("FORWARD", "STEPWISE"):
            free = [(p_of([*now, c], c), c) for c in fit.x if c not in now]
            if free and (best := min(free))[0] <= entry:
                now.append(best[1])
                steps.append(("ENTER", best[1], r2(now)))
                moved = True
        if method in ("BACKWARD", "STEPWISE"):
            held = [(p_of(now, c), c) for c in now if c not in fixed]
            if held and (worst := max(held))[0] > stay:
                now.remove(worst[1])
                steps.append(("REMOVE", worst[1], r2(now)))
                moved = method == "BACKWARD" or worst[1] != (steps[-2][1] if len(steps) > 1 else None)
        if method in ("MAXR", "MINR"):
            if len(now) >= (stop or len(fit.x)):
                break
            now.append(max((r2([*now, c]), c) for c in fit.x if c not in now)[1])
            while True:
                swaps = [(r2([v if v != a else b for v in now]), a, b) for a in now if a not in fixed for b in fit.x if b not in now]
                better = [s for s in swaps if s[0] > r2(now) + 1e-12]
                if not better:
                    break
                _, a, b = max(better) if method == "MAXR" else min(better)
                now = [v if v != a else b for v in now]
            steps.append(("MODEL", " ".join(now), r2(now)))
            moved = True
        if not moved:
            break
    return subset(fit, now), steps


def all_subsets(fit: Fit, method: str = "RSQUARE", best: int | None = None, start: int = 1, stop: int | None = None, most: int = 16) -> list[dict]:
    """RSQUARE, ADJRSQ or CP over all subsets of at most `most` regressors."""
    if len(fit.x) > most:
        raise ValueError("too many regressors for all subsets")
    out = []
    for k in range(start, (stop or len(fit.x)) + 1):
        rows = []
        for xs in itertools.combinations(fit.x, k):
            f = subset(fit, xs)
            a = f.anova()
            rows.append({"SIZE": k, "VARS": " ".join(xs), "RSQUARE": a["RSQUARE"], "ADJRSQ": a["ADJRSQ"], "CP": f.sse / fit.mse + 2 * f.p - fit.n_rows})
        rows.sort(key=lambda r: -r["RSQUARE"])
        out += rows[:best] if best else rows
    key = {"RSQUARE": lambda r: (r["SIZE"], -r["RSQUARE"]), "ADJRSQ": lambda r: -r["ADJRSQ"], "CP": lambda r: r["CP"]}[method.upper()]
    return sorted(out, key=key)


def linear_test(fit: Fit, lhs: Sequence[Sequence[float]], rhs: Sequence[float] | None = None) -> dict:
    """TEST L b = c: F with its degrees of freedom."""
    m = np.atleast_2d(np.asarray(lhs, dtype=float))
    c = np.zeros(len(m)) if rhs is None else np.asarray(rhs, dtype=float)
    d = m @ fit.beta - c
    q = np.linalg.matrix_rank(m)
    ss = d @ np.linalg.pinv(m @ fit.inverse @ m.T) @ d
    f = ss / q / fit.mse
    return {"DF": int(q), "SS": float(ss), "F": float(f), "P": dists.f_p(float(f), q, fit.dfe)}


def restrict(fit: Fit, lhs: Sequence[Sequence[float]], rhs: Sequence[float] | None = None) -> Fit:
    """RESTRICT L b = c: the constrained fit."""
    m = np.atleast_2d(np.asarray(lhs, dtype=float))
    c = np.zeros(len(m)) if rhs is None else np.asarray(rhs, dtype=float)
    g = fit.inverse @ m.T @ np.linalg.pinv(m @ fit.inverse @ m.T)
    d = m @ fit.beta - c
    ss = d @ np.linalg.pinv(m @ fit.inverse @ m.T) @ d
    out = Fit(fit.y, fit.x, fit.intercept, fit.n, fit.means, fit.cp, fit.beta - g @ d, fit.inverse - g @ m @ fit.inverse, fit.sse + float(ss), fit.sst, fit.weight, n_rows=fit.n_rows + int(np.linalg.matrix_rank(m)))
    return out


def mtest(fits: Sequence[Fit], residual_cp: np.ndarray, lhs: Sequence[Sequence[float]]) -> dict:
    """MTEST over several responses with the same regressors: Wilks, Pillai, Hotelling-Lawley and Roy."""
    m = np.atleast_2d(np.asarray(lhs, dtype=float))
    b = np.column_stack([f.beta for f in fits])
    h = (m @ b).T @ np.linalg.pinv(m @ fits[0].inverse @ m.T) @ (m @ b)
    ev = np.maximum(0, np.real(np.linalg.eigvals(np.linalg.solve(residual_cp, h))))
    return {"WILKS": float(np.prod(1 / (1 + ev))), "PILLAI": float((ev / (1 + ev)).sum()), "HOTELLING": float(ev.sum()), "ROY": float(ev.max())}


def residual_products(df: DataFrame, fits: Sequence[Fit]) -> np.ndarray:
    """Cross products of the residuals of several responses."""
    own = df.select(*[f.y for f in fits], *fits[0].x).na.drop()
    r = [F.col(f.y) - f.predict() for f in fits]
    pairs = list(itertools.combinations_with_replacement(range(len(fits)), 2))
    row = own.agg(*[F.sum(r[i] * r[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(fits), len(fits)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"p{i}_{j}"]
    return out


def ridge(fit: Fit, ks: Sequence[float]) -> list[tuple]:
    """(k, intercept, slopes...) of ridge regressions in the correlation metric."""
    p = len(fit.x)
    d = np.sqrt(np.diag(fit.cp))
    r = fit.cp / np.outer(d, d)
    out = []
    for k in ks:
        b = np.linalg.solve(r[:p, :p] + k * np.eye(p), r[:p, p]) * d[p] / d[:p]
        out.append((float(k), float(fit.means[p] - b @ fit.means[:p]), *map(float, b)))
    return out


def incomplete_components(fit: Fit, drop: Sequence[int]) -> list[tuple]:
    """PCOMIT: fits that leave out the last m principal components."""
    p = len(fit.x)
    d = np.sqrt(np.diag(fit.cp))
    r = fit.cp / np.outer(d, d)
    val, vec = np.linalg.eigh(r[:p, :p])
    order = np.argsort(-val)
    out = []
    for m in drop:
        keep = order[: p - m]
        b = vec[:, keep] @ ((vec[:, keep].T @ r[:p, p]) / val[keep]) * d[p] / d[:p]
        out.append((int(m), float(fit.means[p] - b @ fit.means[:p]), *map(float, b)))
    return out


# ANOVA and GLM -----------------------------------------------------------------------------------------------------------
@dataclass
class Linear:
    """A general linear model over cell sums: the design has all levels of each class effect."""

    effects: list[str]
    columns: list[tuple[str, tuple]]  # effect and levels of each design column
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: float
    beta: np.ndarray
    ginv: np.ndarray
    levels: dict[str, list]

    def sse_of(self, effects: Sequence[str]) -> tuple[float, int]:
        keep = [k for k, (e, _) in enumerate(self.columns) if e == "Intercept" or e in effects]
        a = self.xtx[np.ix_(keep, keep)]
        b = np.linalg.pinv(a, hermitian=True, rcond=1e-12) @ self.xty[keep]
        return float(self.yty - b @ self.xty[keep]), int(np.linalg.matrix_rank(a, hermitian=True, tol=1e-9 * max(1.0, np.abs(a).max())))

    @property
    def sse(self) -> float:
        return self.sse_of(self.effects)[0]

    @property
    def rank(self) -> int:
        return self.sse_of(self.effects)[1]

    @property
    def dfe(self) -> float:
        return self.n - self.rank

    @property
    def mse(self) -> float:
        return self.sse / self.dfe

    def row(self, effect_levels: dict[str, object], numeric: dict[str, float] | None = None) -> np.ndarray:
        """The L row of a cell mean; effects left out are averaged over their levels."""
        out = np.zeros(len(self.columns))
        for k, (effect, values) in enumerate(self.columns):
            if effect == "Intercept":
                out[k] = 1
                continue
            x = 1.0
            for part, v in zip(effect.split("*"), values, strict=True):
                if part not in self.levels:
                    x *= (numeric or {}).get(part, 0.0)
                elif part in effect_levels:
                    x *= effect_levels[part] == v
                else:
                    x /= len(self.levels[part])
            out[k] = x
        return out

    def estimate(self, row: np.ndarray) -> dict:
        value = float(row @ self.beta)
        se = math.sqrt(max(0.0, float(row @ self.ginv @ row) * self.mse))
        t = value / se if se else math.nan
        return {"ESTIMATE": value, "STDERR": se, "T": t, "P": dists.t_p(t, self.dfe)}

    def contrast(self, rows: np.ndarray) -> dict:
        rows = np.atleast_2d(rows)
        d = rows @ self.beta
        q = np.linalg.matrix_rank(rows @ self.ginv @ rows.T)
        ss = float(d @ np.linalg.pinv(rows @ self.ginv @ rows.T) @ d)
        f = ss / q / self.mse
        return {"DF": int(q), "SS": ss, "F": float(f), "P": float(dists.f_p(float(f), q, float(self.dfe)))}

    def lsmeans(self, effect: str, numeric: dict[str, float] | None = None) -> list[dict]:
        parts = effect.split("*")
        return [{**dict(zip(parts, values, strict=True)), **self.estimate(self.row(dict(zip(parts, values, strict=True)), numeric))} for values in itertools.product(*(self.levels[p] for p in parts))]


def general_linear(df: DataFrame, y: str, effects: Sequence[str], classes: Sequence[str] = (), weight: str | None = None, most_cells: int = 200_000) -> Linear:
    """ANOVA / GLM: effects are class variables, numeric variables and their products (a*b).

    One aggregate by the class cells gives counts, sums and products of the numeric variables; the design algebra is on
    the driver over cells, whose number is checked."""
    numeric = list(dict.fromkeys(p for e in effects for p in e.split("*") if p not in classes))
    used = [c for c in classes if any(c in e.split("*") for e in effects)]
    own = df.select(y, *used, *numeric, *([weight] if weight else [])).na.drop()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    powers = [F.lit(1.0), *[F.col(c).cast("double") for c in numeric], F.col(y).cast("double")]
    pairs = list(itertools.combinations_with_replacement(range(len(powers)), 2))
    aggs = [F.sum(w * powers[i] * powers[j]).alias(f"m{i}_{j}") for i, j in pairs] + [F.count("*").alias("rows")]
    cells = (own.groupBy(*used).agg(*aggs) if used else own.agg(*aggs)).limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        raise ValueError("the design has too many cells")
    levels = {c: sorted({r[c] for r in cells}) for c in used}
    columns: list[tuple[str, tuple]] = [("Intercept", ())]
    for e in effects:
        columns += [(e, v) for v in itertools.product(*(levels.get(p, [None]) for p in e.split("*")))]
    size = len(columns)
    xtx, xty, yty, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
    for r in cells:
        m = np.zeros((len(powers), len(powers)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        # a column is an indicator of the cell times at most one numeric variable
        at, power = [], []
        for k, (e, values) in enumerate(columns):
            parts = e.split("*") if e != "Intercept" else []
            nums = [p for p in parts if p not in levels]
            if len(nums) > 1:
                raise ValueError("products of numeric variables must be columns of their own")
            if all(r[p] == v for p, v in zip(parts, values, strict=True) if p in levels):
                at.append(k)
                power.append(1 + numeric.index(nums[0]) if nums else 0)
        xtx[np.ix_(at, at)] += m[np.ix_(power, power)]
        xty[at] += m[power, -1]
        yty += m[-1, -1]
        n += r["rows"]
    ginv = np.linalg.pinv(xtx, hermitian=True, rcond=1e-12)
    return Linear(list(effects), columns, xtx, xty, yty, n, ginv @ xty, ginv, levels)


def type_one(model: Linear) -> list[dict]:
    """Sequential sums of squares."""
    out, done = [], []
    sse, rank = model.sse_of([])
    for e in model.effects:
        done.append(e)
        s, r = model.sse_of(done)
        ss, q = sse - s, r - rank
        f = ss / q / model.mse if q else math.nan
        out.append({"EFFECT": e, "DF": q, "SS": float(ss), "F": float(f), "P": float(dists.f_p(float(f), q, model.dfe))})
        sse, rank = s, r
    return out


def type_three(model: Linear) -> list[dict]:
    """Partial sums of squares: each effect's hypothesis on equally weighted cell means, from LS-mean contrasts."""
    out = []
    for e in model.effects:
        parts = e.split("*")
        if not all(p in model.levels for p in parts):
            rows = [row for row in _slopes(model, e)]
        else:
            rows = []
            # differences along every class of the effect, one level against its last
            grids = [[(v, model.levels[p][-1]) for v in model.levels[p][:-1]] for p in parts]
            for combo in itertools.product(*grids):
                row = np.zeros(len(model.columns))
                for picks in itertools.product((0, 1), repeat=len(parts)):
                    row += (-1) ** sum(picks) * model.row({p: c[k] for p, c, k in zip(parts, combo, picks, strict=True)})
                rows.append(row)
        c = model.contrast(np.array(rows))
        out.append({"EFFECT": e, **c})
    return out


def _slopes(model: Linear, effect: str) -> list[np.ndarray]:
    rows = []
    mine = [k for k, (e, _) in enumerate(model.columns) if e == effect]
    if len(mine) == 1:
        return [np.eye(len(model.columns))[mine[0]]]
    for k in mine[:-1]:
        row = np.zeros(len(model.columns))
        row[k], row[mine[-1]] = 1, -1
        rows.append(row)
    return rows
