"""Tests and association measures. One distributed pass gives cells, ranks or sums; the rest is closed form.

Tables of counts come to the driver at most levels x levels large, behind a checked limit.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stats import dists
from .running import cumulate
from .sorting import rank
from .summary import cells

MOST_CELLS = 250_000


def count_table(df: DataFrame, row: str, column: str, weight: str | None = None) -> tuple[list, list, np.ndarray]:
    """Row levels, column levels and the matrix of counts."""
    found = cells(df, [row, column], (), weight).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError("the table has too many cells")
    rows, cols = (sorted({r[x] for r in found}) for x in (row, column))
    out = np.zeros((len(rows), len(cols)))
    for r in found:
        out[rows.index(r[row]), cols.index(r[column])] = r["COUNT"]
    return rows, cols, out


def frame(df: DataFrame, values: dict) -> DataFrame:
    """One row of doubles."""
    names = list(values)
    plain = tuple(None if values[n] is None or (isinstance(values[n], float) and math.isnan(values[n])) else float(values[n]) for n in names)
    return df.sparkSession.createDataFrame([plain], ", ".join(f"{n} double" for n in names))


# FREQ ------------------------------------------------------------------------------------------------------------------
def _log_hyper(table: np.ndarray) -> float:
    lf = lambda x: math.lgamma(x + 1)
    return sum(map(lf, table.sum(1))) + sum(map(lf, table.sum(0))) - lf(table.sum()) - sum(map(lf, table.ravel()))


_log_factorial = np.vectorize(lambda x: math.lgamma(x + 1), otypes=[float])


def _log_tables(x: np.ndarray, r1: float, c1: float, n: float) -> np.ndarray:
    """Log probabilities of the 2x2 tables with x in the first cell and the given margins."""
    lf = lambda v: math.lgamma(v + 1)
    margins = lf(r1) + lf(n - r1) + lf(c1) + lf(n - c1) - lf(n)
    return margins - sum(map(_log_factorial, (x, r1 - x, c1 - x, n - r1 - c1 + x)))


def fisher(table: np.ndarray, most_tables: int = 500_000, draws: int = 10_000, seed: int = 20_260) -> dict:
    """Fisher's exact test: one-sided and two-sided for 2x2; Freeman-Halton enumeration for r x c. Where more than
    most_tables (the caller's bound) have the margins, `draws` random tables estimate it; DRAWS tells how many were drawn,
    0 for an exact result."""
    table = np.rint(np.asarray(table))
    p0 = _log_hyper(table)
    if table.shape == (2, 2):
        (a, b), (c, _) = table
        r1, c1, n = a + b, a + c, table.sum()
        low, high = max(0, r1 + c1 - n), min(r1, c1)
        left = right = two = 0.0
        own = math.exp(p0)
        for first in np.arange(low, high + 1, 1_000_000):  # logs of the ratios of neighbours, summed up from the own table
            x = np.arange(first, min(first + 1_000_000, high + 1))
            p = np.exp(_log_tables(x, r1, c1, n))
            left, right, two = left + p[x <= a].sum(), right + p[x >= a].sum(), two + p[p <= own * (1 + 1e-7)].sum()
        return {"LEFT": min(1.0, float(left)), "RIGHT": min(1.0, float(right)), "TWO": min(1.0, float(two)), "TABLE": own}
    rows, cols = [int(x) for x in table.sum(1)], [int(x) for x in table.sum(0)]
    lf = lambda x: math.lgamma(x + 1)
    base = sum(map(lf, rows)) + sum(map(lf, cols)) - lf(sum(rows))
    total, seen = 0.0, 0

    def fill(left: list[int], k: int, used: float) -> bool:
        """All tables with the given margins, a row at a time; False if there are too many."""
        nonlocal total, seen
        if k == len(rows) - 1:
            seen += 1
            lp = base - used - sum(map(lf, left))
            if lp <= p0 + 1e-7:
                total += math.exp(lp)
            return seen <= most_tables
        return all(fill([a - b for a, b in zip(left, r, strict=True)], k + 1, used + sum(map(lf, r))) for r in _splits(rows[k], left))

    if fill(cols, 0, 0.0):
        return {"TWO": min(1.0, total), "TABLE": math.exp(p0), "DRAWS": 0}
    rng = np.random.default_rng(seed)
    hits = 0
    for _ in range(draws):  # a row at a time from what the rows before left of the columns
        left, drawn = np.array(cols, dtype=np.int64), []
        for k in rows[:-1]:
            drawn.append(rng.multivariate_hypergeometric(left, k, method="marginals"))
            left = left - drawn[-1]
        hits += _log_hyper(np.array([*drawn, left], dtype=float)) <= p0 + 1e-7
    return {"TWO": hits / draws, "TABLE": math.exp(p0), "DRAWS": draws}


def _splits(n: int, most: list[int]):
    """All ways to deal n over places with at most most[k] each."""
    if len(most) == 1:
        if n <= most[0]:
            yield [n]
        return
    for x in range(max(0, n - sum(most[1:])), min(n, most[0]) + 1):
        for rest in _splits(n - x, most[1:]):
            yield [x, *rest]


def relative_risk(table: np.ndarray, alpha: float = 0.05) -> dict:
    """Odds ratio and column risks of a 2x2 table, with Wald limits on the log scale."""
    (a, b), (c, d) = np.asarray(table, dtype=float)
    z = dists.norm_quantile(1 - alpha / 2)
    out = {}
    for name, value, se in (
        ("OR", a * d / (b * c) if b * c else math.nan, math.sqrt(1 / a + 1 / b + 1 / c + 1 / d) if a * b * c * d else math.nan),
        ("RR1", (a / (a + b)) / (c / (c + d)) if c else math.nan, math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) if a * c else math.nan),
        ("RR2", (b / (a + b)) / (d / (c + d)) if d else math.nan, math.sqrt(1 / b - 1 / (a + b) + 1 / d - 1 / (c + d)) if b * d else math.nan),
    ):
        out |= {name: value, f"{name}_LOWER": value * math.exp(-z * se), f"{name}_UPPER": value * math.exp(z * se)}
    return out


def kappa(table: np.ndarray, alpha: float = 0.05) -> dict:
    """Cohen's kappa of a square table with its standard error and limits."""
    p = np.asarray(table, dtype=float) / np.sum(table)
    r, c = p.sum(1), p.sum(0)
    po, pe, n = np.trace(p), r @ c, np.sum(table)
    k = (po - pe) / (1 - pe)
    a = sum(p[i, i] * (1 - (r[i] + c[i]) * (1 - k)) ** 2 for i in range(len(p)))
    b = (1 - k) ** 2 * sum(p[i, j] * (c[i] + r[j]) ** 2 for i in range(len(p)) for j in range(len(p)) if i != j)
    se = math.sqrt(max(0.0, a + b - (k - pe * (1 - k)) ** 2) / n) / (1 - pe)
    z = dists.norm_quantile(1 - alpha / 2)
    return {"KAPPA": k, "ASE": se, "LOWER": k - z * se, "UPPER": k + z * se}


def trend(table: np.ndarray, scores: Sequence[float] | None = None) -> dict:
    """Cochran-Armitage Z of a 2 x c (or r x 2) table."""
    t = np.asarray(table, dtype=float)
    t = t.T if t.shape[0] != 2 else t
    s = np.arange(1, t.shape[1] + 1) if scores is None else np.asarray(scores, dtype=float)
    n, cols, p = t.sum(), t.sum(0), t[0].sum() / t.sum()
    top = (s * (t[0] - cols * p)).sum()
    var = p * (1 - p) * ((cols * s * s).sum() - (cols * s).sum() ** 2 / n)
    z = top / math.sqrt(var)
    return {"Z": z, "P_ONE": 1 - dists.norm_cdf(abs(z)), "P_TWO": dists.norm_p(z)}


def table_test(df: DataFrame, row: str, column: str, test: str, weight: str | None = None) -> DataFrame:
    """FISHER, RELRISK, AGREE, TREND or CHISQ of a two-way table as one row."""
    _, _, table = count_table(df, row, column, weight)
    if test.upper() == "CHISQ":
        e = np.outer(table.sum(1), table.sum(0)) / table.sum()
        x, dof = ((table - e) ** 2 / e).sum(), (table.shape[0] - 1) * (table.shape[1] - 1)
        g = 2 * sum(o * math.log(o / m) for o, m in zip(table.ravel(), e.ravel(), strict=True) if o)
        return frame(df, {"DF": dof, "CHISQ": x, "P_CHISQ": dists.chi_p(x, dof), "G2": g, "P_G2": dists.chi_p(g, dof)})
    return frame(df, {"FISHER": fisher, "RELRISK": relative_risk, "MEASURES": relative_risk, "AGREE": kappa, "TREND": trend}[test.upper()](table))


# CORR ------------------------------------------------------------------------------------------------------------------
def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None, complete: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, means, centred cross products) of complete rows, in one aggregate.

    Columns are shifted by their mean from a first aggregate, so sums don't cancel."""
    x = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("w > 0")
    if complete:
        x = x.na.drop()
    names = [f"c{k}" for k in range(len(cols))]
    shift = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    d = {c: F.col(c) - F.lit(shift[c] if shift[c] is not None else 0.0) for c in names}
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    row = x.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * d[c]).alias(f"s{c}") for c in names], *[F.sum(F.col("w") * d[names[i]] * d[names[j]]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    w = row["w"] or 0.0
    s = np.array([row[f"s{c}"] or 0.0 for c in names])
    cp = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cp[i, j] = cp[j, i] = (row[f"p{i}_{j}"] or 0.0) - (s[i] * s[j] / w if w else 0.0)
    means = np.array([shift[c] or 0.0 for c in names]) + (s / w if w else 0)
    return w, means, cp


def corr(df: DataFrame, var: Sequence[str], with_: Sequence[str] | None = None, method: str = "PEARSON", partial: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """VAR, WITH, N, R, P for each pair, pairwise complete; PEARSON, SPEARMAN, KENDALL (tau-b) or HOEFFDING (30 D)."""
    pairs = [(a, b) for a in var for b in with_] if with_ else list(itertools.combinations(var, 2))
    rows = []
    for a, b in pairs:
        own = df.select(a, b, *partial, *([weight] if weight else [])).na.drop()
        if method == "SPEARMAN":
            own = rank(own, [a, b], names=["__ra", "__rb"])
            cols = ["__ra", "__rb", *partial]
        else:
            cols = [a, b, *partial]
        n = own.count()
        if method in ("PEARSON", "SPEARMAN"):
            _, _, cp = moments(own, cols, weight)
            if partial:
                cp = cp[:2, :2] - cp[:2, 2:] @ np.linalg.solve(cp[2:, 2:], cp[2:, :2])
            r = cp[0, 1] / math.sqrt(cp[0, 0] * cp[1, 1]) if cp[0, 0] > 0 and cp[1, 1] > 0 else math.nan
            dof = n - 2 - len(partial)
            p = math.nan if dof <= 0 else 0.0 if abs(r) >= 1 else dists.t_p(r * math.sqrt(dof / (1 - r * r)), dof)
        elif method == "KENDALL":
            r, p = kendall(own, a, b)
        else:
            r, p = hoeffding(own, a, b)
        rows.append((a, b, int(n), None if r != r else float(r), None if p != p else float(p)))
    return df.sparkSession.createDataFrame(rows, "VAR string, `WITH` string, N long, R double, P double")


def kendall(df: DataFrame, a: str, b: str, most_levels: int = 4000) -> tuple[float, float]:
    """tau-b and its normal p-value from the table of distinct pairs, of which at most most_levels^2 are taken (checked)."""
    most = most_levels * most_levels
    cell = df.groupBy(a, b).agg(F.count("*").alias("n")).limit(most + 1).toPandas()
    if len(cell) > most:
        raise ValueError("Kendall's tau takes a bounded number of distinct pairs")
    x, y, n = cell[a].to_numpy(), cell[b].to_numpy(), cell["n"].to_numpy(dtype=float)
    xi, yi = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    # concordant minus discordant with a Fenwick tree over y, x in order
    order = np.lexsort((yi, xi))
    tree = np.zeros(yi.max() + 2)
    total, seen, s, k = n.sum(), 0.0, 0.0, 0

    def prefix(j: int) -> float:
        out = 0.0
        while j > 0:
            out += tree[j]
            j -= j & -j
        return out

    while k < len(order):
        m = k
        while m < len(order) and xi[order[m]] == xi[order[k]]:
            j = yi[order[m]] + 1
            below, upto = prefix(j - 1), prefix(j)
            s += n[order[m]] * (below - (seen - upto))
            m += 1
        for q in order[k:m]:
            j = yi[q] + 1
            seen += n[q]
            while j < len(tree):
                tree[j] += n[q]
                j += j & -j
        k = m
    tx, ty = np.bincount(xi, n), np.bincount(yi, n)
    t0 = total * (total - 1) / 2
    t1, t2 = (tx * (tx - 1) / 2).sum(), (ty * (ty - 1) / 2).sum()
    tau = s / math.sqrt((t0 - t1) * (t0 - t2))
    v0 = total * (total - 1) * (2 * total + 5)
    vt, vu = (tx * (tx - 1) * (2 * tx + 5)).sum(), (ty * (ty - 1) * (2 * ty + 5)).sum()
    v1 = (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * total * (total - 1))
    v2 = (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * total * (total - 1) * (total - 2)) if total > 2 else 0.0
    var = (v0 - vt - vu) / 18 + v1 + v2
    return tau, dists.norm_p(s / math.sqrt(var))


def hoeffding(df: DataFrame, a: str, b: str, most_rows: int = 20_000) -> tuple[float, float]:
    """Hoeffding's D (times 30); p-value from its asymptotic form. A bounded number of rows, checked."""
    pdf = df.select(a, b).limit(most_rows + 1).toPandas()
    if len(pdf) > most_rows:
        raise ValueError("Hoeffding's D takes a bounded number of rows")
    x, y = pdf[a].to_numpy(dtype=float), pdf[b].to_numpy(dtype=float)
    n = len(x)
    if n < 5:
        return math.nan, math.nan
    mid = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    r, s = mid(x), mid(y)
    q = np.array([1 + ((x < x[i]) & (y < y[i])).sum() + 0.5 * ((x == x[i]) & (y < y[i])).sum() + 0.5 * ((x < x[i]) & (y == y[i])).sum() + 0.25 * (((x == x[i]) & (y == y[i])).sum() - 1) for i in range(n)])
    d1, d2, d3 = ((q - 1) * (q - 2)).sum(), ((r - 1) * (r - 2) * (s - 1) * (s - 2)).sum(), ((r - 2) * (s - 2) * (q - 1)).sum()
    d = 30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4))
    z = (n - 1) * math.pi**4 / 60 * d / 30 + math.pi**4 / 72
    tail = math.exp(0.3885037 - 1.164879 * z) if z > 0 else 1.0
    return d, min(1.0, tail)


# TTEST -----------------------------------------------------------------------------------------------------------------
def ttest_one(df: DataFrame, v: str, h0: float = 0.0, alpha: float = 0.05, sides: str = "2") -> DataFrame:
    row = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(F.col(v).cast("double")).alias("s")).first()
    n, m, s = row["n"], row["m"], row["s"]
    dof = n - 1
    t = (m - h0) / (s / math.sqrt(n))
    p = {"2": dists.t_p(t, dof), "U": 1 - dists.t_cdf(t, dof), "L": dists.t_cdf(t, dof)}[sides]
    half = dists.t_quantile(1 - alpha / 2, dof) * s / math.sqrt(n)
    low, high = (dists.quantile("CHISQ", q, dof) for q in (alpha / 2, 1 - alpha / 2))
    return frame(df, {"N": n, "MEAN": m, "STD": s, "LCLM": m - half, "UCLM": m + half, "LCLSTD": s * math.sqrt(dof / high), "UCLSTD": s * math.sqrt(dof / low), "T": t, "DF": dof, "P": p})


def ttest_two(df: DataFrame, v: str, group: str, h0: float = 0.0) -> DataFrame:
    """Pooled and Satterthwaite tests and the folded F of two groups."""
    rows = df.where(F.col(v).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_samp(F.col(v).cast("double")).alias("s2")).orderBy(group).limit(3).collect()
    if len(rows) != 2:
        raise ValueError("two groups are needed")
    (n1, m1, s1), (n2, m2, s2) = ((r["n"], r["m"], r["s2"]) for r in rows)
    diff, dof = m1 - m2 - h0, n1 + n2 - 2
    pooled = ((n1 - 1) * s1 + (n2 - 1) * s2) / dof
    t = diff / math.sqrt(pooled * (1 / n1 + 1 / n2))
    se2 = s1 / n1 + s2 / n2
    ts, ds = diff / math.sqrt(se2), se2**2 / ((s1 / n1) ** 2 / (n1 - 1) + (s2 / n2) ** 2 / (n2 - 1))
    (f, a, b) = (s1 / s2, n1 - 1, n2 - 1) if s1 >= s2 else (s2 / s1, n2 - 1, n1 - 1)
    return frame(df, {"N1": n1, "N2": n2, "MEAN1": m1, "MEAN2": m2, "DIFF": m1 - m2, "T": t, "DF": dof, "P": dists.t_p(t, dof), "T_SATTERTHWAITE": ts, "DF_SATTERTHWAITE": ds, "P_SATTERTHWAITE": dists.t_p(ts, ds), "F": f, "F_NUM_DF": a, "F_DEN_DF": b, "P_F": min(1.0, 2 * dists.f_p(f, a, b))})


def ttest_paired(df: DataFrame, a: str, b: str, h0: float = 0.0, alpha: float = 0.05) -> DataFrame:
    return ttest_one(df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("__d")), "__d", h0, alpha)


# NPAR1WAY --------------------------------------------------------------------------------------------------------------
def npar1way(df: DataFrame, v: str, group: str, scores: str = "WILCOXON") -> DataFrame:
    """Linear rank statistics: WILCOXON, MEDIAN, SAVAGE or NORMAL scores; Z for two groups, chi-square for any number."""
    own = df.where(F.col(v).isNotNull() & F.col(group).isNotNull()).select(v, group)
    n = own.count()
    kind = scores.upper()
    if kind == "SAVAGE":
        own = rank(own, [v], method="SAVAGE", names=["__a"])
    elif kind in ("NORMAL", "VW"):
        own = rank(own, [v], method="VW", names=["__a"])
    else:
        own = rank(own, [v], names=["__a"])
        if kind == "MEDIAN":
            own = own.withColumn("__a", (F.col("__a") > (n + 1) / 2).cast("double"))
    part = own.groupBy(group).agg(F.count("*").alias("n"), F.sum("__a").alias("s"), F.sum(F.col("__a") * F.col("__a")).alias("q")).orderBy(group).collect()
    ni, si = np.array([r["n"] for r in part], dtype=float), np.array([r["s"] for r in part])
    mean = si.sum() / n
    ss = sum(r["q"] for r in part) - n * mean * mean
    h = (n - 1) / ss * (ni * (si / ni - mean) ** 2).sum()
    out = {"N": n, "GROUPS": len(part), "STATISTIC": si[0], "CHISQ": h, "DF": len(part) - 1, "P_CHISQ": dists.chi_p(h, len(part) - 1)}
    if len(part) == 2:
        small = int(np.argmin(ni))
        expect, std = ni[small] * mean, math.sqrt(ni[0] * ni[1] * ss / (n * (n - 1)))
        top = si[small] - expect
        correct = 0.5 if kind == "WILCOXON" else 0.0
        z = (top - math.copysign(correct, top) if abs(top) > correct else 0.0) / std
        out |= {"STATISTIC": si[small], "EXPECTED": expect, "STD": std, "Z": z, "P_TWO": dists.norm_p(z)}
    return frame(df, out)


def exact_wilcoxon(df: DataFrame, v: str, group: str, most: int = 30) -> DataFrame:
    """Permutation p-values of the rank sum for at most `most` rows, by counting sums over subsets."""
    own = rank(df.where(F.col(v).isNotNull() & F.col(group).isNotNull()).select(v, group), [v], names=["__a"])
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the exact test takes at most {most} rows")
    groups = sorted({r[group] for r in rows})
    first = [r["__a"] for r in rows if r[group] == groups[0]]
    doubled = [int(round(2 * r["__a"])) for r in rows]
    ways: dict[tuple[int, int], int] = {(0, 0): 1}
    for x in doubled:
        more = dict(ways)
        for (k, s), w in ways.items():
            if k < len(first):
                more[k + 1, s + x] = more.get((k + 1, s + x), 0) + w
        ways = more
    dist = {s: w for (k, s), w in ways.items() if k == len(first)}
    total, own_sum = sum(dist.values()), int(round(2 * sum(first)))
    mean = len(first) * sum(doubled) / len(doubled)
    one = sum(w for s, w in dist.items() if (s >= own_sum if own_sum >= mean else s <= own_sum)) / total
    two = sum(w for s, w in dist.items() if abs(s - mean) >= abs(own_sum - mean) - 1e-9) / total
    return frame(df, {"STATISTIC": own_sum / 2, "P_ONE": one, "P_TWO": two})


# Normality ---------------------------------------------------------------------------------------------------------------
def normality(df: DataFrame, v: str) -> DataFrame:
    """Kolmogorov-Smirnov D, Cramer-von Mises W2 and Anderson-Darling A2 against the fitted normal, from ranked values.

    Distinct values are counted first; the sums run over them with their running ranks."""
    from ..functions.distribution import batch

    x = F.col(v).cast("double")
    s = df.agg(F.count(v).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    n = s["n"]
    c = df.where(F.col(v).isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    c = cumulate(c, F.col("c"), ["x"], "hi")
    f = batch(lambda z: min(1 - 1e-16, max(1e-300, dists.norm_cdf(z))), (F.col("x") - s["m"]) / s["s"])
    c = c.withColumn("f", f).withColumn("lo", F.col("hi") - F.col("c"))
    # sums over the tied ranks lo + 1 .. hi
    k, lo, hi = F.col("c").cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double")
    middle = lo + hi  # mean of 2 i - 1; the mean square is larger by (c^2 - 1) / 3
    row = c.agg(
        F.max(F.greatest(hi / n - F.col("f"), F.col("f") - lo / n)).alias("d"),
        F.sum(k * (F.pow(F.col("f") - middle / (2.0 * n), F.lit(2.0)) + (k * k - 1) / (12.0 * n * n))).alias("w"),
        F.sum(k * (middle * F.ln("f") + (2.0 * n - middle) * F.ln(1 - F.col("f")))).alias("a"),
    ).first()
    d, w2, a2 = row["d"], row["w"] + 1 / (12 * n), -n - row["a"] / n
    w_mod, a_mod = w2 * (1 + 0.5 / n), a2 * (1 + 0.75 / n + 2.25 / n**2)
    # Stephens' p-value curves for the fitted normal. The last pieces are parabolas, which rise again beyond
    # the statistics they were fitted to (and overflow); from there on p is 0, as everything under the border's value.
    pa = 1 - math.exp(-13.436 + 101.14 * a_mod - 223.73 * a_mod**2) if a_mod < 0.2 else 1 - math.exp(-8.318 + 42.796 * a_mod - 59.938 * a_mod**2) if a_mod < 0.34 else math.exp(0.9177 - 4.279 * a_mod - 1.38 * a_mod**2) if a_mod < 0.6 else math.exp(1.2937 - 5.709 * a_mod + 0.0186 * a_mod**2) if a_mod < 13 else 0.0
    pw = 1 - math.exp(-13.953 + 775.5 * w_mod - 12542.61 * w_mod**2) if w_mod < 0.0275 else 1 - math.exp(-5.903 + 179.546 * w_mod - 1515.29 * w_mod**2) if w_mod < 0.051 else math.exp(0.886 - 31.62 * w_mod + 10.897 * w_mod**2) if w_mod < 0.092 else math.exp(1.111 - 34.242 * w_mod + 12.832 * w_mod**2) if w_mod < 1.1 else 0.0
    return frame(df, {"N": n, "D": d, "W2": w2, "A2": a2, "P_W2": min(1.0, max(0.0, pw)), "P_A2": min(1.0, max(0.0, pa))})


def shapiro_wilk(df: DataFrame, v: str, most: int = 2000) -> DataFrame:
    """Royston's W for at most `most` rows, checked."""
    rows = df.where(F.col(v).isNotNull()).select(F.col(v).cast("double").alias("x")).limit(most + 1).collect()
    n = len(rows)
    if not 3 <= n <= most:
        raise ValueError(f"Shapiro-Wilk takes 3 to {most} rows")
    x = np.sort([r["x"] for r in rows])
    m = np.array([dists.norm_quantile((k - 0.375) / (n + 0.25)) for k in range(1, n + 1)])
    ss, u = m @ m, 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    # Royston's (1995) polynomial coefficients.
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a = m / math.sqrt(phi)
            a[[0, -1, 1, -2]] = -an, an, -an1, an1
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -an, an
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    ln = math.log(n)
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        g = np.polyval([0.459, -2.273], n)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        p = 1 - dists.norm_cdf((-math.log(g - math.log(1 - w)) - mu) / sd)
    else:
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        p = 1 - dists.norm_cdf((math.log(1 - w) - mu) / sd)
    return frame(df, {"N": n, "W": w, "P": p})
