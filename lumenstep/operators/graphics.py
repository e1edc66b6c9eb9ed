"""The data series of plots: aggregates in Spark, curves from bounded summaries. No images are drawn."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regression import regress
from .summary import definition5, statistic


def bars(df: DataFrame, x: str, response: str | None = None, stat: str = "FREQ", group: str | None = None) -> DataFrame:
    """VBAR, HBAR, PIE: FREQ, SUM or MEAN of each category."""
    value = F.count("*") if stat.upper() == "FREQ" else statistic(stat.upper(), response)
    return df.where(F.col(x).isNotNull()).groupBy(*([group] if group else []), x).agg(value.alias(stat.upper()))


def series(df: DataFrame, x: str, y: str, group: str | None = None, most_points: int = 5000) -> DataFrame:
    """SERIES, SCATTER, PLOT y*x=group: the points, or grid means when there are more than most_points."""
    keys = [group] if group else []
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if own.limit(most_points + 1).count() <= most_points:
        return own.orderBy(*keys, x)
    lo, hi = own.agg(F.min(x), F.max(x)).first()
    width = (float(hi) - float(lo)) / most_points or 1.0
    cell = F.floor((F.col(x).cast("double") - float(lo)) / width)
    return own.groupBy(*keys, cell.alias("__c")).agg(F.avg(x).alias(x), F.avg(y).alias(y)).drop("__c").orderBy(*keys, x)


def box(df: DataFrame, y: str, category: str | None = None) -> DataFrame:
    """VBOX: quartiles, mean, whiskers within 1.5 interquartile ranges, and the number of outliers."""
    keys = [category] if category else []
    x = F.col(y).cast("double")
    counted = df.where(F.col(y).isNotNull()).groupBy(*keys, x.alias("__x")).agg(F.count("*").alias("__c"))
    q = definition5(counted, keys, {"Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75}, source=df.select(x.alias("__x")))
    joined = counted.join(q, keys) if keys else counted.crossJoin(F.broadcast(q))
    lo = F.col("q_Q1") - 1.5 * (F.col("q_Q3") - F.col("q_Q1"))
    hi = F.col("q_Q3") + 1.5 * (F.col("q_Q3") - F.col("q_Q1"))
    inside = F.col("__x").between(lo, hi)
    agg = [F.max("q_Q1").alias("Q1"), F.max("q_MEDIAN").alias("MEDIAN"), F.max("q_Q3").alias("Q3"), (F.sum(F.col("__x") * F.col("__c")) / F.sum("__c")).alias("MEAN"), F.min(F.when(inside, F.col("__x"))).alias("LOW"), F.max(F.when(inside, F.col("__x"))).alias("HIGH"), F.sum(F.when(~inside, F.col("__c")).otherwise(0)).alias("OUTLIERS")]
    return joined.groupBy(*keys).agg(*agg) if keys else joined.agg(*agg)


def density(df: DataFrame, v: str, kind: str = "NORMAL", points: int = 200, bins: int = 2000) -> list[tuple[float, float]]:
    """NORMAL or KERNEL density over a grid; the kernel runs over a histogram of fixed size."""
    x = F.col(v).cast("double")
    s = df.agg(F.count(v).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not s["n"] or not s["s"]:
        return []
    if kind.upper() == "NORMAL":
        grid = np.linspace(s["m"] - 4 * s["s"], s["m"] + 4 * s["s"], points)
        return [(float(g), math.exp(-(((g - s["m"]) / s["s"]) ** 2) / 2) / (s["s"] * math.sqrt(2 * math.pi))) for g in grid]
    width = (s["hi"] - s["lo"]) / bins or 1.0
    got = df.where(F.col(v).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((x - s["lo"]) / width)).alias("b")).count().collect()
    mids = np.array([s["lo"] + (r["b"] + 0.5) * width for r in got])
    n = np.array([r["count"] for r in got], dtype=float)
    h = 1.06 * s["s"] * s["n"] ** -0.2
    grid = np.linspace(s["lo"] - 3 * h, s["hi"] + 3 * h, points)
    return [(float(g), float((n * np.exp(-(((g - mids) / h) ** 2) / 2)).sum() / (s["n"] * h * math.sqrt(2 * math.pi)))) for g in grid]


def regression_line(df: DataFrame, x: str, y: str, points: int = 50) -> list[tuple[float, float]]:
    fit = regress(df, y, [x])
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    return [(float(g), float(fit.beta[0] + fit.beta[1] * g)) for g in np.linspace(float(lo), float(hi), points)]


def loess(df: DataFrame, x: str, y: str, smooth: float = 0.5, points: int = 50, bins: int = 2000) -> list[tuple[float, float]]:
    """Local linear regression with tricube weights over means of a fixed grid."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lo, hi = own.agg(F.min("x"), F.max("x")).first()
    width = (hi - lo) / bins or 1.0
    got = own.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width)).alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect()
    xs, ys, n = (np.array([r[k] for r in got], dtype=float) for k in ("x", "y", "n"))
    out = []
    for g in np.linspace(lo, hi, points):
        order = np.argsort(np.abs(xs - g))
        reach = np.searchsorted(np.cumsum(n[order]), smooth * n.sum()) + 1
        span = max(np.abs(xs[order[: reach + 1]] - g).max(), 1e-12) * 1.0001
        w = n * np.clip(1 - (np.abs(xs - g) / span) ** 3, 0, None) ** 3
        mx, my = (w * xs).sum() / w.sum(), (w * ys).sum() / w.sum()
        sxx = (w * (xs - mx) ** 2).sum()
        slope = (w * (xs - mx) * (ys - my)).sum() / sxx if sxx > 1e-12 else 0.0
        out.append((float(g), float(my + slope * (g - mx))))
    return out


def text_plot(df: DataFrame, x: str, y: str, rows: int = 20, cols: int = 60) -> str:
    """PLOT: a character grid; A for one row in a cell, B for two, up to Z."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xl, xh, yl, yh = own.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if xl is None:
        return ""
    at = lambda c, lo, hi, n: F.least(F.lit(n - 1), F.floor((F.col(c).cast("double") - float(lo)) / ((float(hi) - float(lo)) or 1.0) * n).cast("int"))
    grid = [[" "] * cols for _ in range(rows)]
    for r in own.groupBy(at(x, xl, xh, cols).alias("i"), at(y, yl, yh, rows).alias("j")).count().collect():
        grid[rows - 1 - r["j"]][r["i"]] = chr(64 + min(26, r["count"]))
    return "\n".join("|" + "".join(row) for row in grid) + "\n+" + "-" * cols


def qq(df: DataFrame, v: str, points: int = 99) -> list[tuple[float, float]]:
    """QQPLOT / PROBPLOT / PPPLOT / CDFPLOT series: (normal quantile, sample quantile) at even probabilities."""
    from ..stats import dists

    counted = df.where(F.col(v).isNotNull()).groupBy(F.col(v).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    probs: Sequence[float] = [(k + 0.5) / points for k in range(points)]
    row = definition5(counted, [], {str(k): p for k, p in enumerate(probs)}).first()
    return [(dists.norm_quantile(p), row[f"q_{k}"]) for k, p in enumerate(probs)]
