"""Class summaries: MEANS/SUMMARY, FREQ, TABULATE, REPORT and UNIVARIATE as aggregates, cubes and windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stats import dists
from .running import dealt, totals

QUANTILES = {"P1": 0.01, "P5": 0.05, "P10": 0.1, "P25": 0.25, "Q1": 0.25, "MEDIAN": 0.5, "P50": 0.5, "P75": 0.75, "Q3": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99, "QRANGE": None}
SIMPLE = ("N", "NMISS", "MIN", "MAX", "RANGE", "SUM", "MEAN", "STD", "VAR", "STDERR", "CV", "USS", "CSS", "SKEWNESS", "KURTOSIS", "SUMWGT")


def statistic(stat: str, v: str, weight: str | None = None) -> Column:
    """One statistic of a variable as an aggregate; NMISS counts missing values, the others ignore them."""
    x = F.col(v).cast("double")
    if weight is not None:
        w = F.when((F.col(weight) > 0) & x.isNotNull(), F.col(weight).cast("double"))
        x = F.when(w.isNotNull(), x)
        sw, swx, n = F.sum(w), F.sum(w * x), F.count(x)
        mean = swx / sw
        css = F.sum(w * x * x) - swx * swx / sw
        weighted = {"SUM": swx, "MEAN": mean, "CSS": css, "USS": F.sum(w * x * x), "SUMWGT": sw, "VAR": css / F.when(n > 1, n - 1)}
        weighted["STD"] = F.sqrt(weighted["VAR"])
        weighted["STDERR"] = weighted["STD"] / F.sqrt(sw)
        weighted["CV"] = 100 * weighted["STD"] / mean
        if stat in weighted:
            return weighted[stat]
    n = F.count(x)
    std = F.when(n > 1, F.stddev_samp(x))
    d = n.cast("double")
    plain = {
        "N": n,
        "NMISS": F.count(F.when(F.col(v).isNull(), 1)),
        "MIN": F.min(F.col(v)),
        "MAX": F.max(F.col(v)),
        "RANGE": F.max(F.col(v)) - F.min(F.col(v)),
        "SUM": F.sum(x),
        "MEAN": F.avg(x),
        "STD": std,
        "VAR": F.when(n > 1, F.var_samp(x)),
        "STDERR": std / F.sqrt(n),
        "CV": 100 * std / F.when(F.avg(x) != 0, F.avg(x)),
        "USS": F.sum(x * x),
        "CSS": F.when(n > 0, F.var_pop(x) * n),
        "SUMWGT": n,
        # bias-corrected, from the population moments
        "SKEWNESS": F.when(n > 2, F.sqrt(d * (d - 1)) / (d - 2) * F.skewness(x)),
        "KURTOSIS": F.when(n > 3, (d - 1) / ((d - 2) * (d - 3)) * ((d + 1) * F.kurtosis(x) + 6)),
    }
    return plain[stat]


def class_sets(classes: Sequence[str], ways: Sequence[int] | None = None, types: Sequence[Sequence[str]] | None = None) -> list[tuple[str, ...]]:
    """The CLASS subsets to report: all 2^k, those of the given sizes, or the named crossings."""
    if types is not None:
        return [tuple(c for c in classes if c in t) for t in types]
    sizes = range(len(classes) + 1) if ways is None else ways
    return [c for k in sizes for c in combinations(classes, k)]


def means(df: DataFrame, var: Sequence[str], stats: Sequence[str] = ("N", "MEAN", "STD", "MIN", "MAX"), classes: Sequence[str] = (), by: Sequence[str] = (), weight: str | None = None, ways: Sequence[int] | None = None, types: Sequence[Sequence[str]] | None = None, nway: bool = False, alpha: float = 0.05, names: dict[tuple[str, str], str] | None = None, missing: bool = True) -> DataFrame:
    """MEANS/SUMMARY OUTPUT: _TYPE_, _FREQ_ and statistics for every CLASS subset, as one GROUPING SETS aggregate.

    _TYPE_ has a bit for each CLASS variable, the last one lowest. Quantiles are Definition 5. CLM limits use the t
    quantile of each group's n. Missing class values are a level unless missing is false."""
    stats = [s.upper() for s in stats]
    source = df if missing or not classes else df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in classes]))
    sets = [tuple(classes)] if nway else class_sets(classes, ways, types)
    label = lambda v, s: (names or {}).get((v, s), f"{v}_{s}")
    aggs, late = [F.count("*").alias("_FREQ_")], []
    for v in var:
        for s in stats:
            if s in QUANTILES:
                late.append((v, s))
            elif s in ("LCLM", "UCLM"):
                late.append((v, s))
            else:
                aggs.append(statistic(s, v, weight).alias(label(v, s)))
        if {"LCLM", "UCLM"} & set(stats):
            aggs += [statistic(s, v, weight).alias(f"__{v}_{s}") for s in ("N", "MEAN", "STDERR")]
    keys = [*by, *classes]
    if classes:
        out = source.groupingSets([[*(F.col(c) for c in by), *(F.col(c) for c in s)] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__gid"), *aggs)
        out = out.withColumn("_TYPE_", F.lit((1 << len(classes)) - 1) - F.col("__gid").bitwiseAND(F.lit((1 << len(classes)) - 1)))
    else:
        out = (source.groupBy(*by) if by else source).agg(*aggs).withColumn("__gid", F.lit(0)).withColumn("_TYPE_", F.lit(0))
    if {"LCLM", "UCLM"} & set(stats):
        from ..functions.distribution import batch

        for v in var:
            n = F.col(f"__{v}_N")
            t = batch(dists.t_quantile, F.lit(1 - alpha / 2), F.when(n > 1, n - 1))
            half = t * F.col(f"__{v}_STDERR")
            for s, sign in (("LCLM", -1), ("UCLM", 1)):
                if s in stats:
                    out = out.withColumn(label(v, s), F.col(f"__{v}_MEAN") + sign * half)
            out = out.drop(f"__{v}_N", f"__{v}_MEAN", f"__{v}_STDERR")
    quant = [(v, s) for v, s in late if s in QUANTILES]
    for v in dict.fromkeys(v for v, _ in quant):
        own = [s for w, s in quant if w == v]
        q = grouped_quantiles(source, v, {s: QUANTILES[s] for s in own if s != "QRANGE"} | ({"__q1": 0.25, "__q3": 0.75} if "QRANGE" in own else {}), by, classes, sets)
        q = q.withColumns({f"__k{n}": F.col(k) for n, k in enumerate(keys)}).withColumnRenamed("__set", "__qset").drop(*keys)
        set_of = F.lit(None).cast("int")
        for n, s in enumerate(sets):
            mask = sum(1 << (len(classes) - 1 - i) for i, c in enumerate(classes) if c in s)
            set_of = F.when(F.col("_TYPE_") == mask, n).otherwise(set_of)
        cond = set_of.eqNullSafe(F.col("__qset"))
        for n, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k{n}"))
        out = out.join(q, cond, "left")
        for s in own:
            out = out.withColumn(label(v, s), F.col("__q3") - F.col("__q1") if s == "QRANGE" else F.col(f"q_{s}"))
        out = out.drop("__qset", *[f"__k{n}" for n in range(len(keys))], "__q1", "__q3", *[f"q_{s}" for s in own])
    return out.drop("__gid").select(*by, *classes, "_TYPE_", "_FREQ_", *[label(v, s) for v in var for s in stats])


def grouped_quantiles(df: DataFrame, v: str, points: dict[str, float], by: Sequence[str], classes: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Definition-5 quantiles of v for every class set: (keys..., __set, q_<name>).

    Values are counted once for the finest keys (combined before the shuffle); the counts of all other sets are added up
    from those in one pass. Ranks are running counts over distinct values, for the set without keys over value ranges."""
    x = F.col(v).cast("double").alias("__x")
    finest = df.where(F.col(v).isNotNull()).groupBy(*by, *classes, x).agg(F.count("*").alias("__c"))
    parts = []
    keyed = [n for n, s in enumerate(sets) if by or s]
    if keyed:
        none = {c: F.lit(None).cast(df.schema[c].dataType) for c in classes}
        of_set = [F.struct(F.lit(n).alias("__set"), *[(F.col(c) if c in sets[n] else none[c]).alias(c) for c in classes]) for n in keyed]
        rows = finest.select(*by, "__x", "__c", F.explode(F.array(*of_set)).alias("__s")).select(*by, "__x", "__c", "__s.*")
        keys = ["__set", *by, *classes]
        counted = rows.groupBy(*keys, "__x").agg(F.sum("__c").alias("__c"))
        parts.append(definition5(counted, keys, points, source=df.select(x)).select(*by, *classes, "__set", *_quantile_names(points)))
    for n in range(len(sets)):
        if n not in keyed:
            counted = finest.groupBy("__x").agg(F.sum("__c").alias("__c"))
            missing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in classes]
            parts.append(definition5(counted, [], points, source=df.select(x)).select(*missing, F.lit(n).alias("__set"), *_quantile_names(points)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _quantile_names(points: dict[str, float]) -> list[str]:
    return [p if p.startswith("__") else f"q_{p}" for p in points]


def definition5(counted: DataFrame, keys: Sequence[str], points: dict[str, float], weight: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Quantiles of (keys, __x, __c): with np whole the mean of values np and np + 1, else the value floor(np) + 1. The
    values of a key are dealt over value ranges as well, so no task holds a whole key."""
    if keys:
        parts = dealt(counted, ["__x"], source=source)
        run = Window.partitionBy("__cum_b", *keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
        part = Window.partitionBy(*keys)
        before = part.orderBy("__cum_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = parts.groupBy("__cum_b", *keys).agg(F.sum("__c").alias("__t"))  # a row for each key and range
        sums = sums.select((F.col("__cum_b") + 1).alias("__of"), *[F.col(k).alias(f"__of_{k}") for k in keys], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"), F.sum("__t").over(part).alias("__n"))
        cond = F.col("__cum_b") + 1 == F.col("__of")  # shifted as in running.hand_over
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
        ranked = parts.withColumn("__hi", F.sum("__c").over(run)).join(sums, cond).withColumn("__hi", F.col("__hi") + F.col("__o"))
    else:
        ranked = totals(counted, {"__hi": F.col("__c")}, ["__x"], whole={"__hi": "__n"}, source=source)
    lo = F.col("__hi") - F.col("__c")
    aggs = []
    for (_, p), name in zip(points.items(), _quantile_names(points), strict=True):
        place = F.round(F.col("__n") * p, 9)
        k = F.floor(place)
        at = lambda r, lo=lo: (lo < r) & (r <= F.col("__hi"))
        upper = F.max(F.when(at(F.least(k + 1, F.col("__n"))), F.col("__x")))
        lower = F.max(F.when(at(F.greatest(k, F.lit(1))), F.col("__x")))
        whole = F.max(place == k)
        aggs.append(F.when(whole, (lower + upper) / 2).otherwise(upper).alias(name))
    return (ranked.groupBy(*keys) if keys else ranked).agg(*aggs)


# FREQ ----------------------------------------------------------------------------------------------------------------
def cells(df: DataFrame, table: Sequence[str], by: Sequence[str] = (), weight: str | None = None, missing: bool = False) -> DataFrame:
    """Counts of a crossing (sum of positive weights); rows with a missing level drop out unless missing is true."""
    for t in () if missing else table:
        df = df.where(F.col(t).isNotNull())
    if weight is not None:
        df = df.where(F.col(weight) > 0)
    n = F.sum(F.col(weight).cast("double")) if weight else F.count("*")
    return df.groupBy(*by, *table).agg(n.alias("COUNT"))


def freq_one_way(df: DataFrame, v: str, by: Sequence[str] = (), weight: str | None = None, missing: bool = False) -> DataFrame:
    """v, COUNT, PERCENT, CUM_FREQ, CUM_PCT, in level order."""
    out = cells(df, [v], by, weight, missing)
    if by:
        part = Window.partitionBy(*by)
        run = part.orderBy(F.col(v).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({"__all": F.sum("COUNT").over(part), "CUM_FREQ": F.sum("COUNT").over(run)})
    else:
        out = totals(out, {"CUM_FREQ": F.col("COUNT")}, [v], whole={"CUM_FREQ": "__all"})
    out = out.withColumns({"PERCENT": 100 * F.col("COUNT") / F.col("__all"), "CUM_PCT": 100 * F.col("CUM_FREQ") / F.col("__all")})
    return out.select(*by, v, "COUNT", "PERCENT", "CUM_FREQ", "CUM_PCT").orderBy(*by, v)


def freq_two_way(df: DataFrame, row: str, column: str, strata: Sequence[str] = (), weight: str | None = None, missing: bool = False) -> DataFrame:
    """COUNT, PERCENT, ROW_PCT, COL_PCT and expected counts; more variables are strata."""
    s = list(strata)
    out = cells(df, [*s, row, column], (), weight, missing)
    r, c = (F.sum("COUNT").over(Window.partitionBy(*s, *k)) for k in ([row], [column]))
    if s:
        total = F.sum("COUNT").over(Window.partitionBy(*s))
    else:
        out, total = out.crossJoin(F.broadcast(out.agg(F.sum("COUNT").alias("__all")))), F.col("__all")
    return out.withColumns({"PERCENT": 100 * F.col("COUNT") / total, "ROW_PCT": 100 * F.col("COUNT") / r, "COL_PCT": 100 * F.col("COUNT") / c, "EXPECTED": r * c / total}).drop("__all").orderBy(*s, row, column)


def freq_margins(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """Cells with row, column and grand totals (null is the total)."""
    return cells(df, [row, column], (), weight).cube(row, column).agg(F.sum("COUNT").alias("COUNT"))


def chisq_one_way(df: DataFrame, v: str, weight: str | None = None) -> DataFrame:
    """Equal proportions: DF, CHISQ."""
    c = cells(df, [v], (), weight)
    k, n, ss = F.count("*"), F.sum("COUNT"), F.sum(F.col("COUNT") * F.col("COUNT"))
    return c.agg((k - 1).alias("DF"), (ss * k / n - n).alias("CHISQ"))


def chisq_two_way(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """DF, Pearson CHISQ and likelihood ratio G2, as aggregates; absent cells add their expected count to Pearson's."""
    t = freq_two_way(df, row, column, (), weight)
    o, e = F.col("COUNT").cast("double"), F.col("EXPECTED")
    seen = F.sum(e)
    return t.agg(
        ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("DF"),
        (F.sum((o - e) * (o - e) / e) + F.sum(o) - seen).alias("CHISQ"),
        (2 * F.sum(o * F.ln(o / e))).alias("G2"),
    )


# TABULATE, REPORT, UNIVARIATE ------------------------------------------------------------------------------------------
def tabulate(df: DataFrame, table: Sequence[Sequence[str]], var: str | None = None, stats: Sequence[str] = ("N",)) -> DataFrame:
    """TABULATE: each crossing of `table` ("ALL" is a margin) with its statistics; PCTN and PCTSUM have grand totals.

    `table` is the product of its dimensions, each a list of stacked class variables or ALL."""
    stats = [s.upper() for s in stats]
    crossings = [[]]
    for dim in table:
        crossings = [[*c, d] for c in crossings for d in dim]
    sets = [tuple(x for x in c if x != "ALL") for c in crossings]
    classes = list(dict.fromkeys(x for s in sets for x in s))
    source = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in classes])) if classes else df
    aggs = [F.count("*").alias("__n")]
    if var:
        aggs.append(F.sum(F.col(var).cast("double")).alias("__s"))
        aggs += [statistic(s, var).alias(s) for s in stats if s not in ("PCTN", "PCTSUM", "N")]
        aggs.append(F.count(F.col(var)).alias("N"))
    else:
        aggs.append(F.count("*").alias("N"))
    unique = list(dict.fromkeys(sets))
    if classes:
        out = source.groupingSets([[F.col(c) for c in s] for s in unique], *[F.col(c) for c in classes]).agg(F.grouping_id().alias("__gid"), *aggs)
        out = out.withColumn("_TYPE_", F.lit((1 << len(classes)) - 1) - F.col("__gid")).drop("__gid")
    else:
        out = source.agg(*aggs).withColumn("_TYPE_", F.lit(0))
    total = source.agg(F.count("*").alias("__tn"), *([F.sum(F.col(var).cast("double")).alias("__ts")] if var else []))
    out = out.crossJoin(F.broadcast(total)).withColumn("PCTN", 100 * F.col("__n") / F.col("__tn"))
    if var:
        out = out.withColumn("PCTSUM", 100 * F.col("__s") / F.col("__ts"))
    return out.select(*classes, "_TYPE_", *stats).orderBy("_TYPE_", *classes)


def report(df: DataFrame, group: Sequence[str] = (), analysis: dict[str, str] | None = None, display: Sequence[str] = (), order: Sequence[str] = (), across: str | None = None, across_values: Sequence | None = None, break_after: Sequence[str] = (), rbreak: bool = False, compute: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """REPORT: detail rows, or one row a group with its statistics; ACROSS pivots; BREAK and RBREAK add subtotal rows,
    recomputed from the data, with _BREAK_ naming the level; COMPUTE assigns columns at the end."""
    df = df.where(where) if where is not None else df
    if not group:
        out = df.select(*[*order, *[d for d in display if d not in order]]).orderBy(*order) if order else df.select(*display)
    else:
        aggs = [statistic(s.upper(), v).alias(v) for v, s in (analysis or {}).items()]
        if across:
            out = df.groupBy(*group).pivot(across, list(across_values) if across_values is not None else None).agg(*aggs).withColumn("_BREAK_", F.lit(None).cast("string"))
        else:
            levels = [list(group)]
            levels += [list(group[: group.index(b) + 1]) for b in break_after]
            levels += [[]] if rbreak else []
            unique = [list(x) for x in dict.fromkeys(map(tuple, levels))]
            rolled = df.groupingSets([[F.col(c) for c in s] for s in unique], *[F.col(c) for c in group]).agg(F.grouping_id().alias("__gid"), *aggs)
            mark = F.lit(None).cast("string")
            for k, g in enumerate(group[:-1]):
                mark = F.when(F.col("__gid") == (1 << (len(group) - 1 - k)) - 1, g).otherwise(mark)
            mark = F.when(F.col("__gid") == (1 << len(group)) - 1, "_RBREAK_").otherwise(mark)
            out = rolled.withColumn("_BREAK_", mark)
            out = out.orderBy(*[x for k, g in enumerate(group) for x in (F.col("__gid").bitwiseAND(F.lit(1 << (len(group) - 1 - k))), F.col(g).asc_nulls_first())]).drop("__gid")
    return out.withColumns(compute) if compute else out


def univariate(df: DataFrame, var: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Moments and basic measures: one row for each BY group and variable."""
    names = ["N", "MEAN", "STD", "VAR", "SKEWNESS", "KURTOSIS", "SUM", "USS", "CSS", "CV", "STDERR", "MIN", "MAX", "RANGE"]
    rows = []
    for v in var:
        base = (df.groupBy(*by) if by else df).agg(*[statistic(s, v, weight).cast("double").alias(s) for s in names])
        rows.append(base.withColumn("VAR_NAME", F.lit(v)).select(*by, "VAR_NAME", *names))
    return reduce(lambda a, b: a.unionByName(b), rows)


def mode(df: DataFrame, v: str, by: Sequence[str] = ()) -> DataFrame:
    """The smallest most frequent value that occurs twice at least, else missing."""
    counted = df.where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("__c"))
    best = F.min(F.when(F.col("__c") >= 2, F.struct((-F.col("__c")).alias("c"), F.col(v).alias("v"))))
    return (counted.groupBy(*by) if by else counted).agg(best["v"].alias("MODE"))


def extremes(df: DataFrame, v: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """The n lowest and n highest observations (SIDE low or high)."""
    x = df.where(F.col(v).isNotNull()).select(v, *order)
    low = x.orderBy(F.col(v).asc(), *order).limit(n).withColumn("SIDE", F.lit("low"))
    return low.unionByName(x.orderBy(F.col(v).desc(), *order).limit(n).withColumn("SIDE", F.lit("high")))


def weighted_quantiles(df: DataFrame, v: str, weight: str, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Definition 5 on cumulative weights: the first value past p of the weight, the mean with the next on a tie."""
    c = df.where(F.col(v).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(v).cast("double").alias("x")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    part = Window.partitionBy(*by)
    run = part.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"cum": F.sum("w").over(run), "all": F.sum("w").over(part), "next": F.lead("x").over(part.orderBy("x"))})
    aggs = []
    for name, p in points.items():
        at = F.col("all") * p
        tied = F.abs(F.col("cum") - at) <= 1e-12 * F.col("all")
        first = F.min(F.when(F.col("cum") >= at - 1e-12 * F.col("all"), F.struct("x", F.when(tied, (F.col("x") + F.coalesce("next", "x")) / 2).otherwise(F.col("x")).alias("q"))))
        aggs.append(first["q"].alias(name))
    return (c.groupBy(*by) if by else c).agg(*aggs)


def histogram(df: DataFrame, v: str, start: float, width: float, bins: int) -> DataFrame:
    """Counts of equal bins: MIDPOINT, COUNT, PERCENT."""
    x = df.where(F.col(v).isNotNull()).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(v) - start) / width).cast("int"))).alias("b"))
    out = x.groupBy("b").agg(F.count("*").alias("COUNT"))
    return out.select((start + (F.col("b") + 0.5) * width).alias("MIDPOINT"), "COUNT", (100 * F.col("COUNT") / F.sum("COUNT").over(Window.partitionBy())).alias("PERCENT")).orderBy("MIDPOINT")


def compare(base: DataFrame, other: DataFrame, order: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """COMPARE: differing cells (row, variable, base, compare), paired by ID variables or by row number."""
    from .datastep import row_numbers
    from .relational import key_join

    shared = [c for c in base.columns if c in other.columns and c not in id_cols]
    keys = list(id_cols) or ["_OBS_"]
    b, c = (d if id_cols else row_numbers(d, order, "_OBS_") for d in (base, other))
    b = b.select(*keys, F.struct(*shared).alias("__b"))
    c = c.select(*keys, F.struct(*shared).alias("__c"))
    both = key_join(b, c, keys, "full")
    diffs = F.array(*[F.when(~F.col(f"__b.{v}").eqNullSafe(F.col(f"__c.{v}")), F.struct(F.lit(v).alias("VAR"), F.col(f"__b.{v}").cast("string").alias("BASE"), F.col(f"__c.{v}").cast("string").alias("COMPARE"))) for v in shared])
    return both.select(*keys, F.explode(F.array_compact(diffs)).alias("d")).select(*keys, "d.VAR", "d.BASE", "d.COMPARE")


def structure(base: DataFrame, other: DataFrame) -> dict[str, list]:
    """Variables in one table only, and those whose type differs."""
    b, o = dict(base.dtypes), dict(other.dtypes)
    return {"base_only": [c for c in b if c not in o], "compare_only": [c for c in o if c not in b], "types": [(c, b[c], o[c]) for c in b if c in o and b[c] != o[c]]}


def contents(df: DataFrame) -> DataFrame:
    """CONTENTS: one row for each variable."""
    rows = [(k + 1, f.name, "char" if f.dataType.typeName() in ("string", "varchar", "char") else "num", f.dataType.simpleString(), f.metadata.get("length"), f.metadata.get("format"), f.metadata.get("label")) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "VARNUM int, NAME string, TYPE string, SPARK_TYPE string, LENGTH int, FORMAT string, LABEL string")
