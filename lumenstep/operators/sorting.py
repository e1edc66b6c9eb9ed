"""Sorting, duplicate removal, ranking and transposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distribution import probit
from .datastep import order_of
from .running import totals


def sort(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_of(by))


def nodupkey(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the original order, kept as a partial minimum: a hot key is one row a task."""
    keys = [k.lstrip("-") for k in by]
    rest = [c for c in df.columns if c not in keys]
    if any(k.startswith("-") for k in order):
        w = Window.partitionBy(*keys).orderBy(*order_of(order))
        return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k").orderBy(*order_of(by))
    first = F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in rest]))
    out = df.groupBy(*keys).agg(first.alias("__f")).select(*keys, *[F.col(f"__f.__{c}").alias(c) for c in rest])
    return out.select(*df.columns).orderBy(*order_of(by))


def noduprecs(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drops a row that equals the row before it in BY order."""
    w = Window.partitionBy(*[k.lstrip("-") for k in by]).orderBy(*order_of(order))
    every = F.struct(*df.columns)
    return df.withColumn("__same", F.lag(every).over(w).eqNullSafe(every)).where("NOT __same").drop("__same").orderBy(*order_of(by))


def rank(df: DataFrame, var: Sequence[str], by: Sequence[str] = (), ties: str = "MEAN", descending: bool = False, groups: int | None = None, method: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """RANK: TIES= MEAN LOW HIGH DENSE; GROUPS=; or method FRACTION NPLUS1 PERCENT BLOM TUKEY VW SAVAGE.

    Missing values get no rank. Ranks of one variable are an aggregate over its distinct values, so ties are combined
    before anything is ordered; without BY the running counts are dealt over value ranges."""
    out = df
    for v, name in zip(var, names or var, strict=True):
        counted = df.where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("__n"))
        part = Window.partitionBy(*by)
        w = part.orderBy(F.col(v).desc() if descending else F.col(v).asc())
        if by:
            high = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
            total, dense = F.sum("__n").over(part), F.row_number().over(w)
        else:
            way = ["-" + v if descending else v]
            counted = totals(counted, {"__hi": F.col("__n"), "__dense": F.lit(1).cast("long")}, way, whole={"__hi": "__sum"}, source=df.select(v))
            high, total, dense = F.col("__hi"), F.col("__sum"), F.col("__dense")
        low = high - F.col("__n") + 1
        by_ties = {"MEAN": (low + high) / 2, "LOW": low, "HIGH": high, "DENSE": dense}
        r = by_ties[ties.upper()]
        counted = counted.withColumns({"__low": low, "__high": high, "__all": total, "__r": r.cast("double")})
        n, x = F.col("__all"), F.col("__r")
        if groups:
            value = F.least(F.floor(F.lit(groups) * F.col("__low") / (n + 1)), F.lit(groups - 1)).cast("double") if ties.upper() == "LOW" else F.floor(F.lit(groups) * x / (n + 1)).cast("double")
        elif method is None:
            value = x
        else:
            value = {
                "FRACTION": lambda: x / n,
                "NPLUS1": lambda: x / (n + 1),
                "PERCENT": lambda: 100 * x / n,
                "BLOM": lambda: probit((x - 0.375) / (n + 0.25)),
                "TUKEY": lambda: probit((x - 1 / 3) / (n + 1 / 3)),
                "VW": lambda: probit(x / (n + 1)),
                "SAVAGE": lambda: _savage(F.col("__low"), F.col("__high"), n),
            }[method.upper()]()
        table = counted.select(*by, F.col(v).alias("__v"), value.alias("__rank"))
        cond = F.col(v) == F.col("__v")
        for k in by:
            table = table.withColumnRenamed(k, f"__by_{k}")
            cond = cond & F.col(k).eqNullSafe(F.col(f"__by_{k}"))
        joined = out.join(table, cond, "left").drop("__v", *[f"__by_{k}" for k in by])
        out = joined.withColumn(name, F.col("__rank")).drop("__rank")
    return out


def _savage(low: Column, high: Column, n: Column) -> Column:
    """Mean over the ties of sum(1 / (n - j + 1), j = 1..rank) - 1, by harmonic numbers."""

    def harmonic(k: Column) -> Column:
        k = k.cast("double")
        exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(k, F.lit(50)).cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / i)
        series = F.ln(k) + 0.57721566490153286061 + 1 / (2 * k) - 1 / (12 * k * k) + 1 / (120 * k * k * k * k)
        return F.when(k < 1, 0.0).when(k <= 50, exact).otherwise(series)

    # sum over r of (H(n) - H(n - r)); the sum of H over a run is (m + 1) H(m) - m at its ends
    whole = lambda m: (m + 1) * harmonic(m) - m
    ties = high - low + 1
    inside = whole((n - low).cast("double")) - F.when(n - high >= 1, whole((n - high - 1).cast("double"))).otherwise(0.0)
    return harmonic(n) - inside / ties - 1


def transpose(df: DataFrame, var: Sequence[str], by: Sequence[str] = (), id_col: str | None = None, id_values: Sequence | None = None, order: Sequence[str] = (), prefix: str = "COL", name: str = "_NAME_", most_columns: int = 5000) -> DataFrame:
    """TRANSPOSE: a row for each BY group and variable.

    With ID the columns are its values, in order of first appearance unless given; a value that occurs twice in a BY
    group is an error. Without ID the columns are numbered by the rows' order."""
    long = df.select(*by, *([id_col] if id_col else []), *[c for c in order if c not in by and c != id_col], F.posexplode(F.array(*[F.struct(F.lit(v).alias("n"), F.col(v).alias("v")) for v in var])).alias("__k", "__x"))
    long = long.withColumn(name, F.col("__x.n")).withColumn("__v", F.col("__x.v")).drop("__x")
    if id_col is None:
        w = Window.partitionBy(*by, "__k").orderBy(*order_of(order))
        long = long.withColumn("__id", F.row_number().over(w))
        most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most > most_columns:
            raise ValueError(f"{most} columns are too many")
        values, names = list(range(1, most + 1)), [f"{prefix}{k}" for k in range(1, most + 1)]
    else:
        long = long.withColumn("__id", F.col(id_col))
        if id_values is None:
            first = df.groupBy(id_col).agg(F.min(F.struct(*order)).alias("__o") if order else F.min(id_col).alias("__o"))
            id_values = [r[0] for r in first.orderBy("__o").limit(most_columns + 1).collect() if r[0] is not None]
            if len(id_values) > most_columns:
                raise ValueError("too many ID values")
        values, names = list(id_values), [f"{'' if prefix == 'COL' else prefix}{v}" for v in id_values]
    single = F.when(F.count("__v") <= 1, F.max("__v")).otherwise(F.raise_error(F.lit("an ID value occurs twice in a BY group")).cast(df.schema[var[0]].dataType))
    wide = long.groupBy(*by, "__k", name).pivot("__id", values).agg(single)
    return wide.orderBy(*by, "__k").select(*by, name, *[F.col(f"`{v}`").alias(n) for v, n in zip(values, names, strict=True)])
