"""Running totals, lags and carried values without a single task: rows are dealt over ranges of the order, worked on in
each, and joined with what the ranges before hand over (a few rows for each range).

Ranges are cut points of the leading order columns that share a direction: approximate quantiles of the first where its
values are many, else of a bounded sample of all of them, so that a constant first column doesn't end in one task. Their
number follows the session's shuffle partitions. Every part of a plan deals alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTS = 63
SAMPLE = 20_000
_PLAIN = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def number_of_cuts(df: DataFrame) -> int:
    return min(1023, max(CUTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1))


def cut_points(df: DataFrame, columns: Sequence[str], cuts: int) -> list[tuple]:
    """Approximate quantiles as tuples of values of the columns, or of the first alone."""
    first = columns[0]
    if isinstance(df.schema[first].dataType, _PLAIN):
        found = df.agg(F.percentile_approx(first, [k / (cuts + 1) for k in range(1, cuts + 1)], 2000)).first()[0]
        points = sorted(set(found or []))
        if len(points) > cuts // 2 or len(columns) == 1:
            return [(p,) for p in points]
    known = df.where(F.col(first).isNotNull()).select(*columns)
    n = known.count()
    if not n:
        return []
    rows = [tuple(r) for r in known.sample(min(1.0, SAMPLE / n), 7).limit(2 * SAMPLE).collect()]
    rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
    return sorted({rows[len(rows) * k // (cuts + 1)] for k in range(1, cuts + 1)}, key=lambda r: tuple((v is not None, v) for v in r)) if rows else []


def bucket(df: DataFrame, columns: Sequence[str], points: Sequence[tuple]) -> Column:
    """How many cut points a row has reached; nulls come first."""
    if not points:
        return F.lit(0)
    used = columns[: len(points[0])]
    kinds = [df.schema[c].dataType for c in used]
    if len(used) == 1:
        marks = [F.lit(p[0]).cast(kinds[0]) for p in points]
        reached = lambda c: F.coalesce(c <= F.col(used[0]), F.lit(False))
    else:
        row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(used)])
        marks = [F.struct(*[F.lit(v).cast(t).alias(f"c{k}") for k, (v, t) in enumerate(zip(p, kinds, strict=True))]) for p in points]
        reached = lambda c: c <= row
    # the points ascend: first the last one of each group of them, then those of one group
    group = math.isqrt(len(marks) - 1) + 1
    count = lambda array: F.size(F.filter(array, reached))
    groups = count(F.array(*marks[group - 1 :: group])) if len(marks) >= group else F.lit(0)
    return groups * group + count(F.slice(F.array(*marks), groups * group + 1, F.lit(group)))


def dealt(df: DataFrame, order: Sequence[str], name: str = "__cum_b", source: DataFrame | None = None) -> DataFrame:
    """df with the number of each row's range, ascending in order. source: rows with the same columns that are cheaper to
    read than df, such as those df counts; used where their quantiles are not tied."""
    down = order[0].startswith("-")
    lead = []
    for k in order:
        if k.startswith("-") != down:
            break
        lead.append(k.lstrip("-"))
    cuts = number_of_cuts(df)
    points = cut_points(source, lead[:1], cuts) if source is not None else []
    if len(points) <= cuts // 2:
        points = cut_points(df, lead, cuts)
    b = bucket(df, lead, points)
    return df.withColumn(name, -b if down else b)


def ordering(order: Sequence[str]) -> list[Column]:
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in order]


def hand_over(rows: DataFrame, few: DataFrame) -> DataFrame:
    """rows with what the ranges before hand over (one row of few for each range). The key is shifted on both sides: with
    two plain columns the optimizer infers the filter of one side for the other, and leaves the order columns in it."""
    return rows.join(F.broadcast(few.withColumn("__cum_of", F.col("__cum_b") + 1).drop("__cum_b")), F.col("__cum_b") + 1 == F.col("__cum_of")).drop("__cum_of")


def totals(df: DataFrame, values: dict[str, Column], order: Sequence[str], whole: dict[str, str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """df with, for each name, the total of its value over all rows up to this one, in order (a leading minus is
    descending), in one pass; whole: {name of a total: name for its sum over all rows}."""
    parts = dealt(df, order, source=source).withColumns({f"__v_{n}": v for n, v in values.items()})
    inner = Window.partitionBy("__cum_b").orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("__cum_b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])  # at most one row a range
    before = Window.orderBy("__cum_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__cum_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("__cum_b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values], *[F.sum(f"__t_{n}").over(every).alias(w) for n, w in (whole or {}).items()])
    out = hand_over(parts.withColumns({n: F.sum(f"__v_{n}").over(inner) for n in values}), sums)
    return out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in values}).drop("__cum_b", *[f"__{k}_{n}" for n in values for k in "vo"])


def cumulate(df: DataFrame, value: Column, order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: the total of value over all rows up to this one, in order."""
    return totals(df, {name: value}, order)


def lagged(df: DataFrame, value: Column, order: Sequence[str], name: str, n: int = 1) -> DataFrame:
    """df with `name`: the value n rows before in order, null for the first n rows. Each range hands its last n rows over."""
    parts = dealt(df, order).withColumn("__lag_v", value)
    own = Window.partitionBy("__cum_b")
    rows = parts.withColumns({"__lag_k": F.row_number().over(own.orderBy(*ordering(order))), "__lag_x": F.lag("__lag_v", n).over(own.orderBy(*ordering(order)))})
    back = rows.withColumn("__lag_s", F.count("*").over(own)).where(F.col("__lag_k") > F.col("__lag_s") - n)
    tails = back.groupBy("__cum_b").agg(F.sort_array(F.collect_list(F.struct(F.col("__lag_k").alias("k"), F.col("__lag_v").alias("v")))).alias("t"))
    # the last n values of all ranges before, nearest last: short ranges pass on what they were given
    before = Window.orderBy("__cum_b").rowsBetween(Window.unboundedPreceding, -1)
    handed = tails.select("__cum_b", F.flatten(F.collect_list("t").over(before)).alias("__lag_t"))
    handed = handed.withColumn("__lag_t", F.slice("__lag_t", F.greatest(F.lit(1), F.size("__lag_t") - n + 1), F.lit(n)))
    out = hand_over(rows, handed)
    place = F.size("__lag_t") - n + F.col("__lag_k")
    given = F.when(place >= 1, F.get("__lag_t", (place - 1).cast("int"))["v"])
    return out.withColumn(name, F.when(F.col("__lag_k") > n, F.col("__lag_x")).otherwise(given)).drop("__cum_b", "__lag_v", "__lag_k", "__lag_x", "__lag_t")


def carried(df: DataFrame, value: Column, order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: the last value that isn't null on this or an earlier row in order."""
    parts = dealt(df, order).withColumn("__car_v", value)
    inner = Window.partitionBy("__cum_b").orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("__car_x", F.last("__car_v", ignorenulls=True).over(inner))
    numbered = rows.withColumn("__car_k", F.row_number().over(Window.partitionBy("__cum_b").orderBy(*ordering(order))))
    ends = numbered.groupBy("__cum_b").agg(F.max_by("__car_x", "__car_k").alias("__car_e"))
    before = Window.orderBy("__cum_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__cum_b", F.last("__car_e", ignorenulls=True).over(before).alias("__car_o"))
    out = hand_over(rows, ends)
    return out.withColumn(name, F.coalesce("__car_x", "__car_o")).drop("__cum_b", "__car_v", "__car_x", "__car_o")


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[tuple[str, str]]) -> DataFrame:
    """df with, for each key of by, two 0/1 columns of the given names: whether the row is the first, and the last, of its
    run of the keys up to there. One sort for all of them; each range hands over the keys at its two ends."""
    keys = [k.lstrip("-") for k in by]
    whole = [*by, *order]
    parts = dealt(df, whole).withColumn("__chg_k", F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]))
    inner = Window.partitionBy("__cum_b").orderBy(*ordering(whole))
    rows = parts.withColumns({"__chg_p": F.lag("__chg_k").over(inner), "__chg_n": F.lead("__chg_k").over(inner)})
    # only the first row of a range has none before it, and only its last none after it
    ends = rows.where(F.col("__chg_p").isNull() | F.col("__chg_n").isNull()).groupBy("__cum_b").agg(F.max(F.when(F.col("__chg_p").isNull(), F.col("__chg_k"))).alias("a"), F.max(F.when(F.col("__chg_n").isNull(), F.col("__chg_k"))).alias("z"))
    near = Window.orderBy("__cum_b")
    ends = ends.select("__cum_b", F.lag("z").over(near).alias("__chg_a"), F.lead("a").over(near).alias("__chg_z"))
    out = hand_over(rows, ends).withColumns({"__chg_p": F.coalesce("__chg_p", "__chg_a"), "__chg_n": F.coalesce("__chg_n", "__chg_z")})

    def differs(other: str, upto: int):
        same = F.col(other).isNotNull()
        for n in range(upto + 1):
            same = same & F.col("__chg_k")[f"k{n}"].eqNullSafe(F.col(other)[f"k{n}"])
        return (~same).cast("int")

    flags = {name: differs(side, n) for n, pair in enumerate(names) for name, side in zip(pair, ("__chg_p", "__chg_n"), strict=True)}
    return out.withColumns(flags).drop("__cum_b", "__chg_k", "__chg_p", "__chg_n", "__chg_a", "__chg_z")
