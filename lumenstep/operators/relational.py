"""Joins, set operations, row combining and DML-like rewrites as DataFrame operators.

Keys match null to null. Every operator stays lazy and takes its ordering explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..values import nulls_like

BROADCAST_BYTES = 32 << 20
HEAVY_ROWS = 2048  # rows of a key on one side from which spread_join deals them over cells
MOST_TASKS = 4000


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", trim: Sequence[str] = ()) -> DataFrame:
    """Join on equal keys, null matching null; the key columns come once, from whichever side has them."""
    tag = "__r_"
    r = right.select(*[F.col(c).alias(tag + c if c in keys else c) for c in right.columns])
    side = lambda c: F.rtrim(F.col(c)) if c.removeprefix(tag) in trim else F.col(c)
    joined = left.join(r, _and([side(k).eqNullSafe(side(tag + k)) for k in keys]), how)
    if how in ("left_semi", "left_anti", "leftsemi", "leftanti", "semi", "anti"):
        return joined
    out = [F.coalesce(k, tag + k).alias(k) if k in keys else F.col(k) for k in left.columns]
    return joined.select(*out, *[c for c in r.columns if not c.startswith(tag)])


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """key_join for keys with many rows on both sides, whose pairs would fall to one task each: the rows of such a key are
    dealt over a grid of cells of at most about HEAVY_ROWS rows a side, every cell a task's share. Every left row meets
    every right row of its key in exactly one cell. The number of tasks follows the number of pairs."""
    many = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "__nl"), (right, "__nr"))]
    heavy = key_join(*many, keys).where(F.greatest("__nl", "__nr") > HEAVY_ROWS)
    heavy = heavy.select(*keys, *[F.ceil(F.col(n) / HEAVY_ROWS).cast("int").alias(c) for n, c in (("__nl", "__cl"), ("__nr", "__cr"))], (F.col("__nl").cast("double") * F.col("__nr")).alias("__pairs"))
    pairs = heavy.agg(F.sum("__pairs")).first()[0]
    if not pairs:
        return key_join(left, right, keys, how)
    tasks = int(min(MOST_TASKS, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // HEAVY_ROWS**2)))

    few = F.broadcast(heavy.select(*keys, "__cl", "__cr"))
    sides = [key_join(d, few, keys, "left") for d in (left, right)]

    def dealt(df: DataFrame, columns: Sequence[str], own: str, across: str) -> DataFrame:
        # by a hash of the row: a task that is run again deals alike
        mine = F.coalesce(F.pmod(F.xxhash64(*columns), F.col(own)).cast("int"), F.lit(0))
        to = df.where(F.col("__cl").isNotNull()).withColumns({"__own": mine, "__other": F.explode(F.sequence(F.lit(0), F.col(across) - 1))})
        cell = ("__own", "__other") if own == "__cl" else ("__other", "__own")
        same = [F.when(F.col(k).isNotNull(), F.col(k)).alias(f"k{n}") for n, k in enumerate(keys)]  # one type on both sides, else the join deals again
        of = F.struct(*same, *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(cell, ("l", "r"), strict=True)])
        return to.select(of.alias(f"__of{own}"), *[c for c in columns if own == "__cl" or c not in keys]).repartition(tasks, f"__of{own}")

    # a heavy key has rows on both sides, so its join is an inner one whatever the kind
    met = dealt(sides[0], left.columns, "__cl", "__cr").join(dealt(sides[1], right.columns, "__cr", "__cl"), F.col("__of__cl") == F.col("__of__cr"))
    rest = key_join(*[s.where(F.col("__cl").isNull()).drop("__cl", "__cr") for s in sides], keys, how)
    return rest.unionByName(met.select(*rest.columns))


def theta_join(left: DataFrame, right: DataFrame, cond: Column, how: str = "inner") -> DataFrame:
    """Any ON condition; outer joins keep their unmatched rows. Equalities inside become hash joins."""
    return left.join(right, cond, how)


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], take: Sequence[str], found: str | None = None, most_bytes: int = BROADCAST_BYTES, order: Sequence[str] = ()) -> DataFrame:
    """Keyed lookup (hash object find): the first row of table per key (in order, else as read), broadcast only under a checked size, else a shuffle
    join. `found` names a 0/1 column (hash object check)."""
    first = F.struct(*order) if order else F.col("__at")
    rows = table.select("*", F.monotonically_increasing_id().alias("__at")).groupBy(*keys).agg(F.min_by(F.struct(*take, F.lit(1).alias("__hit")), first).alias("__row"))
    small = rows.select(*keys, *[F.col("__row").getField(c).alias(c) for c in (*take, "__hit")])
    if size_bytes(table) <= most_bytes:
        small = F.broadcast(small)
    out = key_join(df.drop(*[c for c in take if c in df.columns]), small, keys, "left")
    return out.withColumn(found, F.coalesce("__hit", F.lit(0))).drop("__hit") if found else out.drop("__hit")


def lookup_all(df: DataFrame, table: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Multi-data lookup: every row of table per key (find_next)."""
    return spread_join(df, table.select(*keys, *take), keys, "left")


def range_lookup(df: DataFrame, x: str, ranges: DataFrame, label: str, low: str = "low", high: str = "high", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Label of the range [low, high) that holds x, null where none does; ranges don't overlap. A small table is
    broadcast; a large one is dealt over cells of the order, and rows meet the ranges of their cell."""
    if size_bytes(ranges) <= most_bytes:
        r = F.broadcast(ranges.select(F.col(low).alias("__lo"), F.col(high).alias("__hi"), F.col(label)))
        return df.join(r, (F.col(x) >= F.col("__lo")) & (F.col(x) < F.col("__hi")), "left").drop("__lo", "__hi")
    edges = [row[0] for row in ranges.select(F.explode(F.percentile_approx(low, [k / 64 for k in range(1, 64)]))).distinct().orderBy(F.col("col")).collect()]
    cell = lambda c: F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= c)) if edges else F.lit(0)
    r = ranges.select(F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))).alias("__cell"), F.col(low).alias("__lo"), F.col(high).alias("__hi"), F.col(label))
    r = r.withColumnRenamed("__cell", "__of")
    holds = (F.col("__cell") == F.col("__of")) & (F.col(x) >= F.col("__lo")) & (F.col(x) < F.col("__hi"))
    return df.withColumn("__cell", cell(F.col(x))).join(r, holds, "left").drop("__cell", "__of", "__lo", "__hi")


def remerge(df: DataFrame, aggs: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates beside the rows they summarise, as a window over the keys, or as one broadcast row without keys."""
    if keys:
        w = Window.partitionBy(*keys)
        return df.withColumns({k: a.over(w) for k, a in aggs.items()})
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(k) for k, a in aggs.items()])))


def remerge_by_join(df: DataFrame, aggs: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Remerge through an aggregate and a join: for keys with so many rows that a window would not fit a task."""
    return key_join(df, df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]), keys, "left")


# set operations ------------------------------------------------------------------------------------------------------
def set_operation(left: DataFrame, right: DataFrame, op: str, all_rows: bool = False, corr: bool = False) -> DataFrame:
    """UNION, EXCEPT, INTERSECT, OUTER UNION, with ALL multiplicities; by position, or by name with corr."""
    op = op.upper()
    if op == "OUTER UNION":
        return left.unionByName(right, allowMissingColumns=True)
    if corr:
        names = [c for c in left.columns if c in right.columns]
        left, right = left.select(*names), right.select(*names)
    if op == "UNION":
        return left.union(right) if all_rows else left.union(right).distinct()
    if op == "EXCEPT":
        return left.exceptAll(right) if all_rows else left.subtract(right)
    if op == "INTERSECT":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    raise ValueError(f"unknown set operation {op}")


def append(base: DataFrame, data: DataFrame, force: bool = False) -> DataFrame:
    """Rows of data under base's columns; without force, columns that base lacks or of another type are an error."""
    kinds = dict(base.dtypes)
    wrong = [c for c, t in data.dtypes if c not in kinds or t != kinds[c]]
    if wrong and not force:
        raise ValueError(f"columns {wrong} don't fit the base table")
    cols = [F.col(c).try_cast(t).alias(c) if c in data.columns else nulls_like(base, c).alias(c) for c, t in base.dtypes]
    return base.unionByName(data.select(*cols))


# DML -----------------------------------------------------------------------------------------------------------------
def update_set(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE SET ... WHERE: rows whose predicate is null stay as they are."""
    cond = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """DELETE FROM ... WHERE: rows whose predicate is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def insert_values(df: DataFrame, rows: Sequence[Sequence], columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    new = df.sparkSession.createDataFrame([tuple(r) for r in rows], df.select(*names).schema)
    return df.unionByName(new, allowMissingColumns=True)


def insert_select(df: DataFrame, query: DataFrame) -> DataFrame:
    """By position."""
    return df.union(query.select(*[F.col(q).cast(t).alias(c) for q, (c, t) in zip(query.columns, df.dtypes, strict=True)]))


def describe(df: DataFrame, name: str) -> str:
    cols = ",\n  ".join(f"{c} {t}" for c, t in df.dtypes)
    return f"create table {name} (\n  {cols}\n)"
