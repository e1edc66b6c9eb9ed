"""Data-step row processing as window and join expressions.

Order matters in a data step, so every operator takes the BY keys and an explicit order. What the language does row by
row becomes: FIRST./LAST. flags, retained values and sum statements as windows per BY group, LAG and DIF as offsets,
SET/MERGE/UPDATE as unions and joins, loops with OUTPUT as exploded sequences. Programs whose rows depend on each other
in other ways go through `recurrence`, one Arrow group at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import key_join
from .running import carried, changes, cumulate, lagged, totals


def order_of(keys: Sequence[str]) -> list[Column]:
    """Sort columns; a leading minus is DESCENDING. Missing comes first, or last when descending."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys]


def by_window(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*[k.lstrip("-") for k in by]).orderBy(*order_of(order))


def first_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """first_<v> and last_<v> for every BY variable, 0 or 1: a change in the prefix of keys up to v."""
    keys = [k.lstrip("-") for k in by]
    return changes(df, by, order, [(f"first_{k}", f"last_{k}") for k in keys]) if keys else df


def running_sum(df: DataFrame, name: str, expr: Column, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum statement: a retained total from 0 to which missing adds nothing, per BY group if given."""
    add = F.coalesce(expr.cast("double"), F.lit(0.0))
    if not by:
        return cumulate(df, add, order, name)
    return df.withColumn(name, F.sum(add).over(by_window(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def retain(df: DataFrame, name: str, expr: Column, order: Sequence[str], by: Sequence[str] = (), initial=None) -> DataFrame:
    """RETAIN: the last value that was assigned (null: none) on this or an earlier row."""
    if not by:
        return carried(df, expr, order, name).withColumn(name, F.coalesce(name, F.lit(initial)))
    w = by_window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(expr, ignorenulls=True).over(w), F.lit(initial)))


def lag(df: DataFrame, name: str, expr: Column, order: Sequence[str], n: int = 1, by: Sequence[str] = (), when: Column | None = None) -> DataFrame:
    """LAGn at one call site: executed on every row, or only where `when` holds (the queue sees those rows alone)."""
    keys = [k.lstrip("-") for k in by]
    if when is None:
        return lagged(df, expr, order, name, n) if not by else df.withColumn(name, F.lag(expr, n).over(by_window(by, order)))
    ran = F.coalesce(when, F.lit(False))
    w = Window.partitionBy(*keys, ran).orderBy(*order_of(order))
    return df.withColumn(name, F.when(ran, F.lag(expr, n).over(w)))


def dif(df: DataFrame, name: str, expr: Column, order: Sequence[str], n: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return lag(df, name, expr, order, n, by).withColumn(name, expr - F.col(name))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "_n_", by: Sequence[str] = ()) -> DataFrame:
    """_N_. Without BY the numbers are a running total over value ranges, so no task sees all rows."""
    if by:
        return df.withColumn(name, F.row_number().over(by_window(by, order)))
    return cumulate(df, F.lit(1).cast("long"), order, name)


def flags(df: DataFrame, order: Sequence[str], end: str | None = None, nobs: str | None = None) -> DataFrame:
    """SET END= and NOBS=: last-row flag and total count."""
    out = totals(df, {"__n": F.lit(1).cast("long")}, order, whole={"__n": "__all"})
    if end:
        out = out.withColumn(end, (F.col("__n") == F.col("__all")).cast("int"))
    if nobs:
        out = out.withColumn(nobs, F.col("__all"))
    return out.drop("__n", "__all")


def point(df: DataFrame, order: Sequence[str], rows: Sequence[int]) -> DataFrame:
    """SET POINT=: the rows with the given numbers, in that order."""
    want = df.sparkSession.createDataFrame([(int(r), k) for k, r in enumerate(rows)], "__n int, __k int")
    return row_numbers(df, order, "__n").join(F.broadcast(want), "__n").orderBy("__k").drop("__n", "__k")


def obs_window(df: DataFrame, order: Sequence[str], firstobs: int = 1, obs: int | None = None) -> DataFrame:
    """FIRSTOBS= and OBS=: a physical window of rows before any WHERE."""
    out = df.orderBy(*order_of(order)).offset(firstobs - 1)
    return out.limit(obs - firstobs + 1) if obs is not None else out


def set_concat(*dfs: DataFrame) -> DataFrame:
    """SET a b: one after the other; variables a data set lacks are missing on its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def interleave(dfs: Sequence[DataFrame], by: Sequence[str], orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """SET a b; BY keys: the ordered union, ties in SET order, with the column __set of the source."""
    parts = [d.withColumn("__set", F.lit(k)) for k, d in enumerate(dfs)]
    return set_concat(*parts).orderBy(*order_of(by), "__set")


def match_merge(dfs: Sequence[DataFrame], by: Sequence[str], orders: Sequence[Sequence[str]], flags_in: Sequence[str | None] | None = None) -> DataFrame:
    """MERGE a b ...; BY keys.

    Rows of a key pair up by position; a data set that runs out keeps its last row; a shared variable takes the value
    of the last data set that still loads a row there. IN= flags name 0/1 columns."""
    keys = [k.lstrip("-") for k in by]
    names = list(dict.fromkeys(c for d in dfs for c in d.columns if c not in keys))
    flags_in = list(flags_in or [None] * len(dfs))
    # places: for each key as many rows as its largest data set
    counted = [d.groupBy(*keys).agg(F.count("*").alias(f"__n{k}")) for k, d in enumerate(dfs)]
    grid = reduce(lambda a, b: key_join(a, b, keys, "full"), counted)
    ns = [f"__n{k}" for k in range(len(dfs))]
    most = F.greatest(*ns) if len(ns) > 1 else F.col(ns[0])
    grid = grid.withColumn("__rn", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    for k, (d, order) in enumerate(zip(dfs, orders, strict=True)):
        w = Window.partitionBy(*keys).orderBy(*order_of(order))
        own = d.withColumn(f"__at{k}", F.row_number().over(w).cast("long"))
        own = own.select(*keys, f"__at{k}", *[F.col(c).alias(f"__{k}_{c}") for c in d.columns if c not in keys])
        left = grid.withColumn(f"__at{k}", F.least("__rn", f"__n{k}"))
        left = left.withColumn(f"__at{k}", F.when(F.col(f"__n{k}").isNotNull(), F.col(f"__at{k}")))
        grid = key_join(left, own, [*keys, f"__at{k}"], "left")
    out = []
    for c in names:
        value = None
        owners = [k for k, d in enumerate(dfs) if c in d.columns]
        # rows past the end of a data set don't load it again: the longer ones decide there
        for k in owners:
            fresh = F.col("__rn") <= F.col(f"__n{k}")
            own = F.col(f"__{k}_{c}")
            value = own if value is None else F.when(F.coalesce(fresh, F.lit(False)), own).otherwise(value)
        if len(owners) > 1:
            kept = F.coalesce(*[F.when(F.col(f"__n{k}").isNotNull(), F.struct(F.col(f"__{k}_{c}").alias("v"))) for k in owners])
            fresh_any = reduce(lambda a, b: a | b, [F.coalesce(F.col("__rn") <= F.col(f"__n{k}"), F.lit(False)) for k in owners])
            value = F.when(fresh_any, value).otherwise(kept["v"])
        out.append(value.alias(c))
    ins = [F.col(f"__n{k}").isNotNull().cast("int").alias(f) for k, f in enumerate(flags_in) if f]
    return grid.select(*keys, *out, *ins)


def one_to_one(dfs: Sequence[DataFrame], orders: Sequence[Sequence[str]]) -> DataFrame:
    """Several SET statements: cursors in lock step, up to the shortest data set; later values win."""
    numbered = [row_numbers(d, o, "__n") for d, o in zip(dfs, orders, strict=True)]
    out = numbered[0]
    for d in numbered[1:]:
        out = out.drop(*[c for c in d.columns if c in out.columns and c != "__n"]).join(d, "__n")
    return out.orderBy("__n").drop("__n")


def update(master: DataFrame, transactions: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """UPDATE master with the first transaction of each key: values that aren't missing replace; others are ignored."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order_of(order))
        transactions = transactions.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    shared = [c for c in transactions.columns if c in master.columns and c not in keys]
    new = [c for c in transactions.columns if c not in master.columns]
    tx = transactions.select(*keys, *[F.col(c).alias("__t_" + c) for c in shared], *new)
    out = key_join(master, tx, keys, "left")
    return out.select(*[F.coalesce("__t_" + c, c).alias(c) if c in shared else F.col(c) for c in master.columns], *new)


def modify(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """MODIFY: rewritten columns; the caller overwrites the table."""
    from .relational import update_set

    return update_set(df, values, where)


def dataset_options(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None, where: Column | str | None = None) -> DataFrame:
    """KEEP= DROP= RENAME= WHERE=: the filter sees the stored names; DROP wins over KEEP."""
    out = df.where(where) if where is not None else df
    names = [c for c in (keep if keep is not None else out.columns) if c not in drop]
    return out.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in names])


def split_outputs(df: DataFrame, targets: dict[str, Column]) -> dict[str, DataFrame]:
    """DATA a b with OUTPUT targets: one lazy plan for each condition."""
    return {name: df.where(F.coalesce(cond, F.lit(False))) for name, cond in targets.items()}


def multi_output(df: DataFrame, branches: Sequence[dict[str, Column]]) -> DataFrame:
    """Several OUTPUTs in one iteration: each branch gives a row with its assignments, in order, in one pass."""
    names = list(dict.fromkeys([*df.columns, *(c for b in branches for c in b)]))
    rows = [F.struct(*[(b[c] if c in b else F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in names]) for b in branches]
    return df.select(F.posexplode(F.array(*rows)).alias("__k", "__row")).select(*[F.col("__row").getField(c).alias(c) for c in names])


def do_loop(df: DataFrame, index: str, start, stop, step=1, assign: dict[str, Column] | None = None) -> DataFrame:
    """DO index = start TO stop BY step; ... OUTPUT; END: one row for each index value, none if the range is empty."""
    lo, hi, by = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop, step))
    some = F.when(by > 0, lo <= hi).otherwise(lo >= hi)
    steps = F.when(some, F.sequence(lo, F.when(some, hi).otherwise(lo), by)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn(index, F.explode(steps))
    return out.withColumns(assign) if assign else out


def do_list(df: DataFrame, index: str, values: Sequence) -> DataFrame:
    return df.withColumn(index, F.explode(F.array(*[F.lit(v) for v in values])))


def over_array(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """DO OVER an array of variables: the same assignment to each."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def array_element(columns: Sequence[str], k: Column) -> Column:
    """a{k} for a computed index; missing outside the bounds."""
    return F.try_element_at(F.array(*[F.col(c) for c in columns]), k.cast("int"))


def select_when(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """SELECT / WHEN / OTHERWISE: the first match; without OTHERWISE no match is an error."""
    out = None
    for cond, value in branches:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if otherwise is not None else F.raise_error(F.lit("no WHEN matches and there is no OTHERWISE")))


def recurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable[[dict, dict], object], schema: str) -> DataFrame:
    """General row loops (GOTO, conditional RETAIN, mutable hash objects), one BY group in order.

    step(row, state) gets a row and the group's retained state, both dicts, and returns a row, a list of rows or None.
    A BY group is one task's Arrow group: keys must bound it."""
    keys = [k.lstrip("-") for k in by]
    names = [k.lstrip("-") for k in order]
    asc = [not k.startswith("-") for k in order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        out = []
        for row in pdf.sort_values(names, ascending=asc, na_position="first", kind="stable").to_dict("records"):
            got = step(row, state)
            out += got if isinstance(got, list) else [] if got is None else [got]
        return pd.DataFrame(out)

    return df.groupBy(*keys).applyInPandas(run, schema)


def hash_summary(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """A hash object that accumulates by key and is written with output(): one row for each key, in key order."""
    return df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]).orderBy(*order_of(keys))
