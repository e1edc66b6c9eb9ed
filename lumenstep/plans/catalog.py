"""Registry of named queries and the DuckDB statements that must return the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, wide: str = ""):
    """Register a (spark, sf_dir) -> DataFrame function, with its DuckDB statement where SQL can express it. `wide` names
    integer columns to return as 64-bit, as DuckDB does."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.withColumns({c: df[c].cast("bigint") for c in wide.split()}) if wide else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query(
    "sql_join_group_order",
    """SELECT o.o_orderpriority AS priority, count(*) AS n_lines,
              round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
       FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
       GROUP BY o.o_orderpriority ORDER BY priority""",
)
def _join_group_order(spark, sf_dir):
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (
        orders.join(items, orders.o_orderkey == items.l_orderkey)
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        )
        .orderBy("priority")
    )
