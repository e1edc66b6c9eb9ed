"""Queries over the relational operators, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import call
from ..operators import relational as R
from ..sql import run_sql
from .catalog import query


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("sql_predicates", """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 30
  AND contains(p_type, 'A') AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 40) AND p_retailprice IS NOT NULL""")
def _predicates(spark, d):
    return run_sql(spark, {"part": t(spark, d, "part")}, """select p_partkey, p_name from part where p_name like '%a%' and p_size between 5 and 30
        and p_type contains 'A' and p_brand in (select p_brand from part where p_size > 40) and p_retailprice is not missing""")


@query("sql_calculated", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(round(l_extendedprice * (1 - l_discount), 4) * (1 + l_tax), 6) AS gross
  FROM lineitem WHERE round(l_extendedprice * (1 - l_discount), 4) > 50000""")
def _calculated(spark, d):
    return run_sql(spark, {"lineitem": t(spark, d, "lineitem")}, """select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net,
        round(calculated net * (1 + l_tax), 6) as gross from lineitem where calculated net > 50000""")


@query("sql_missing_literal", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) WHERE k IS NULL")
def _missing(spark, d):
    return run_sql(spark, {"customer": t(spark, d, "customer")}, "select count(*) as n from (select nullif(c_nationkey, 3) as k from customer) where k = .")


@query("sql_remerge", "SELECT l_orderkey, l_linenumber, l_quantity, round(100 * l_quantity / sum(l_quantity) OVER (), 10) AS pct FROM lineitem WHERE l_linenumber = 1")
def _remerge(spark, d):
    x = t(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.remerge(x, {"s": F.sum("l_quantity")}).select("l_orderkey", "l_linenumber", "l_quantity", F.round(100 * F.col("l_quantity") / F.col("s"), 10).alias("pct"))


@query("sql_remerge_group", """SELECT o_orderkey, o_orderstatus, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS diff FROM orders""")
def _remerge_group(spark, d):
    x = R.remerge_by_join(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"m": F.avg("o_totalprice")}, ["o_orderstatus"])
    return x.select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("diff"))


_NULL_SIDES = """(SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer) a {how} JOIN (SELECT nullif(s_nationkey, 3) AS k, s_suppkey FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k"""


def _nullsafe(how):
    def run(spark, d):
        a = t(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey")
        b = t(spark, d, "supplier").select(F.nullif("s_nationkey", F.lit(3)).alias("k"), "s_suppkey")
        return R.spread_join(a, b, ["k"], how)

    return run


for _how in ("inner", "left", "right", "full"):
    query(f"sql_{_how}_nullsafe", f"SELECT coalesce(a.k, b.k) AS k, c_custkey, s_suppkey FROM {_NULL_SIDES.format(how=_how.upper())}")(_nullsafe(_how))


@query("sql_theta_left", """SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 LEFT JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey""")
def _theta(spark, d):
    n = t(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return R.theta_join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")), "left").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey")
def _cross(spark, d):
    return run_sql(spark, {x: t(spark, d, x) for x in ("region", "nation")}, "select r_name, n_name from region cross join nation where r_regionkey = n_regionkey")


for _op, _sql in (("UNION", "UNION"), ("EXCEPT", "EXCEPT"), ("INTERSECT", "INTERSECT")):
    for _all in (False, True):

        def _set(spark, d, op=_op, every=_all):
            a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
            return R.set_operation(a, b, op, every)

        query(f"sql_{_op.lower()}{'_all' * _all}", f"SELECT c_nationkey AS k FROM customer {_sql}{' ALL' * _all} SELECT s_nationkey FROM supplier")(_set)


@query("sql_outer_union", "SELECT c_custkey, c_nationkey, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT NULL, NULL, s_suppkey FROM supplier")
def _outer_union(spark, d):
    return R.set_operation(t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "supplier").select("s_suppkey"), "OUTER UNION")


@query("sql_group_having", """SELECT c_mktsegment, c_nationkey, count(*) AS n, count(DISTINCT c_acctbal) AS d, round(avg(c_acctbal), 6) AS m, min(c_name) AS lo, max(c_name) AS hi
  FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 10""")
def _having(spark, d):
    return run_sql(spark, {"customer": t(spark, d, "customer")}, """select c_mktsegment, c_nationkey, count(*) as n, count(distinct c_acctbal) as d, round(avg(c_acctbal), 6) as m,
        min(c_name) as lo, max(c_name) as hi from customer group by 1, 2 having count(*) > 10""")


@query("sql_distinct_order", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY 1, 2 DESC")
def _distinct(spark, d):
    return run_sql(spark, {"orders": t(spark, d, "orders")}, "select distinct o_orderpriority, o_orderstatus from orders order by 1, 2 desc")


@query("sql_subqueries", """SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
  AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def _subqueries(spark, d):
    return run_sql(spark, {x: t(spark, d, x) for x in ("customer", "orders", "nation")}, """select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer)
        and exists (select 1 from orders where o_custkey = c_custkey) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)""")


@query("sql_sounds_like", "SELECT n_name FROM nation WHERE n_name = 'NATION_3'")
def _sounds(spark, d):
    return run_sql(spark, {"nation": t(spark, d, "nation").where("n_name = 'NATION_3'")}, "select n_name from nation where n_name sounds like 'NADION'")


@query("sql_sounds_like_all")
def _sounds_all(spark, d):
    return run_sql(spark, {"nation": t(spark, d, "nation"), "region": t(spark, d, "region")}, "select n_name as name from nation where n_name sounds like 'NADION' union all select r_name from region where r_name sounds like 'AMERIKA'")


@query("sql_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _update(spark, d):
    return R.update_set(t(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)


@query("sql_delete", "SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) WHERE NOT coalesce(k > 10, false)")
def _delete(spark, d):
    return R.delete_where(t(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k")), F.col("k") > 10)


@query("sql_insert", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (99, 'NOWHERE') UNION ALL SELECT n_nationkey, n_name FROM nation")
def _insert(spark, d):
    r = R.insert_values(t(spark, d, "region"), [(99, "NOWHERE")])
    return R.insert_select(r, t(spark, d, "nation").select("n_nationkey", "n_name"))


@query("proc_append_force", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, n_name FROM nation")
def _append(spark, d):
    return R.append(t(spark, d, "region"), t(spark, d, "nation").select(F.col("n_name").alias("r_name"), "n_nationkey"), force=True)


@query("ds_hash_lookup", """SELECT s_suppkey, n_name, CASE WHEN n_name IS NULL THEN 0 ELSE 1 END AS found FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""")
def _hash(spark, d):
    n = t(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "s_nationkey")
    return R.lookup(t(spark, d, "supplier"), n, ["s_nationkey"], ["n_name"], "found").select("s_suppkey", "n_name", "found")


@query("fmt_range_lookup", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS label FROM part""")
def _ranges(spark, d):
    r = spark.createDataFrame([(0, 10, "small"), (10, 30, "medium"), (30, 1000, "large")], "low int, high int, label string")
    return R.range_lookup(t(spark, d, "part"), "p_size", r, "label").select("p_partkey", "label")


@query("sql_case_functions", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_brand) ELSE lower(p_brand) END AS b FROM part")
def _case(spark, d):
    return t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, call("UPCASE", "p_brand")).otherwise(call("LOWCASE", "p_brand")).alias("b"))
