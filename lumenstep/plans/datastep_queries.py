"""Queries over the data-step operators, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datastep as D
from ..operators import sorting as S
from .catalog import query
from .relational_queries import t


@query("ds_first_last", """SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) = 1)::INT AS first_o_orderstatus,
  (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC, o_orderkey DESC) = 1)::INT AS last_o_orderstatus,
  (row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) = 1)::INT AS first_o_custkey,
  (row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey DESC) = 1)::INT AS last_o_custkey FROM orders""")
def _first_last(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return D.first_last(o, ["o_orderstatus", "o_custkey"], ["o_orderkey"]).drop("o_orderstatus", "o_custkey")


@query("ds_running_sum", """SELECT o_orderkey, round(sum(coalesce(nullif(o_totalprice, 0), 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders""")
def _running(spark, d):
    o = D.running_sum(t(spark, d, "orders"), "total", F.nullif("o_totalprice", F.lit(0.0)), ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return o.select("o_orderkey", F.round("total", 2).alias("total"))


@query("ds_retain", """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1.0) AS kept FROM events""")
def _retain(spark, d):
    e = t(spark, d, "events")
    return D.retain(e, "kept", F.when(F.col("event_type") == "purchase", F.col("value")), ["ts", "event_id"], ["user_id"], -1.0).select("event_id", "kept")


@query("ds_lag_dif", """SELECT event_id, lag(value, 2) OVER w AS lag2, round(value - lag(value, 1) OVER w, 6) AS dif1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _lag_dif(spark, d):
    e = D.lag(t(spark, d, "events"), "lag2", F.col("value"), ["ts", "event_id"], 2, ["user_id"])
    return D.dif(e, "dif1", F.col("value"), ["ts", "event_id"], 1, ["user_id"]).select("event_id", "lag2", F.round("dif1", 6).alias("dif1"))


@query("ds_lag_conditional", """SELECT event_id, CASE WHEN value > 50 THEN lag(value) OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) END AS prior FROM events""")
def _lag_cond(spark, d):
    return D.lag(t(spark, d, "events"), "prior", F.col("value"), ["ts", "event_id"], 1, ["user_id"], F.col("value") > 50).select("event_id", "prior")


@query("ds_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _n_ FROM orders")
def _numbers(spark, d):
    return D.row_numbers(t(spark, d, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "_n_")


@query("ds_end_nobs", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_name DESC) = 1)::INT AS eof, count(*) OVER () AS nobs FROM nation")
def _end(spark, d):
    return D.flags(t(spark, d, "nation"), ["n_name"], "eof", "nobs").select("n_nationkey", "eof", "nobs")


@query("ds_point", "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) WHERE k IN (2, 5, 9)")
def _point(spark, d):
    return D.point(t(spark, d, "nation"), ["n_nationkey"], [9, 2, 5]).select("n_name")


@query("ds_obs_window", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 6 OFFSET 4")
def _obs(spark, d):
    return D.obs_window(t(spark, d, "nation"), ["n_nationkey"], 5, 10).select("n_name")


@query("ds_set_concat", "SELECT n_name AS name, n_nationkey AS k, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def _concat(spark, d):
    return D.set_concat(t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("ds_interleave", "SELECT c_nationkey AS k, c_name AS name, 0 AS __set FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier ORDER BY k, __set")
def _interleave(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    b = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return D.interleave([a, b], ["k"])


@query("ds_merge_in", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey % 3 <> 0),
  b AS (SELECT c_custkey AS k, c_name AS y, c_acctbal AS v, 1 AS rn, 1 AS n FROM customer WHERE c_custkey % 2 = 0),
  g AS (SELECT coalesce(p.k, q.k) AS k, p.n AS na, q.n AS nb, unnest(range(1, greatest(coalesce(p.n, 0), coalesce(q.n, 0)) + 1)) AS rn FROM (SELECT DISTINCT k, n FROM a) p FULL JOIN (SELECT DISTINCT k, n FROM b) q ON p.k = q.k)
  SELECT g.k, a.x, CASE WHEN g.rn <= g.nb THEN b.v WHEN g.rn <= g.na THEN a.v END AS v, b.y, (g.na IS NOT NULL)::INT AS in_a, (g.nb IS NOT NULL)::INT AS in_b
  FROM g LEFT JOIN a ON a.k = g.k AND a.rn = least(g.rn, g.na) LEFT JOIN b ON b.k = g.k AND b.rn = least(g.rn, g.nb)""")
def _merge(spark, d):
    a = t(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("v"))
    b = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("y"))
    return D.match_merge([a, b], ["k"], [["x"], ["y"]], ["in_a", "in_b"])


@query("ds_merge_in_all", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
  b AS (SELECT c_custkey + 10 AS k, c_name AS y, c_acctbal AS v, 1 AS rn, 1 AS n FROM customer),
  g AS (SELECT coalesce(p.k, q.k) AS k, p.n AS na, q.n AS nb, unnest(range(1, greatest(coalesce(p.n, 0), coalesce(q.n, 0)) + 1)) AS rn FROM (SELECT DISTINCT k, n FROM a) p FULL JOIN (SELECT DISTINCT k, n FROM b) q ON p.k = q.k)
  SELECT g.k, a.x, CASE WHEN g.rn <= g.nb THEN b.v WHEN g.rn <= g.na THEN a.v END AS v, b.y, (g.na IS NOT NULL)::INT AS in_a, (g.nb IS NOT NULL)::INT AS in_b
  FROM g LEFT JOIN a ON a.k = g.k AND a.rn = least(g.rn, g.na) LEFT JOIN b ON b.k = g.k AND b.rn = least(g.rn, g.nb)""")
def _merge_all(spark, d):
    a = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("v"))
    b = t(spark, d, "customer").select((F.col("c_custkey") + 10).alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("y"))
    return D.match_merge([a, b], ["k"], [["x"], ["y"]], ["in_a", "in_b"])


@query("ds_merge_many_to_many", """WITH a AS (SELECT c_nationkey AS k, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
  b AS (SELECT s_nationkey AS k, s_suppkey AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
  g AS (SELECT coalesce(p.k, q.k) AS k, p.n AS na, q.n AS nb, unnest(range(1, greatest(coalesce(p.n, 0), coalesce(q.n, 0)) + 1)) AS rn FROM (SELECT DISTINCT k, n FROM a) p FULL JOIN (SELECT DISTINCT k, n FROM b) q ON p.k = q.k)
  SELECT g.k, a.x, b.y FROM g LEFT JOIN a ON a.k = g.k AND a.rn = least(g.rn, g.na) LEFT JOIN b ON b.k = g.k AND b.rn = least(g.rn, g.nb)""")
def _merge_mm(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("x"))
    b = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("y"))
    return D.match_merge([a, b], ["k"], [["x"], ["y"]])


@query("ds_one_to_one", "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) USING (k)")
def _one(spark, d):
    return D.one_to_one([t(spark, d, "nation").select("n_nationkey", "n_name"), t(spark, d, "region").select("r_regionkey", "r_name")], [["n_nationkey"], ["r_regionkey"]]).select("n_name", "r_name")


@query("ds_update", """SELECT c_custkey, coalesce(tx.bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_min(nullif(round(o_totalprice, 0), 1), o_orderkey) AS bal FROM orders GROUP BY o_custkey) tx ON o_custkey = c_custkey""")
def _update(spark, d):
    tx = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.round("o_totalprice", 0).alias("c_acctbal"))
    return D.update(t(spark, d, "customer").select("c_custkey", "c_acctbal"), tx, ["c_custkey"], ["o_orderkey"]).select("c_custkey", "c_acctbal")


@query("ds_dataset_options", "SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 0")
def _options(spark, d):
    return D.dataset_options(t(spark, d, "customer"), keep=["c_custkey", "c_name", "c_acctbal"], drop=["c_acctbal"], rename={"c_custkey": "id"}, where="c_acctbal > 0")


@query("ds_multi_output", """SELECT c_custkey, 'a' AS tag, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'b', c_acctbal * 2 FROM customer""")
def _multi(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return D.multi_output(c, [{"tag": F.lit("a"), "v": F.col("c_acctbal")}, {"tag": F.lit("b"), "v": F.col("c_acctbal") * 2}]).select("c_custkey", "tag", "v")


@query("ds_do_loop", "SELECT n_nationkey, i, n_nationkey * i AS x FROM nation, unnest(range(1, n_regionkey + 1)) AS u(i)", wide="i x")
def _loop(spark, d):
    return D.do_loop(t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "i", F.lit(1), F.col("n_regionkey"), F.lit(1), {"x": F.col("n_nationkey") * F.col("i")}).drop("n_regionkey")


@query("ds_select_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS g FROM part")
def _when(spark, d):
    return t(spark, d, "part").select("p_partkey", D.select_when([(F.col("p_size") < 10, F.lit(1)), (F.col("p_size") < 30, F.lit(2))], F.lit(3)).alias("g"))


@query("ds_over_array", "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 6) AS l_discount, round(l_tax * 100, 6) AS l_tax FROM lineitem")
def _over(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return D.over_array(x, ["l_discount", "l_tax"], lambda c: F.round(c * 100, 6))


@query("ds_hash_summary", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY o_custkey")
def _summary(spark, d):
    return D.hash_summary(t(spark, d, "orders"), ["o_custkey"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


@query("ds_recurrence", """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT event_id, user_id, k, value AS s FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN r.s > 100 THEN e.value ELSE r.s + e.value END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT event_id, round(s, 6) AS s FROM r""")
def _recurrence(spark, d):
    def step(row, state):
        state["s"] = row["value"] if state.get("s", 101) > 100 else state["s"] + row["value"]
        return {"event_id": row["event_id"], "s": round(state["s"], 6)}

    return D.recurrence(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], step, "event_id long, s double")


@query("proc_sort", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey")
def _sort(spark, d):
    return S.sort(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["-o_orderstatus", "o_orderkey"])


@query("proc_sort_nodupkey", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _nodup(spark, d):
    return S.nodupkey(t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("proc_sort_noduprecs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _noduprecs(spark, d):
    return S.noduprecs(t(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus"], ["o_orderpriority"])


for _ties, _expr in {"MEAN": "(r + h) / 2.0", "LOW": "r::DOUBLE", "HIGH": "h::DOUBLE", "DENSE": "dr::DOUBLE"}.items():

    def _rank(spark, d, ties=_ties):
        return S.rank(t(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], ties=ties, names=["r"]).select("p_partkey", "r")

    query(f"proc_rank_{_ties.lower()}", f"""SELECT p_partkey, {_expr} AS r FROM (SELECT p_partkey, rank() OVER (ORDER BY p_size) AS r, rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1 AS h, dense_rank() OVER (ORDER BY p_size) AS dr FROM part)""")(_rank)


@query("proc_rank_groups", "SELECT c_custkey, floor(4 * rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) / (count(*) OVER (PARTITION BY c_mktsegment) + 1))::DOUBLE AS g FROM customer")
def _groups(spark, d):
    return S.rank(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"], ["c_mktsegment"], "LOW", groups=4, names=["g"]).select("c_custkey", "g")


@query("proc_rank_percent_desc", "SELECT c_custkey, 100.0 * rank() OVER (ORDER BY c_acctbal DESC) / count(*) OVER () AS g FROM customer")
def _percent(spark, d):
    return S.rank(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], ties="LOW", descending=True, method="PERCENT", names=["g"]).select("c_custkey", "g")


@query("proc_rank_savage", """SELECT c_custkey, round((SELECT sum(1.0 / (n - j + 1)) FROM (SELECT unnest(range(1, r + 1)) AS j)) - 1, 8) AS s FROM (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) AS r, count(*) OVER () AS n FROM customer WHERE c_custkey <= 120)""")
def _savage(spark, d):
    c = t(spark, d, "customer").where("c_custkey <= 120").select("c_custkey", "c_acctbal")
    return S.rank(c, ["c_acctbal"], method="SAVAGE", names=["s"]).select("c_custkey", F.round("s", 8).alias("s"))


@query("proc_rank_savage_all", """WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS j, count(*) OVER () AS n FROM customer), h AS (SELECT *, sum(1.0::DOUBLE / (n - j + 1)) OVER (ORDER BY j) - 1 AS s FROM c)
  SELECT c_custkey, round(avg(s) OVER (PARTITION BY c_acctbal), 6) AS s FROM h""")
def _savage_all(spark, d):
    return S.rank(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], method="SAVAGE", names=["s"]).select("c_custkey", F.round("s", 6).alias("s"))


@query("proc_rank_blom")
def _blom(spark, d):
    return S.rank(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], method="BLOM", names=["z"]).select("c_custkey", F.round("z", 8).alias("z"))


@query("proc_transpose_id", """SELECT o_orderpriority, 'o_totalprice' AS _NAME_, sum(CASE WHEN o_orderstatus = 'F' THEN p END) AS F, sum(CASE WHEN o_orderstatus = 'O' THEN p END) AS O, sum(CASE WHEN o_orderstatus = 'P' THEN p END) AS P
  FROM (SELECT o_orderpriority, o_orderstatus, round(max(o_totalprice), 2) AS p FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def _transpose(spark, d):
    o = t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.max("o_totalprice"), 2).alias("o_totalprice"))
    return S.transpose(o, ["o_totalprice"], ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("proc_transpose_numbered", """SELECT n_regionkey, 'n_name' AS _NAME_, max(CASE WHEN k = 1 THEN n_name END) AS COL1, max(CASE WHEN k = 2 THEN n_name END) AS COL2, max(CASE WHEN k = 3 THEN n_name END) AS COL3, max(CASE WHEN k = 4 THEN n_name END) AS COL4, max(CASE WHEN k = 5 THEN n_name END) AS COL5
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey""")
def _transpose_n(spark, d):
    return S.transpose(t(spark, d, "nation"), ["n_name"], ["n_regionkey"], order=["n_nationkey"])
