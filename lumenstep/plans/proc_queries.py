"""Queries over the procedure operators, with DuckDB statements where closed forms allow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphics as G
from ..operators import inference as I
from ..operators import likelihood as L
from ..operators import multivariate as M
from ..operators import regression as R
from ..operators import summary as S
from .catalog import query
from .relational_queries import t


def rounded(df, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("proc_means_class_types", """SELECT l_returnflag, l_linestatus, 3 - grouping_id(l_returnflag, l_linestatus) AS _TYPE_, count(*) AS _FREQ_, count(l_quantity) AS l_quantity_N, round(avg(l_quantity), 6) AS l_quantity_MEAN,
  round(stddev_samp(l_quantity), 6) AS l_quantity_STD, min(l_quantity) AS l_quantity_MIN, max(l_quantity) AS l_quantity_MAX FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _means(spark, d):
    return rounded(S.means(t(spark, d, "lineitem"), ["l_quantity"], classes=["l_returnflag", "l_linestatus"]))


@query("proc_means_ways", """SELECT l_returnflag, l_linestatus, 3 - grouping_id(l_returnflag, l_linestatus) AS _TYPE_, count(*) AS _FREQ_, round(sum(l_tax), 6) AS l_tax_SUM, round(max(l_tax) - min(l_tax), 6) AS l_tax_RANGE FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""")
def _ways(spark, d):
    return rounded(S.means(t(spark, d, "lineitem"), ["l_tax"], ["SUM", "RANGE"], ["l_returnflag", "l_linestatus"], ways=[1]))


_Q = "CASE WHEN n * {p} = floor(n * {p}) THEN (list[(n * {p})::INT] + list[(n * {p})::INT + 1]) / 2 ELSE list[floor(n * {p})::INT + 1] END"


@query("proc_means_quantiles", f"""SELECT l_returnflag, CASE WHEN l_returnflag IS NULL THEN 0::BIGINT ELSE 1::BIGINT END AS _TYPE_, n AS _FREQ_, round({_Q.format(p=0.5)}, 6) AS l_extendedprice_MEDIAN, round({_Q.format(p=0.25)}, 6) AS l_extendedprice_Q1, round({_Q.format(p=0.95)}, 6) AS l_extendedprice_P95
  FROM (SELECT l_returnflag, count(*) AS n, list(l_extendedprice ORDER BY l_extendedprice) AS list FROM lineitem GROUP BY ROLLUP (l_returnflag))""")
def _quantiles(spark, d):
    return rounded(S.means(t(spark, d, "lineitem"), ["l_extendedprice"], ["MEDIAN", "Q1", "P95"], ["l_returnflag"]))


@query("proc_means_weight", """SELECT l_returnflag, 1::BIGINT AS _TYPE_, count(*) AS _FREQ_, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS l_discount_MEAN, round((sum(l_quantity * l_discount * l_discount) - sum(l_quantity * l_discount) ** 2 / sum(l_quantity)) / (count(*) - 1), 8) AS l_discount_VAR FROM lineitem GROUP BY l_returnflag""")
def _weight(spark, d):
    return rounded(S.means(t(spark, d, "lineitem"), ["l_discount"], ["MEAN", "VAR"], ["l_returnflag"], weight="l_quantity", nway=True), 8)


@query("proc_means_clm")
def _clm(spark, d):
    return rounded(S.means(t(spark, d, "customer"), ["c_acctbal"], ["MEAN", "LCLM", "UCLM"], ["c_mktsegment"]))


@query("proc_freq_one_way", """SELECT o_orderpriority, n AS COUNT, round(100.0 * n / sum(n) OVER (), 8) AS PERCENT, (sum(n) OVER w)::BIGINT AS CUM_FREQ, round(100.0 * sum(n) OVER w / sum(n) OVER (), 8) AS CUM_PCT FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) WINDOW w AS (ORDER BY o_orderpriority)""")
def _freq1(spark, d):
    return rounded(S.freq_one_way(t(spark, d, "orders"), "o_orderpriority"), 8)


@query("proc_freq_two_way", """SELECT quality, toxic, n AS COUNT, round(100.0 * n / sum(n) OVER (), 8) AS PERCENT, round(100.0 * n / sum(n) OVER (PARTITION BY quality), 8) AS ROW_PCT, round(100.0 * n / sum(n) OVER (PARTITION BY toxic), 8) AS COL_PCT,
  round(1.0 * sum(n) OVER (PARTITION BY quality) * sum(n) OVER (PARTITION BY toxic) / sum(n) OVER (), 8) AS EXPECTED FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2)""")
def _freq2(spark, d):
    return rounded(S.freq_two_way(t(spark, d, "labels"), "quality", "toxic"), 8)


@query("proc_freq_strata", """SELECT o_orderstatus, o_orderpriority, m, n AS COUNT, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 8) AS PERCENT FROM (SELECT o_orderstatus, o_orderpriority, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2, 3)""", wide="m")
def _strata(spark, d):
    o = t(spark, d, "orders").withColumn("m", F.month("o_orderdate"))
    return rounded(S.freq_two_way(o, "o_orderpriority", "m", ["o_orderstatus"]).select("o_orderstatus", "o_orderpriority", "m", "COUNT", "PERCENT"), 8)


@query("proc_freq_weight", "SELECT l_returnflag, sum(l_quantity) AS COUNT, round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 8) AS PERCENT FROM lineitem GROUP BY 1")
def _freqw(spark, d):
    return rounded(S.freq_one_way(t(spark, d, "lineitem"), "l_returnflag", weight="l_quantity").select("l_returnflag", "COUNT", "PERCENT"), 8)


@query("proc_freq_margins", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS COUNT FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _margins(spark, d):
    return S.freq_margins(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("proc_freq_chisq", """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT n, 1.0 * sum(n) OVER (PARTITION BY o_orderstatus) * sum(n) OVER (PARTITION BY o_orderpriority) / sum(n) OVER () AS x FROM c)
  SELECT ((SELECT count(DISTINCT o_orderstatus) - 1 FROM c) * (SELECT count(DISTINCT o_orderpriority) - 1 FROM c))::BIGINT AS DF, round(sum((n - x) ** 2 / x), 6) AS CHISQ, round(2 * sum(n * ln(n / x)), 6) AS G2 FROM e""")
def _chisq(spark, d):
    return rounded(S.chisq_two_way(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("proc_freq_chisq_one", "SELECT (count(*) - 1)::BIGINT AS DF, round(sum(n * n) * count(*) / sum(n) - sum(n), 6) AS CHISQ FROM (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_orderpriority)")
def _chisq1(spark, d):
    return rounded(S.chisq_one_way(t(spark, d, "orders"), "o_orderpriority"))


for _test in ("FISHER", "RELRISK", "AGREE", "TREND", "CHISQ"):

    def _table(spark, d, test=_test):
        return rounded(I.table_test(t(spark, d, "labels"), "quality", "toxic", test), 8)

    query(f"proc_freq_{_test.lower()}_test")(_table)


@query("proc_tabulate", """SELECT l_returnflag, l_linestatus, 3 - grouping_id(l_returnflag, l_linestatus) AS _TYPE_, count(l_quantity) AS N, sum(l_quantity) AS SUM, round(avg(l_quantity), 6) AS MEAN, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS PCTN, round(100.0 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS PCTSUM
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _tabulate(spark, d):
    return rounded(S.tabulate(t(spark, d, "lineitem"), [["l_returnflag", "ALL"], ["l_linestatus", "ALL"]], "l_quantity", ["N", "SUM", "MEAN", "PCTN", "PCTSUM"]))


@query("proc_report_break", """SELECT n_regionkey, n_name, count(*)::BIGINT AS n_nationkey, CASE grouping_id(n_regionkey, n_name) WHEN 1 THEN 'n_regionkey' WHEN 3 THEN '_RBREAK_' END AS _BREAK_ FROM nation GROUP BY ROLLUP (n_regionkey, n_name)""")
def _report(spark, d):
    return S.report(t(spark, d, "nation"), ["n_regionkey", "n_name"], {"n_nationkey": "N"}, break_after=["n_regionkey"], rbreak=True)


@query("proc_report_across", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O FROM orders GROUP BY 1")
def _across(spark, d):
    return rounded(S.report(t(spark, d, "orders"), ["o_orderpriority"], {"o_totalprice": "SUM"}, across="o_orderstatus", across_values=["F", "O"]).drop("_BREAK_"), 2)


@query("proc_univariate_moments", """SELECT 'p_retailprice' AS VAR_NAME, count(*)::DOUBLE AS N, round(avg(p_retailprice), 6) AS MEAN, round(stddev_samp(p_retailprice), 6) AS STD, round(skewness(p_retailprice), 6) + 0.0 AS SKEWNESS, round(kurtosis(p_retailprice), 6) AS KURTOSIS, round(var_pop(p_retailprice) * count(*), 3) AS CSS FROM part""")
def _univariate(spark, d):
    u = S.univariate(t(spark, d, "part"), ["p_retailprice"])
    return u.select("VAR_NAME", "N", F.round("MEAN", 6).alias("MEAN"), F.round("STD", 6).alias("STD"), (F.round("SKEWNESS", 6) + 0.0).alias("SKEWNESS"), F.round("KURTOSIS", 6).alias("KURTOSIS"), F.round("CSS", 3).alias("CSS"))


@query("proc_univariate_mode", "SELECT l_returnflag, arg_min(q, (-n, q)) AS MODE FROM (SELECT l_returnflag, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 1 GROUP BY 1")
def _mode(spark, d):
    return S.mode(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("proc_univariate_extremes", "(SELECT c_acctbal, c_custkey, 'low' AS SIDE FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL (SELECT c_acctbal, c_custkey, 'high' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)")
def _extremes(spark, d):
    return S.extremes(t(spark, d, "customer"), "c_acctbal", ["c_custkey"])


@query("proc_univariate_normality")
def _normality(spark, d):
    return rounded(I.normality(t(spark, d, "customer"), "c_acctbal"))


@query("proc_univariate_histogram", "SELECT floor(p_size / 10.0) * 10 + 5.0 AS MIDPOINT, count(*) AS COUNT, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS PERCENT FROM part WHERE p_size < 50 GROUP BY 1")
def _histogram(spark, d):
    return rounded(S.histogram(t(spark, d, "part").where("p_size < 50"), "p_size", 0.0, 10.0, 5))


@query("proc_univariate_histogram_all", "SELECT floor(p_size / 10.0) * 10 + 5.0 AS MIDPOINT, count(*) AS COUNT, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS PERCENT FROM part GROUP BY 1")
def _histogram_all(spark, d):
    return rounded(S.histogram(t(spark, d, "part"), "p_size", 0.0, 10.0, 6))


@query("proc_univariate_weighted_quantile", """SELECT min(x) AS MEDIAN FROM (SELECT l_quantity AS x, sum(l_tax + 0.01) OVER (ORDER BY l_quantity) AS cum, sum(l_tax + 0.01) OVER () AS total FROM lineitem) WHERE cum >= total / 2""")
def _wq(spark, d):
    return S.weighted_quantiles(t(spark, d, "lineitem").withColumn("w", F.col("l_tax") + 0.01), "l_quantity", "w", {"MEDIAN": 0.5})


@query("proc_compare", """SELECT p_partkey, 'p_size' AS VAR, p_size::VARCHAR AS BASE, (p_size + 1)::VARCHAR AS COMPARE FROM part WHERE p_partkey % 7 = 0""")
def _compare(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return S.compare(p, p.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), [], ["p_partkey"])


@query("proc_contents", "SELECT * FROM (VALUES (1, 'r_regionkey', 'num'), (2, 'r_name', 'char')) v(VARNUM, NAME, TYPE)")
def _contents(spark, d):
    return S.contents(t(spark, d, "region")).select("VARNUM", "NAME", "TYPE")


@query("proc_corr_pearson", "SELECT 'l_quantity' AS VAR, 'l_extendedprice' AS \"WITH\", count(*) AS N, round(corr(l_quantity, l_extendedprice), 8) AS R FROM lineitem")
def _pearson(spark, d):
    return rounded(I.corr(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("VAR", "WITH", "N", "R"), 8)


@query("proc_corr_spearman", """SELECT 'p_size' AS VAR, 'p_retailprice' AS "WITH", count(*) AS N, round(corr(a, b), 8) AS R FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)""")
def _spearman(spark, d):
    return rounded(I.corr(t(spark, d, "part"), ["p_size", "p_retailprice"], method="SPEARMAN").select("VAR", "WITH", "N", "R"), 8)


@query("proc_corr_kendall", """WITH p AS (SELECT p_partkey AS k, p_size AS a, p_retailprice AS b FROM part WHERE p_partkey < 150) SELECT 'p_size' AS VAR, 'p_retailprice' AS "WITH", (SELECT count(*) FROM p) AS N,
  round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))), 8) AS R FROM p x JOIN p y ON x.k < y.k""")
def _kendall(spark, d):
    return rounded(I.corr(t(spark, d, "part").where("p_partkey < 150"), ["p_size", "p_retailprice"], method="KENDALL").select("VAR", "WITH", "N", "R"), 8)


@query("proc_corr_kendall_all")
def _kendall_all(spark, d):
    return rounded(I.corr(t(spark, d, "part"), ["p_size", "p_retailprice"], method="KENDALL").select("VAR", "WITH", "N", "R"), 8)


@query("proc_corr_partial", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem) SELECT 'l_quantity' AS VAR, 'l_extendedprice' AS "WITH", round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS R FROM c""")
def _partial(spark, d):
    return rounded(I.corr(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], partial=["l_discount"]).select("VAR", "WITH", "R"), 8)


@query("proc_ttest_one", "SELECT count(*)::DOUBLE AS N, round(avg(c_acctbal), 6) AS MEAN, round((avg(c_acctbal) - 4000) / (stddev_samp(c_acctbal) / sqrt(count(*))), 8) AS T FROM customer")
def _t1(spark, d):
    return I.ttest_one(t(spark, d, "customer"), "c_acctbal", 4000.0).select("N", F.round("MEAN", 6).alias("MEAN"), F.round("T", 8).alias("T"))


@query("proc_ttest_two", """WITH g AS (SELECT l_linestatus AS k, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 8) AS T,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 8) AS T_SATTERTHWAITE, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS DF_SATTERTHWAITE, round(greatest(a.v / b.v, b.v / a.v), 8) AS F FROM g a JOIN g b ON a.k < b.k""")
def _t2(spark, d):
    r = I.ttest_two(t(spark, d, "lineitem"), "l_quantity", "l_linestatus")
    return r.select(F.round("T", 8).alias("T"), F.round("T_SATTERTHWAITE", 8).alias("T_SATTERTHWAITE"), F.round("DF_SATTERTHWAITE", 4).alias("DF_SATTERTHWAITE"), F.round("F", 8).alias("F"))


@query("proc_ttest_paired", "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS T FROM lineitem")
def _tp(spark, d):
    return I.ttest_paired(t(spark, d, "lineitem"), "l_discount", "l_tax").select(F.round("T", 6).alias("T"))


@query("proc_npar1way_kruskal", """WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a FROM customer), s AS (SELECT g, count(*) AS n, sum(a) AS s, sum(a * a) AS q FROM r GROUP BY g), w AS (SELECT sum(n) AS n, sum(s) / sum(n) AS m, sum(q) AS q FROM s)
  SELECT round((w.n - 1) / (w.q - w.n * w.m * w.m) * (SELECT sum(s.n * (s.s / s.n - w.m) ** 2) FROM s), 6) AS CHISQ FROM w""")
def _kruskal(spark, d):
    return I.npar1way(t(spark, d, "customer"), "c_acctbal", "c_mktsegment").select(F.round("CHISQ", 6).alias("CHISQ"))


for _score in ("MEDIAN", "SAVAGE", "NORMAL"):

    def _npar(spark, d, score=_score):
        return rounded(I.npar1way(t(spark, d, "lineitem"), "l_extendedprice", "l_linestatus", score))

    query(f"proc_npar1way_{_score.lower()}")(_npar)


@query("proc_reg_ols", """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS SLOPE, round(regr_intercept(l_extendedprice, l_quantity), 4) AS INTERCEPT, round(regr_r2(l_extendedprice, l_quantity), 8) AS RSQUARE FROM lineitem""")
def _reg(spark, d):
    fit = R.regress(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(fit.beta[1]), 6), round(float(fit.beta[0]), 4), round(fit.anova()["RSQUARE"], 8))], "SLOPE double, INTERCEPT double, RSQUARE double")


@query("proc_reg_estimates")
def _reg_est(spark, d):
    li = t(spark, d, "lineitem")
    return rounded(R.estimates(li, R.regress(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])))


@query("proc_reg_output", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - (b0 + b1 * l_quantity), 4) AS R FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem)""")
def _reg_out(spark, d):
    li = t(spark, d, "lineitem")
    return R.output(li, R.regress(li, "l_extendedprice", ["l_quantity"])).select("l_orderkey", "l_linenumber", "l_partkey", F.round("R", 4).alias("R"))


@query("proc_reg_stepwise")
def _step(spark, d):
    li = t(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    fit, steps = R.select(R.regress(li, "net", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]), "STEPWISE")
    return spark.createDataFrame([(a, v, round(float(r), 8)) for a, v, r in steps], "ACTION string, VARIABLE string, RSQUARE double")


@query("proc_anova_one_way", """WITH g AS (SELECT c_mktsegment AS k, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss FROM customer GROUP BY 1), w AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(ss) AS sse, count(*) AS k FROM g)
  SELECT 'c_mktsegment' AS EFFECT, (k - 1)::BIGINT AS DF, round((SELECT sum(g.n * (g.m - w.m) ** 2) FROM g), 1) AS SS, round((SELECT sum(g.n * (g.m - w.m) ** 2) FROM g) / (k - 1) / (sse / (n - k)), 6) AS F FROM w""")
def _anova(spark, d):
    a = R.type_one(R.general_linear(t(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], ["c_mktsegment"]))
    return spark.createDataFrame([(r["EFFECT"], r["DF"], round(r["SS"], 1), round(r["F"], 6)) for r in a], "EFFECT string, DF long, SS double, F double")


@query("proc_glm_two_way")
def _glm(spark, d):
    m = R.general_linear(t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_returnflag*l_linestatus", "l_quantity"], ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(r["EFFECT"], r["DF"], round(r["F"], 6), round(r["P"], 6)) for r in R.type_three(m)], "EFFECT string, DF long, F double, P double")


@query("proc_logistic")
def _logistic(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("y", (F.col("o_totalprice") > 150000).cast("int")).withColumn("b", F.round(F.col("c_acctbal") / 1000))
    fit = L.logistic(x, "y", ["b", "c_mktsegment"], ["c_mktsegment"], event=1)
    return spark.createDataFrame([(r["VARIABLE"], round(r["ESTIMATE"], 6), round(r["STDERR"], 6), round(r["ODDS"], 6)) for r in fit["parameters"]], "VARIABLE string, ESTIMATE double, STDERR double, ODDS double")


@query("proc_genmod_poisson")
def _genmod(spark, d):
    x = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("b", F.round(F.col("c_acctbal") / 1000))
    fit = L.genmod(x, "n", ["b"], "POISSON")
    return spark.createDataFrame([(r["VARIABLE"], round(r["ESTIMATE"], 6), round(r["STDERR"], 6)) for r in fit["parameters"]], "VARIABLE string, ESTIMATE double, STDERR double")


@query("proc_mixed_intercept")
def _mixed(spark, d):
    fit = L.mixed(t(spark, d, "orders").withColumn("p", F.col("o_totalprice") / 1e5), "p", ["o_orderstatus"], "o_custkey", ["o_orderstatus"])
    return spark.createDataFrame([(r["EFFECT"], round(r["ESTIMATE"], 5)) for r in fit["fixed"]] + [(k, round(v, 5)) for k, v in fit["covariance"].items()], "EFFECT string, ESTIMATE double")


@query("proc_glimmix_poisson")
def _glimmix(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    fit = L.glimmix(x, "n", ["l_returnflag"], "l_suppkey", "POISSON", ["l_returnflag"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in {**fit["fixed"], **fit["covariance"]}.items()], "EFFECT string, ESTIMATE double")


@query("proc_princomp")
def _princomp(spark, d):
    stats, _ = M.princomp(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([(k + 1, round(float(v), 6), round(float(p), 6)) for k, (v, p) in enumerate(zip(stats["eigenvalues"], stats["proportion"], strict=True))], "N int, EIGENVALUE double, PROPORTION double")


@query("proc_factor_varimax")
def _factor(spark, d):
    stats, _ = M.factor(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2, "VARIMAX")
    return spark.createDataFrame([(k, *(round(float(v), 5) for v in row)) for k, row in enumerate(stats["loadings"])], "VAR int, F1 double, F2 double")


@query("proc_distance", """SELECT a.vec_id AS ID1, b.vec_id AS ID2, round(sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.embedding, b.embedding)])), 5) AS DISTANCE FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id < 0""".replace("round(sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.embedding, b.embedding)])), 5)", "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5)").replace("WHERE a.vec_id < 0", "WHERE a.vec_id < 40 AND b.vec_id < 40"))
def _distance(spark, d):
    return M.distance(t(spark, d, "embeddings").where("vec_id < 40"), "vec_id", "embedding", digits=5)


@query("proc_distance_all", "SELECT a.vec_id AS ID1, b.vec_id AS ID2, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS DISTANCE FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def _distance_all(spark, d):
    return M.distance(t(spark, d, "embeddings"), "vec_id", "embedding", most_rows=None, digits=5)


@query("proc_cluster_ward")
def _cluster(spark, d):
    rows = M.cluster(t(spark, d, "supplier"), ["s_acctbal"], "s_suppkey", "WARD")
    return spark.createDataFrame([(s, a, b, round(h, 4), n) for s, a, b, h, n in rows], "STEP int, A string, B string, HEIGHT double, SIZE int")


@query("proc_fastclus")
def _fastclus(spark, d):
    _, out = M.fastclus(t(spark, d, "embeddings"), "embedding", 4, rounds=5)
    return out.groupBy("CLUSTER").agg(F.count("*").alias("N"), F.round(F.avg("DISTANCE"), 4).alias("MEAN_DISTANCE"))


@query("proc_discrim")
def _discrim(spark, d):
    _, out = M.discrim(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return M.error_rates(out, "l_returnflag")


@query("plot_bars", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS MEAN FROM customer GROUP BY 1")
def _bars(spark, d):
    return rounded(G.bars(t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "MEAN"))


@query("plot_box")
def _box(spark, d):
    return rounded(G.box(t(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))
