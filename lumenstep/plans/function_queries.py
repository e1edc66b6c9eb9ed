"""Queries over scalar functions and formats, one for each family, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import formats
from ..functions import call
from ..functions import regex as X
from .catalog import query
from .relational_queries import t


@query("fn_descriptive", """SELECT l_orderkey, l_linenumber, l_partkey, round(list_sum(list_filter(l, lambda x: x IS NOT NULL)), 6) AS s, round(list_avg(list_filter(l, lambda x: x IS NOT NULL)), 6) AS m, list_min(l) AS lo, list_max(l) AS hi,
  len(list_filter(l, lambda x: x IS NOT NULL)) AS n, 3 - len(list_filter(l, lambda x: x IS NOT NULL)) AS nm, round(list_max(l) - list_min(l), 6) AS r, list_sort(list_filter(l, lambda x: x IS NOT NULL))[1] AS k1, list_reverse_sort(list_filter(l, lambda x: x IS NOT NULL))[2] AS k2
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, [l_discount, nullif(l_tax, 0.02), l_quantity] AS l FROM lineitem)""", wide="n nm")
def _descriptive(spark, d):
    a = ("l_discount", F.nullif("l_tax", F.lit(0.02)), "l_quantity")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(call("SUM", *a), 6).alias("s"), F.round(call("MEAN", *a), 6).alias("m"), call("MIN", *a).alias("lo"), call("MAX", *a).alias("hi"), call("N", *a).alias("n"),
        call("NMISS", *a).alias("nm"), F.round(call("RANGE", *a), 6).alias("r"), call("SMALLEST", 1, *a).alias("k1"), call("LARGEST", 2, *a).alias("k2"),
    )


@query("fn_math", """SELECT c_custkey, abs(c_acctbal) AS a, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS sq, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) END AS lg, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END AS l10,
  trunc(c_acctbal) AS i, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(c_acctbal - 7 * trunc(c_acctbal / 7), 6) AS md, sign(c_acctbal)::DOUBLE AS sg, round(sin(c_acctbal), 6) AS sn, round(atan2(c_acctbal, 3), 8) AS at2, round(tanh(c_acctbal / 10000), 8) AS th,
  factorial(c_nationkey % 15)::DOUBLE AS fa, CASE WHEN abs(c_acctbal / 10000) <= 1 THEN round(asin(c_acctbal / 10000), 8) END AS ar FROM customer""")
def _math(spark, d):
    x = F.col("c_acctbal")
    return t(spark, d, "customer").select(
        "c_custkey", call("ABS", x).alias("a"), F.round(call("SQRT", x), 8).alias("sq"), F.round(call("LOG", x), 8).alias("lg"), F.round(call("LOG10", x), 8).alias("l10"), call("INT", x).alias("i"), call("CEIL", x).alias("c"), call("FLOOR", x).alias("f"),
        F.round(call("MOD", x, F.lit(7)), 6).alias("md"), call("SIGN", x).alias("sg"), F.round(call("SIN", x), 6).alias("sn"), F.round(call("ATAN2", x, F.lit(3.0)), 8).alias("at2"), F.round(call("TANH", x / 10000), 8).alias("th"),
        call("FACT", F.col("c_nationkey") % 15).alias("fa"), F.round(call("ARSIN", x / 10000), 8).alias("ar"),
    )


@query("fn_round", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * floor(abs(c_acctbal) / 25 + 0.5) * 25 + 0.0 AS r, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * ceil(abs(c_acctbal) / 25 - 0.5) * 25 + 0.0 AS z FROM customer WHERE c_acctbal <> 0""")
def _round(spark, d):
    return t(spark, d, "customer").where("c_acctbal <> 0").select("c_custkey", (call("ROUND", "c_acctbal", 25) + 0.0).alias("r"), (call("ROUNDZ", "c_acctbal", 25) + 0.0).alias("z"))


@query("fn_combinatorics", "SELECT DISTINCT n, k, round(factorial(n) / factorial(k) / factorial(n - k))::DOUBLE AS comb, round(factorial(n) / factorial(n - k))::DOUBLE AS perm FROM (SELECT p_size % 12 + 3 AS n, p_size % 3 AS k FROM part)")
def _comb(spark, d):
    p = t(spark, d, "part").select((F.col("p_size") % 12 + 3).alias("n"), (F.col("p_size") % 3).alias("k")).distinct()
    return p.select("n", "k", call("COMB", "n", "k").alias("comb"), F.round(call("PERM", "n", "k")).alias("perm"))


@query("fn_char", """SELECT p_partkey, upper(p_name) AS u, length(rtrim(p_name)) AS n, substr(p_name, 2, 3) AS s, instr(p_name, 'a') AS i, trim(p_name) || trim(p_brand) AS cs, concat_ws('-', trim(p_name), trim(p_brand)) AS cx, replace(p_name, ' ', '') AS co,
  replace(p_name, 'widget', 'thing') AS tw, list_filter(string_split(p_name, ' '), lambda x: x <> '')[1] AS w1, list_filter(string_split(p_name, ' '), lambda x: x <> '')[-1] AS wl, reverse(p_name) AS rv, repeat(p_brand, 2) AS rp,
  len(p_name) - len(replace(p_name, 'l', '')) AS cc, translate(p_name, 'ab', 'xy') AS tr, ascii(p_name) AS rk FROM part""", wide="n i cc")
def _char(spark, d):
    n, b = "p_name", "p_brand"
    return t(spark, d, "part").select(
        "p_partkey", call("UPCASE", n).alias("u"), call("LENGTH", n).alias("n"), call("SUBSTR", n, 2, 3).alias("s"), call("INDEX", n, "a").alias("i"), call("CATS", n, b).alias("cs"), call("CATX", "-", n, b).alias("cx"), call("COMPRESS", n).alias("co"),
        call("TRANWRD", n, "widget", "thing").alias("tw"), call("SCAN", n, 1).alias("w1"), call("SCAN", n, -1).alias("wl"), call("REVERSE", n).alias("rv"), call("REPEAT", b, 2).alias("rp"), call("COUNTC", n, "l").alias("cc"),
        call("TRANSLATE", n, "xy", "ab").alias("tr"), call("RANK", n).alias("rk"),
    )


@query("fn_char_search", """SELECT doc_id, (len(text) - len(replace(text, 'the', ''))) // 3 AS c, instr(substr(text, 5), 'th') + CASE WHEN instr(substr(text, 5), 'th') > 0 THEN 4 ELSE 0 END AS f,
  length(regexp_extract(text, '^[^aeiou]*[aeiou]')) AS fc, length(regexp_extract(text, '^[A-Z]*')) + 1 AS v FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[aeiou]') AND regexp_matches(text, '[^A-Z]')""", wide="fc f v c")
def _search(spark, d):
    x = t(spark, d, "documents").where("text rlike '[aeiou]' and text rlike '[^A-Z]'")
    return x.select("doc_id", call("COUNT", "text", "the").alias("c"), call("FIND", "text", "th", 5).alias("f"), call("FINDC", "text", "aeiou").alias("fc"), call("VERIFY", "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("v"))


@query("fn_char_search_all", """SELECT doc_id, (len(text) - len(replace(text, 'the', ''))) // 3 AS c, instr(substr(text, 5), 'th') + CASE WHEN instr(substr(text, 5), 'th') > 0 THEN 4 ELSE 0 END AS f,
  length(regexp_extract(text, '^[^aeiou]*[aeiou]')) AS fc, CASE WHEN regexp_matches(text, '[^A-Z]') THEN length(regexp_extract(text, '^[A-Z]*')) + 1 ELSE 0 END AS v FROM documents""", wide="fc f v c")
def _search_all(spark, d):
    return t(spark, d, "documents").select("doc_id", call("COUNT", "text", "the").alias("c"), call("FIND", "text", "th", 5).alias("f"), call("FINDC", "text", "aeiou").alias("fc"), call("VERIFY", "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("v"))


@query("fn_date", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS wd, dayofyear(o_orderdate) AS j, (o_orderdate::DATE - DATE '1960-01-01')::INT AS num,
  datediff('month', o_orderdate, DATE '1999-05-20') AS ckm, datediff('year', o_orderdate, DATE '1999-05-20') AS cky, datediff('quarter', o_orderdate, DATE '1999-05-20') AS ckq, date_trunc('month', o_orderdate + INTERVAL 2 MONTH)::DATE AS nxm,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS nxq, (o_orderdate + INTERVAL 1 YEAR)::DATE AS nxs FROM orders""", wide="m j ckm wd d cky y")
def _date(spark, d):
    o, to = "o_orderdate", F.lit("1999-05-20")
    from ..values import date_number

    return t(spark, d, "orders").select(
        "o_orderkey", call("YEAR", o).alias("y"), call("MONTH", o).alias("m"), call("DAY", o).alias("d"), call("WEEKDAY", o).alias("wd"), call("JULDATE", o).alias("j"), date_number(F.col(o)).alias("num"), call("INTCK", "MONTH", o, to).alias("ckm"),
        call("INTCK", "YEAR", o, to).alias("cky"), call("INTCK", "QTR", o, to).cast("long").alias("ckq"), call("INTNX", "MONTH", o, F.lit(2)).alias("nxm"), call("INTNX", "QTR", o, F.lit(0), "E").alias("nxq"), call("INTNX", "YEAR", o, F.lit(1), "S").alias("nxs"),
    )


@query("fn_date_parts", """SELECT event_id, hour(ts) AS h, minute(ts) AS m, floor(second(ts))::INT AS s, ts::DATE AS d, make_date(year(ts), month(ts), 1) AS first FROM events""", wide="m h")
def _parts(spark, d):
    return t(spark, d, "events").select("event_id", call("HOUR", "ts").alias("h"), call("MINUTE", "ts").alias("m"), call("SECOND", "ts").alias("s"), call("DATEPART", "ts").alias("d"), call("MDY", F.month("ts"), F.lit(1), F.year("ts")).alias("first"))


@query("fn_day_count", """SELECT o_orderkey, (DATE '1999-03-31' - o_orderdate::DATE)::INT AS act, round((DATE '1999-03-31' - o_orderdate::DATE) / 365.0, 8) AS yr,
  (1999 - year(o_orderdate)) * 360 + (3 - month(o_orderdate)) * 30 + CASE WHEN least(day(o_orderdate), 30) >= 30 THEN 30 ELSE 31 END - least(day(o_orderdate), 30) AS d30 FROM orders""", wide="d30")
def _count(spark, d):
    to = F.lit("1999-03-31")
    return t(spark, d, "orders").select("o_orderkey", call("DATDIF", "o_orderdate", to).alias("act"), F.round(call("YRDIF", "o_orderdate", to), 8).alias("yr"), call("DATDIF", "o_orderdate", to, "30/360").alias("d30"))


@query("fn_prx", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[aeiou]{3}') THEN length(regexp_extract(text, '^(.*?)[aeiou]{3}', 1, 's')) + 1 ELSE 0 END AS at, regexp_replace(text, '([a-z])and', '\1AND', 'g') AS ch, regexp_extract(text, '(\w+) (\w+)', 2) AS p2 FROM conversations""", wide="at")
def _prx(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", call("PRXMATCH", "/[aeiou]{3}/", "text").alias("at"), call("PRXCHANGE", r"s/([a-z])and/$1AND/", -1, "text").alias("ch"), call("PRXPOSN", X.prxparse(r"/(\w+) (\w+)/"), 2, "text").alias("p2"))


@query("fn_distributions")
def _dist(spark, d):
    z = F.round((F.col("c_acctbal") - 4500) / 3000, 4)
    c = t(spark, d, "customer").select("c_custkey", z.alias("z"))
    return c.select("c_custkey", F.round(call("PROBNORM", "z"), 10).alias("pn"), F.round(call("PROBT", "z", F.lit(7.0)), 10).alias("pt"), F.round(call("CDF", "CHISQ", F.abs("z"), F.lit(3.0)), 10).alias("pc"), F.round(call("QUANTILE", "T", call("PROBT", "z", F.lit(7.0)), F.lit(7.0)) - F.col("z"), 6).alias("back"))


@query("fn_probit")
def _probit(spark, d):
    p = t(spark, d, "part").select("p_partkey", ((F.col("p_size") + 0.5) / 60).alias("p"))
    return p.select("p_partkey", F.round(call("PROBIT", "p"), 10).alias("z"), F.round(call("PROBNORM", call("PROBIT", "p")) - F.col("p"), 10).alias("err"))


@query("fn_random")
def _random(spark, d):
    return t(spark, d, "region").select("r_regionkey", (call("RANUNI", 7) < 1).alias("u"), call("RAND", "POISSON", 3.0, seed=5).between(0, 60).alias("p"), call("RANBIN", 10, 0.3, 5).between(0, 10).alias("b"))


@query("fmt_numeric", """SELECT c_custkey, lpad(format('{:.1f}', round(c_acctbal, 1)), 12, ' ') AS f, lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)), 14, ' ') AS dol,
  CASE WHEN c_acctbal < 0 THEN lpad('(' || format('{:,.2f}', abs(c_acctbal)) || ')', 12, ' ') ELSE lpad(format('{:,.2f}', c_acctbal), 12, ' ') END AS neg, lpad(c_nationkey::VARCHAR, 5, '0') AS z, lpad(to_hex(c_custkey), 8, '0') AS hx, lpad(bin(c_nationkey), 8, '0') AS bn FROM customer""")
def _numeric(spark, d):
    put = formats.put
    x = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", put(x, "12.1").alias("f"), put(x, "DOLLAR14.2").alias("dol"), put(x, "NEGPAREN12.2").alias("neg"), put(F.col("c_nationkey"), "Z5.").alias("z"), put(F.col("c_custkey"), "HEX8.").alias("hx"), put(F.col("c_nationkey"), "BINARY8.").alias("bn"))


@query("fmt_date", """SELECT o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) AS d9, strftime(o_orderdate, '%m/%d/%y') AS mdy, strftime(o_orderdate, '%Y-%m-%d') AS ymd, upper(strftime(o_orderdate, '%b%y')) AS mon, strftime(o_orderdate, '%A') AS dow, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS yq, strftime(o_orderdate, '%Y%j') AS jul FROM orders""")
def _dates(spark, d):
    put, x = formats.put, F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", put(x, "DATE9.").alias("d9"), put(x, "MMDDYY8.").alias("mdy"), put(x, "YYMMDD10.").alias("ymd"), put(x, "MONYY5.").alias("mon"), put(x, "DOWNAME.").alias("dow"), put(x, "YYQ.").alias("yq"), put(x, "JULIAN7.").alias("jul"))


@query("fmt_words", """SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN '.' WHEN 4 THEN 'IV' WHEN 9 THEN 'IX' WHEN 14 THEN 'XIV' END AS r FROM nation WHERE n_nationkey IN (0, 4, 9, 14)""")
def _words(spark, d):
    return t(spark, d, "nation").where("n_nationkey in (0, 4, 9, 14)").select("n_nationkey", formats.put(F.col("n_nationkey"), "ROMAN.").alias("r"))


@query("fmt_words_all", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '.' ELSE ['', 'X', 'XX'][n_nationkey // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n_nationkey % 10 + 1] END AS r FROM nation")
def _words_all(spark, d):
    return t(spark, d, "nation").select("n_nationkey", formats.put(F.col("n_nationkey"), "ROMAN.").alias("r"))


@query("fmt_put_user", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part")
def _user(spark, d):
    c = formats.Catalog()
    c.value("SIZE", [(None, 10, "small", False, True), (10, 30, "medium", False, True)], other="large")
    return t(spark, d, "part").select("p_partkey", call("PUT", "p_size", "SIZE.", c).alias("size"))


@query("fmt_informats", """SELECT o_orderkey, o_orderdate::DATE AS d, round(o_totalprice, 2) AS v, round(o_totalprice, 2) AS c FROM orders""")
def _informats(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", formats.put(F.col("o_orderdate"), "DATE9.").alias("ds"), F.trim(formats.put(F.col("o_totalprice"), "12.2")).alias("vs"), F.trim(formats.put(F.col("o_totalprice"), "DOLLAR16.2")).alias("cs"))
    return o.select("o_orderkey", call("INPUT", "ds", "DATE9.").alias("d"), call("INPUT", "vs", "12.").alias("v"), call("INPUT", "cs", "DOLLAR16.").alias("c"))
