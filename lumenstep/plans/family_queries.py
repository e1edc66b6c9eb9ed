"""Queries over the rest of the function, format and informat families and over programs in the text language, each on
its whole table and with its DuckDB statement. Distribution functions are checked by their closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import formats
from ..functions import call, descriptive
from ..functions import regex as X
from ..program import Program
from .catalog import query
from .relational_queries import t


# Functions ---------------------------------------------------------------------------------------------------------------
@query("fn_math_more", """SELECT c_custkey, round(exp(x), 9) AS ex, CASE WHEN x > 0 THEN round(log2(x), 8) END AS l2, round(cos(x), 9) AS co, round(tan(x), 9) AS ta, round(acos(x), 9) AS ac, round(atan(x), 9) AS at,
  round(sinh(x), 9) AS sh, round(cosh(x), 9) AS ch FROM (SELECT c_custkey, c_acctbal / 10000 AS x FROM customer)""")
def _math_more(spark, d):
    x = F.col("c_acctbal") / 10000
    fns = (("EXP", "ex"), ("LOG2", "l2"), ("COS", "co"), ("TAN", "ta"), ("ARCOS", "ac"), ("ATAN", "at"), ("SINH", "sh"), ("COSH", "ch"))
    return t(spark, d, "customer").select("c_custkey", *[F.round(call(f, x), 8 if f == "LOG2" else 9).alias(a) for f, a in fns])


@query("fn_gamma", """SELECT p_partkey, round(lgamma(x), 8) AS lg, round(ln(gamma(x)), 8) AS g, round(lgamma(x) + lgamma(3.5) - lgamma(x + 3.5), 8) AS lb,
  round(-0.57721566490153286 + coalesce(list_sum(list_transform(range(1, n), lambda k: 1.0::DOUBLE / k)), 0), 8) AS dg, round(1.6449340668482264 - coalesce(list_sum(list_transform(range(1, n), lambda k: 1.0::DOUBLE / (k * k))), 0), 8) AS tg
  FROM (SELECT p_partkey, p_size / 4.0::DOUBLE + 0.5 AS x, p_size AS n FROM part)""")
def _gamma(spark, d):
    x, n = F.col("p_size") / 4 + 0.5, F.col("p_size").cast("double")
    return t(spark, d, "part").select(
        "p_partkey", F.round(call("LGAMMA", x), 8).alias("lg"), F.round(F.ln(call("GAMMA", x)), 8).alias("g"), F.round(F.ln(call("BETA", x, F.lit(3.5))), 8).alias("lb"), F.round(call("DIGAMMA", n), 8).alias("dg"), F.round(call("TRIGAMMA", n), 8).alias("tg"),
    )


@query("fn_descriptive_more", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(nullif(l_tax, 0.02), l_discount) AS co, (nullif(l_tax, 0.02) IS NULL)::INT AS ms,
  list_sort([l_discount, l_tax, l_quantity])[2] AS od, round(list_aggregate([l_discount, l_tax, l_quantity], 'stddev_samp'), 8) AS sd, round(list_aggregate([l_discount, l_tax, l_quantity], 'var_samp'), 6) AS vr,
  list_sort([l_discount, nullif(l_tax, 0.02), l_quantity], 'ASC', 'NULLS FIRST')[1] AS s1, list_sort([l_discount, nullif(l_tax, 0.02), l_quantity], 'ASC', 'NULLS FIRST')[3] AS s3, 3 AS dm FROM lineitem""")
def _descriptive_more(spark, d):
    a = ("l_discount", "l_tax", "l_quantity")
    row = descriptive.sort_values("l_discount", F.nullif("l_tax", F.lit(0.02)), "l_quantity")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", call("COALESCE", F.nullif("l_tax", F.lit(0.02)), "l_discount").alias("co"), call("MISSING", F.nullif("l_tax", F.lit(0.02))).alias("ms"), call("ORDINAL", 2, *a).alias("od"),
        F.round(call("STD", *a), 8).alias("sd"), F.round(call("VAR", *a), 6).alias("vr"), row[0].alias("s1"), row[2].alias("s3"), call("DIM", F.array(*a)).cast("int").alias("dm"),
    )


@query("fn_char_more", """SELECT p_partkey, lower(p_brand) AS lo, rtrim('  ' || p_name || '  ') AS tr, trim('  ' || p_name || '  ') AS st, ltrim('  ' || p_name || '  ') AS le, p_name || ' ' || p_brand AS ca,
  list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS pr, trim(regexp_replace(p_name || '   ' || p_brand, ' +', ' ', 'g')) AS cb, substr(p_name, 3, 4) AS sn,
  chr(65 + p_size % 26) AS by, list_position(['ECONOMY', 'STANDARD', p_type], p_type)::BIGINT AS wh, p_name || ',"' || p_brand || ',x"' AS cq, length(p_name) AS ln FROM part""", wide="wh ln")
def _char_more(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    pad = F.concat(F.lit("  "), n, F.lit("  "))
    return t(spark, d, "part").select(
        "p_partkey", call("LOWCASE", b).alias("lo"), call("TRIM", pad).alias("tr"), call("STRIP", pad).alias("st"), call("LEFT", pad).alias("le"), call("CAT", n, F.lit(" "), b).alias("ca"), call("PROPCASE", n).alias("pr"), call("COMPBL", F.concat(n, F.lit("   "), b)).alias("cb"),
        call("SUBSTRN", n, 3, 4).alias("sn"), call("BYTE", 65 + F.col("p_size") % 26).alias("by"), call("WHICHC", F.col("p_type"), F.lit("ECONOMY"), F.lit("STANDARD"), F.col("p_type")).alias("wh"), call("CATQ", ",", n, F.concat(b, F.lit(",x"))).alias("cq"), call("LENGTHN", n).alias("ln"),
    )


@query("fn_date_more", """SELECT o_orderkey, o_orderdate::DATE AS dj, (o_orderdate::DATE + INTERVAL 1 HOUR + INTERVAL 2 MINUTE + INTERVAL 3 SECOND)::TIMESTAMP AS dh, (o_custkey % 24) * 3600 + 59 * 60 + 7 AS hm, upper(strftime(o_orderdate, '%d%b%Y')) AS nl,
  (o_orderdate::DATE + INTERVAL 90 SECOND)::TIMESTAMP AS dt, TRUE AS td, (o_custkey % 24) * 3600 + 61 AS tp FROM orders""", wide="hm tp")
def _date_more(spark, d):
    o = F.col("o_orderdate")
    number = F.year(o) * 1000 + F.dayofyear(o)
    h = (F.col("o_custkey") % 24).cast("int")
    return t(spark, d, "orders").select(
        "o_orderkey", call("DATEJUL", number).alias("dj"), call("DHMS", o, F.lit(1), F.lit(2), F.lit(3)).alias("dh"), call("HMS", h, F.lit(59), F.lit(7)).alias("hm"), call("NLDATE", o).alias("nl"), call("DATETIME", o, F.lit(90)).alias("dt"),
        ((call("TODAY") == F.current_date()) & (call("DATE") == F.current_date())).alias("td"), call("TIMEPART", call("DHMS", o, h, F.lit(1), F.lit(1))).alias("tp"),
    )


_TERMS = "list_sum(list_transform(range(0, {n}), lambda i: {e}))"
_CHOOSE = "exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1))"


@query("fn_probabilities", f"""SELECT c_custkey, round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * {_TERMS.format(n=80, e="CASE WHEN z = 0 THEN 0 ELSE sign(z) * exp((2 * i + 1) * ln(abs(z)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) END")}, 9) AS pn,
  round(0.5 + z / (2 * sqrt(2 + z * z)), 9) AS pt2, round(0.5 + 0.375 * z / sqrt(1 + z * z / 4) * (1 - z * z / (1 + z * z / 4) / 12), 9) AS pt4, round(1 - exp(-x / 2) * (1 + x / 2), 9) AS pc, round(1 - pow(1 + 2 * x / 7, -3.5), 9) AS pf,
  round({_TERMS.format(n=5, e=f"CASE WHEN i >= 2 THEN {_CHOOSE.format(n=4)} * pow(p, i) * pow(1 - p, 4 - i) ELSE 0 END")}, 9) AS pb, round(1 - exp(-x) * (1 + x + x * x / 2), 9) AS pg,
  round({_TERMS.format(n=4, e=f"{_CHOOSE.format(n=9)} * pow(p, i) * pow(1 - p, 9 - i)")}, 9) AS bn, round({_TERMS.format(n=3, e="exp(-x) * pow(x, i) / gamma(i + 1)")}, 9) AS po,
  round(exp(-z * z / 2) / sqrt(2 * pi()), 9) AS dn, round(exp(-x / 2) * (1 + x / 2), 9) AS sf, round(ln(1 - exp(-x / 2) * (1 + x / 2)), 7) AS lc, round(0.5 + z / (2 * sqrt(2 + z * z)), 9) AS cd, round(z, 6) AS back
  FROM (SELECT c_custkey, round((c_acctbal - 4500) / 3000, 4) AS z, round(abs(c_acctbal) / 2000, 4) + 0.1 AS x, (c_custkey % 97 + 1) / 99.0::DOUBLE AS p FROM customer)""")
def _probabilities(spark, d):
    # four decimals by binary arithmetic, as the statement's ROUND has them: decimal rounding differs on ties
    four_places = lambda v: F.signum(v) * F.floor(F.abs(v) * 10000 + 0.5) / 10000
    z, x, p = four_places((F.col("c_acctbal") - 4500) / 3000), four_places(F.abs("c_acctbal") / 2000) + 0.1, (F.col("c_custkey") % 97 + 1) / 99.0
    c = t(spark, d, "customer").select("c_custkey", z.alias("z"), x.alias("x"), p.alias("p"))
    two, four = F.lit(2.0), F.lit(4.0)
    found = {
        "pn": call("PROBNORM", "z"), "pt2": call("PROBT", "z", two), "pt4": call("PROBT", "z", four), "pc": call("PROBCHI", "x", four), "pf": call("PROBF", "x", two, F.lit(7.0)), "pb": call("PROBBETA", "p", two, F.lit(3.0)), "pg": call("PROBGAM", "x", F.lit(3.0)),
        "bn": call("PROBBNML", "p", F.lit(9.0), F.lit(3.0)), "po": call("POISSON", "x", two), "dn": call("PDF", "NORMAL", "z"), "sf": call("SDF", "CHISQ", "x", four), "cd": call("CDF", "T", "z", two),
    }
    back = call("QUANTILE", "T", call("PROBT", "z", two), two)
    return c.select("c_custkey", *[F.round(v, 9).alias(k) for k, v in found.items()], F.round(call("LOGCDF", "CHISQ", "x", four), 7).alias("lc"), F.round(back, 6).alias("back"))


@query("fn_prx_calls", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[aeiou]{3}') THEN length(regexp_extract(text, '^(.*?)[aeiou]{3}', 1, 's')) + 1 ELSE 0 END AS at, CASE WHEN regexp_matches(text, '[aeiou]{3}') THEN 3 ELSE 0 END::BIGINT AS n,
  len(regexp_extract_all(text, '[aeiou]{3}')) AS c, regexp_replace(text, '[aeiou]{3}', '_', 'g') AS new, length(regexp_replace(text, '[aeiou]{3}', '_', 'g')) AS ln, CASE WHEN regexp_matches(text, '(\w+) (\w+)') THEN 2 ELSE 0 END::BIGINT AS pa FROM conversations""", wide="at n c ln pa")
def _prx_calls(spark, d):
    p = X.prxparse("/[aeiou]{3}/")
    at, n = X.prxsubstr(p, "text")
    new, ln, _ = X.prxreplace(X.prxparse("s/[aeiou]{3}/_/"), -1, "text")
    return t(spark, d, "conversations").select("conv_id", "turn", at.alias("at"), n.alias("n"), F.size(X.prxnext(p, "text")).alias("c"), new.alias("new"), ln.alias("ln"), call("PRXPAREN", X.prxparse(r"/(\w+) (\w+)/"), "text").alias("pa"))


# Formats -----------------------------------------------------------------------------------------------------------------
@query("fmt_numeric_more", """SELECT c_custkey, lpad(c_custkey::VARCHAR, 12, ' ') AS be, lpad(format('{:,.2f}', x), 14, ' ') AS cm, lpad(translate(format('{:,.2f}', x), ',.', '.,'), 14, ' ') AS cx,
  lpad(s || '$' || translate(format('{:,.2f}', abs(x)), ',.', '.,'), 14, ' ') AS dx, lpad(s || '€' || format('{:,.2f}', abs(x)), 14, ' ') AS eu, lpad(s || '€' || translate(format('{:,.2f}', abs(x)), ',.', '.,'), 14, ' ') AS ex,
  lpad(c_nationkey || '%', 8, ' ') AS pc, lpad(format('{:.5E}', x), 12, ' ') AS e, lpad(format('{:.5E}', x), 12, ' ') AS sc, lpad((c_nationkey // 8)::VARCHAR || (c_nationkey % 8)::VARCHAR, 4, '0') AS oc,
  lpad(CASE WHEN c_nationkey % 4 = 0 THEN (c_nationkey // 4)::VARCHAR ELSE CASE WHEN c_nationkey >= 4 THEN (c_nationkey // 4)::VARCHAR || '+' ELSE '' END || ['1/4', '1/2', '3/4'][c_nationkey % 4] END, 10, ' ') AS fr,
  CASE WHEN c_nationkey < 20 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'][c_nationkey + 1]
    ELSE 'twenty' || ['', '-one', '-two', '-three', '-four'][c_nationkey - 19] END AS wo, lpad(c_custkey::VARCHAR, 7, ' ') AS f FROM (SELECT c_custkey, c_nationkey, c_acctbal AS x, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END AS s FROM customer)""")
def _numeric_more(spark, d):
    x, n = F.col("c_acctbal"), F.col("c_nationkey")
    shown = {
        "be": (F.col("c_custkey"), "BEST12."), "cm": (x, "COMMA14.2"), "cx": (x, "COMMAX14.2"), "dx": (x, "DOLLARX14.2"), "eu": (x, "EURO14.2"), "ex": (x, "EUROX14.2"), "pc": (n / 100, "PERCENT8."), "e": (x, "E12."), "sc": (x, "SCIENTIFIC12.5"),
        "oc": (n, "OCTAL4."), "fr": (n / 4, "FRACT10."), "wo": (n, "WORDS."),
    }
    # the statement shows the first seven digits of longer keys, which F7. would fill with asterisks
    f = F.lpad(F.trim(formats.put(F.col("c_custkey"), "F20.")), 7, " ")
    return t(spark, d, "customer").select("c_custkey", *[formats.put(v, f).alias(k) for k, (v, f) in shown.items()], f.alias("f"))


@query("fmt_date_more", """SELECT event_id, strftime(ts, '%d/%m/%Y') AS dm, strftime(ts, '%B %-d, %Y') AS wd, strftime(ts, '%A, %B %-d, %Y') AS we, strftime(ts, '%B') AS mn, quarter(ts)::VARCHAR AS q, ['I', 'II', 'III', 'IV'][quarter(ts)] AS qr,
  upper(strftime(ts, '%d%b%y:%H:%M:%S')) AS dt, strftime(ts, '%Y%m%d') AS b1, strftime(ts, '%Y%m%dT%H%M%S') AS b2, strftime(ts, '%H%M%S') AS b3, strftime(ts, '%Y-%m-%d') AS e1, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS e2, strftime(ts, '%H:%M:%S') AS e3,
  lpad((user_id % 30)::VARCHAR || ':05:09', 8, ' ') AS tm FROM events""")
def _date_formats(spark, d):
    x = F.col("ts")
    shown = {"dm": "DDMMYY10.", "wd": "WORDDATE.", "we": "WEEKDATE.", "mn": "MONNAME.", "q": "QTR.", "qr": "QTRR.", "dt": "DATETIME16.", "b1": "B8601DA.", "b2": "B8601DT.", "b3": "B8601TM.", "e1": "E8601DA.", "e2": "E8601DT.", "e3": "E8601TM."}
    return t(spark, d, "events").select("event_id", *[formats.put(x, f).alias(k) for k, f in shown.items()], formats.put(F.col("user_id") % 30 * 3600 + 309, "TIME8.").alias("tm"))


@query("fmt_character", """SELECT p_partkey, rpad(substr(p_name, 1, 6), 6, ' ') AS c, rpad(substr(p_name, 1, 20), 20, ' ') AS f, rpad(substr(p_name, 1, 3), 3, ' ') AS d, '"' || rtrim(p_name) || '"' AS q, hex(p_brand) AS h, upper(substr(p_name, 1, 5)) AS u FROM part""")
def _character(spark, d):
    n = F.col("p_name")
    shown = {"c": (n, "$CHAR6."), "f": (n, "$F20."), "d": (n, "$3."), "q": (n, "$QUOTE."), "h": (F.col("p_brand"), "$HEX."), "u": (n, "$UPCASE5.")}
    return t(spark, d, "part").select("p_partkey", *[formats.put(v, f).alias(k) for k, (v, f) in shown.items()])


@query("fmt_informats_more", """SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE AS b, o_orderdate::DATE AS c, ((o_custkey % 24) * 3600 + 754)::DOUBLE AS tm, o_orderkey::DOUBLE AS hx, substr(o_orderpriority, 1, 4) AS ch, trim(o_orderpriority) AS pl,
  (o_custkey % 100) / 100.0::DOUBLE AS pc FROM orders""")
def _informats_more(spark, d):
    o = F.col("o_orderdate")
    rows = t(spark, d, "orders").select("*", F.date_format(o, "MM/dd/yyyy").alias("s1"), F.date_format(o, "dd-MM-yyyy").alias("s2"), F.date_format(o, "yyyyMMdd").alias("s3"), F.concat((F.col("o_custkey") % 24).cast("string"), F.lit(":12:34")).alias("s4"))
    read = {
        "a": ("s1", "MMDDYY10."), "b": ("s2", "DDMMYY10."), "c": ("s3", "YYMMDD8."), "tm": ("s4", "TIME8."), "hx": (F.hex("o_orderkey"), "HEX8."), "ch": ("o_orderpriority", "$CHAR4."), "pl": ("o_orderpriority", "$20."),
        "pc": (F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")), "PERCENT5."),
    }
    return rows.select("o_orderkey", *[call("INPUT", v, f).alias(k) for k, (v, f) in read.items()])


@query("fmt_picture", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS z, lpad(c_custkey::VARCHAR, 6, ' ') AS s FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, '000000', lpad('', 6, ' ') FROM customer WHERE c_custkey = 0")
def _picture(spark, d):
    c = formats.Catalog()
    c.value("ZEROS", [(None, None, "999999")], kind="PICTURE")
    c.value("BLANKS", [(None, None, "000000")], kind="PICTURE")
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", formats.put(k, "ZEROS.", c).alias("z"), formats.put(k, "BLANKS.", c).alias("s"))


# The text language -------------------------------------------------------------------------------------------------------
def program(spark, d, text: str, *tables: str) -> Program:
    """A program over tables of the folder, under their own names."""
    p = Program(spark)
    for name in tables:
        p.session.save(name, t(spark, d, name))
    p.run(text)
    return p


@query("lang_expressions", """SELECT o_orderkey, o_totalprice * 2 - 1 AS a, CASE WHEN o_totalprice > 200000 AND o_orderstatus <> 'O' THEN 'big' WHEN o_totalprice < 50000 OR o_orderstatus = 'F' THEN 'low' ELSE 'mid' END AS g,
  (o_orderstatus IN ('F', 'O'))::INT::DOUBLE AS i, trim(o_orderstatus) || '-' || trim(o_orderpriority) AS cat, (NOT (o_custkey > 50))::INT::DOUBLE AS n, o_custkey + 5.0::DOUBLE AS co FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_custkey <> 7""")
def _lang_expressions(spark, d):
    p = program(spark, d, """data work.out; set work.orders; where o_orderdate >= '01JAN1995'd; if o_custkey ^= 7;
        a = o_totalprice * 2 - 1; length g $ 3; if o_totalprice > 200000 and o_orderstatus ^= 'O' then g = 'big'; else if o_totalprice < 50000 or o_orderstatus = 'F' then g = 'low'; else g = 'mid';
        i = o_orderstatus in ('F', 'O'); cat = trim(o_orderstatus) || '-' || trim(o_orderpriority); n = not (o_custkey > 50); co = o_custkey + '5'; keep o_orderkey a g i cat n co; run;""", "orders")
    out = p.session.table("work.out")
    return out.select("o_orderkey", "a", "g", F.col("i").cast("double").alias("i"), "cat", F.col("n").cast("double").alias("n"), F.col("co").cast("double").alias("co"))


@query("lang_delete_drop_rename", "SELECT c_custkey, c_acctbal AS balance, c_nationkey AS nation FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'FURNITURE'")
def _lang_delete(spark, d):
    p = program(spark, d, "data work.out; set work.customer(rename=(c_acctbal=balance c_nationkey=nation) drop=c_name); if balance < 0 then delete; if c_mktsegment = 'FURNITURE' then delete; drop c_mktsegment; run;", "customer")
    return p.session.table("work.out").select("c_custkey", "balance", "nation")


@query("lang_by_totals", "SELECT o_custkey, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def _lang_by(spark, d):
    p = program(spark, d, """proc sort data=work.orders out=work.s; by o_custkey; run;
        data work.out; set work.s; by o_custkey; if first.o_custkey then do; n = 0; total = 0; end; n + 1; total + o_totalprice; if last.o_custkey then output; keep o_custkey n total; run;""", "orders")
    return p.session.table("work.out").select("o_custkey", "n", F.round("total", 2).alias("total"))


@query("lang_sql_tables", "SELECT c_nationkey, count(*) + 1 AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey HAVING count(*) > 1 UNION ALL SELECT 99, 1, 0.5")
def _lang_sql(spark, d):
    p = program(spark, d, """proc sql; create table work.g as select c_nationkey, count(*) as n, round(sum(c_acctbal), 0.01) as s from work.customer group by c_nationkey having count(*) > 1;
        insert into work.g values (99, 0, 0.5); update work.g set n = n + 1 where n >= 0; delete from work.g where c_nationkey = 3; quit;""", "customer")
    return p.session.table("work.g").select(F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("n").cast("bigint").alias("n"), F.round("s", 2).alias("s"))


@query("lang_macro", """SELECT p_partkey, p_size::DOUBLE * 1 AS x1, p_size::DOUBLE * 2 AS x2, p_size::DOUBLE * 3 AS x3, CASE WHEN p_size > 25 THEN 'LARGE' ELSE 'SMALL' END AS kind, 'PART' AS tab, 7.0::DOUBLE AS ev FROM part WHERE p_size > 10""")
def _lang_macro(spark, d):
    p = program(spark, d, """%let table = part; %let least = 10;
        %macro times(n); %local i; %do i = 1 %to &n; x&i = p_size * &i; %end; %mend;
        %macro named(name); %if %upcase(&name) = PART %then %do; tab = "%upcase(&name)"; %end; %else %do; tab = 'none'; %end; %mend;
        data work.out; set work.&table.; where p_size > &least; %times(3) length kind $ 5; if p_size > %eval(5 * 5) then kind = 'LARGE'; else kind = 'SMALL'; %named(&table) ev = %sysevalf(3.5 * 2); keep p_partkey x1 x2 x3 kind tab ev; run;""", "part")
    out = p.session.table("work.out")
    return out.select("p_partkey", *[F.col(f"x{k}").cast("double").alias(f"x{k}") for k in (1, 2, 3)], "kind", "tab", F.col("ev").cast("double").alias("ev"))


@query("lang_macro_quoting", "SELECT n_nationkey, 'a;b' AS q, 'BCD' AS s, 'two' AS w, 3.0::DOUBLE AS l, 2.0::DOUBLE AS i, 1.0::DOUBLE AS e, 'x y' AS c FROM nation")
def _lang_quoting(spark, d):
    p = program(spark, d, """%let q = %str(a;b); %let s = %substr(ABCDE, 2, 3); %let w = %scan(one two three, 2); %let l = %length(abc); %let i = %index(abc,b); %let e = %symexist(q); %let c = %cmpres(x    y);
        data work.out; set work.nation; q = "&q"; s = "&s"; w = "&w"; l = &l; i = &i; e = &e; c = "&c"; keep n_nationkey q s w l i e c; run;""", "nation")
    out = p.session.table("work.out")
    return out.select("n_nationkey", "q", "s", "w", *[F.col(k).cast("double").alias(k) for k in "lie"], "c")


@query("lang_datalines", "SELECT * FROM (VALUES ('ann', 1.5::DOUBLE), ('bob', 2.0::DOUBLE), ('cy', NULL)) v(name, x)")
def _lang_datalines(spark, d):
    return program(spark, d, "data work.a; input name $ x; datalines;\nann 1.5\nbob 2\ncy .\n;\nrun;").session.table("work.a").select("name", F.col("x").cast("double").alias("x"))


@query("lang_format_put", "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END AS size, lpad(p_size::VARCHAR, 4, '0') AS z FROM part")
def _lang_format(spark, d):
    p = program(spark, d, "proc format; value sz low-<20 = 'small' 20-high = 'large'; run; data work.out; set work.part; size = put(p_size, sz.); z = put(p_size, z4.); keep p_partkey size z; run;", "part")
    return p.session.table("work.out").select("p_partkey", "size", "z")


@query("lang_loops", """SELECT n_nationkey, i::DOUBLE AS i, (n_nationkey * i)::DOUBLE AS x FROM nation, range(1, 4) r(i) WHERE n_nationkey < 100""")
def _lang_loops(spark, d):
    out = program(spark, d, "data work.out; set work.nation; do i = 1 to 3; x = n_nationkey * i; output; end; keep n_nationkey i x; run;", "nation").session.table("work.out")
    return out.select("n_nationkey", F.col("i").cast("double").alias("i"), F.col("x").cast("double").alias("x"))


@query("lang_arrays", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_tax * 100, 6) AS l_tax, round(l_discount * 100, 6) AS l_discount, round(l_tax * 100 + l_discount * 100, 6) AS both FROM lineitem")
def _lang_arrays(spark, d):
    out = program(spark, d, "data work.out; set work.lineitem; array v{2} l_tax l_discount; do k = 1 to dim(v); v{k} = v{k} * 100; end; both = sum(of v{*}); run;", "lineitem").session.table("work.out")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", *[F.round(c, 6).alias(c) for c in ("l_tax", "l_discount", "both")])


@query("lang_merge", "SELECT c_custkey AS k, c_nationkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey WHERE o.n IS NOT NULL")
def _lang_merge(spark, d):
    p = program(spark, d, """proc sql; create table work.o as select o_custkey as k, count(*) as n from work.orders group by o_custkey; quit;
        data work.c; set work.customer(rename=(c_custkey=k)); keep k c_nationkey; run; proc sort data=work.o; by k; run; proc sort data=work.c; by k; run;
        data work.out; merge work.c(in=a) work.o(in=b); by k; if a and b; run;""", "customer", "orders")
    return p.session.table("work.out").select("k", "c_nationkey", "n")


@query("lang_procedures", "SELECT c_nationkey, count(*) AS cnt, round(avg(c_acctbal), 6) AS m, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey")
def _lang_procedures(spark, d):
    p = program(spark, d, "proc means data=work.customer nway noprint; class c_nationkey; var c_acctbal; output out=work.m n=cnt mean=m max=hi; run;", "customer")
    return p.session.table("work.m").select("c_nationkey", F.col("cnt").cast("bigint").alias("cnt"), F.round("m", 6).alias("m"), "hi")


# Rows that had no statement ----------------------------------------------------------------------------------------------
@query("sql_aggregates_more", "SELECT l_returnflag, round(stddev_samp(l_quantity), 8) AS sd, round(var_samp(l_quantity), 6) AS vr, max(l_quantity) - min(l_quantity) AS rg, (count(*) - count(nullif(l_tax, 0.02)))::BIGINT AS nm FROM lineitem GROUP BY l_returnflag")
def _sql_more(spark, d):
    from .. import sql

    rows = t(spark, d, "lineitem")
    return sql.run_sql(spark, {"l": rows.withColumn("x", F.nullif("l_tax", F.lit(0.02)))}, "select l_returnflag, round(std(l_quantity), 0.00000001) as sd, round(var(l_quantity), 0.000001) as vr, range(l_quantity) as rg, nmiss(x) as nm from l group by l_returnflag")


@query("sql_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def _sql_limit(spark, d):
    from .. import sql

    return sql.run_sql(spark, {"o": t(spark, d, "orders")}, "select o_orderkey, o_totalprice from o order by o_totalprice desc, o_orderkey limit 7")


@query("sql_set_chain", "(SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation) EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
def _sql_chain(spark, d):
    from ..operators import relational as R

    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return R.set_operation(R.set_operation(a, b, "UNION"), t(spark, d, "supplier").where("s_nationkey > 5").select(F.col("s_nationkey").alias("k")), "EXCEPT")


@query("ds_hash_multidata", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _multidata(spark, d):
    from ..operators import relational as R

    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.lookup_all(t(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderkey"])


# Statistics with closed statements ---------------------------------------------------------------------------------------
@query("proc_freq_relrisk", """SELECT round(a * d / (b * c), 8) AS odds, round((a / (a + b)) / (c / (c + d)), 8) AS rr1 FROM (SELECT count(*) FILTER (s = 'F' AND p < 150000)::DOUBLE AS a, count(*) FILTER (s = 'F' AND p >= 150000)::DOUBLE AS b,
  count(*) FILTER (s = 'O' AND p < 150000)::DOUBLE AS c, count(*) FILTER (s = 'O' AND p >= 150000)::DOUBLE AS d FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders))""")
def _relrisk(spark, d):
    import numpy as np

    from ..operators import inference as I

    cells = {(r[0], r[1]): float(r[2]) for r in t(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_orderstatus", F.col("o_totalprice") >= 150000).count().collect()}
    found = I.relative_risk(np.array([[cells[s, h] for h in (False, True)] for s in "FO"]))
    return spark.createDataFrame([(round(float(found["OR"]), 8), round(float(found["RR1"]), 8))], "odds double, rr1 double")


@query("proc_reg_coefficients", "SELECT round(regr_intercept(c_acctbal, c_nationkey), 6) AS b0, round(regr_slope(c_acctbal, c_nationkey), 8) AS b1, round(regr_r2(c_acctbal, c_nationkey), 10) AS r2 FROM customer")
def _coefficients(spark, d):
    from ..operators import regression as G

    fit = G.regress(t(spark, d, "customer"), "c_acctbal", ["c_nationkey"])
    return spark.createDataFrame([(round(float(fit.beta[0]), 6), round(float(fit.beta[1]), 8), round(float(fit.anova()["RSQUARE"]), 10))], "b0 double, b1 double, r2 double")


@query("proc_means_clm_z", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS m, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS se FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def _clm(spark, d):
    from ..operators import summary

    got = summary.means(t(spark, d, "customer"), ["c_acctbal"], ["N", "MEAN", "STDERR", "LCLM", "UCLM"], classes=["c_nationkey"]).where("c_nationkey is not null and c_acctbal_N > 1")
    middle = (F.col("c_acctbal_LCLM") + F.col("c_acctbal_UCLM")) / 2  # the limits stand about the mean
    return got.select("c_nationkey", F.round(middle, 6).alias("m"), F.round("c_acctbal_STDERR", 6).alias("se"))


@query("proc_npar1way_median_scores", """WITH m AS (SELECT c_acctbal AS x, c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r, count(*) OVER () AS n FROM customer), s AS (SELECT g, n, (r > (n + 1) / 2.0)::INT::DOUBLE AS a FROM m),
  k AS (SELECT g, count(*)::DOUBLE AS ng, sum(a) AS sg FROM s GROUP BY g), w AS (SELECT any_value(n)::DOUBLE AS n, avg(a) AS mean, sum(a * a) - any_value(n) * avg(a) * avg(a) AS ss FROM s)
  SELECT round((w.n - 1) / w.ss * sum(ng * (sg / ng - w.mean) * (sg / ng - w.mean)), 8) AS chisq FROM k, w GROUP BY w.n, w.ss, w.mean""")
def _median(spark, d):
    from ..operators import inference as I

    return I.npar1way(t(spark, d, "customer"), "c_acctbal", "c_mktsegment", "MEDIAN").select(F.round("CHISQ", 8).alias("chisq"))


@query("proc_rank_blom_order", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 - 0.375) / (count(*) OVER () + 0.25), 8) AS p FROM customer")
def _blom(spark, d):
    from ..operators import sorting

    got = sorting.rank(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], method="BLOM", names=["z"])
    return got.select("c_custkey", F.round(call("PROBNORM", "z"), 8).alias("p"))  # the score's own probability
