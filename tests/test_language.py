"""Macros, matrix programs, formats, sources, sessions and listings."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenstep import formats, output, sources, values
from lumenstep.functions import call
from lumenstep.functions import regex as X
from lumenstep.macro import MacroError, Macros
from lumenstep.operators import datastep as D
from lumenstep.operators import relational as R
from lumenstep.operators.matrix import Matrix
from lumenstep.session import Library, Session
from lumenstep.sql import rewrite


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_macro_variables_and_functions():
    m = Macros()
    assert m.expand("%let a=3;%let b=x&a;&b. &&b %eval(&a+4*2) %sysevalf(7/2) %upcase(abc)").split() == ["x3", "x3", "11", "3.5", "ABC"]
    assert m.expand("%scan(a b c,2)%substr(hello,2,3)%str(a;b)%index(abc,c)%nrstr(&a)") == "bella;b3&a"
    assert m.expand("%sysfunc(mdy(1,2,2020),date9.) %eval(2**3) %eval(abc=abc) %eval(7/2)").split() == ["02JAN2020", "8", "1", "3"]
    with pytest.raises(MacroError):
        m.expand("%eval(1/0)")


def test_macro_control():
    m = Macros()
    out = m.expand("%macro t(n,pre=v);%do i=1 %to &n;&pre&i %end;%if &n>2 %then %do;big %end;%else small ;%mend;%t(3)%t(1,pre=w)")
    assert out.split() == ["v1", "v2", "v3", "big", "w1", "small"]
    assert m.expand("%macro w;%let k=0;%do %while(&k<3);%let k=%eval(&k+1);k&k %end;%mend;%w").split() == ["k1", "k2", "k3"]
    assert m.expand("%macro g(x);%if &x=1 %then %goto done;no %done:yes %mend;%g(1)%g(2)").split() == ["yes", "no", "yes"]


def test_matrix_program(spark):
    t = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    m = Matrix(spark, {"t": t}).run("use t; read all into x; y = x` * x; z = y[1, ]; s = sum(x # x); call eigen(v, w, {2 1, 1 2}); do i = 1 to 3; if i > 2 then q = i; end; create o from y; append from y; close o; print s;")
    assert m.vars["S"][0, 0] == 30 and m.vars["Q"][0, 0] == 3 and m.vars["V"].ravel().round(9).tolist() == [3, 1]
    assert sorted(tuple(r) for r in m.tables["o"].collect()) == [(10.0, 14.0), (14.0, 20.0)] and m.vars["Z"].tolist() == [[10.0, 14.0]]


@pytest.mark.parametrize(
    ("x", "fmt", "want"),
    [(1234.5, "COMMA10.2", "  1,234.50"), (-1234.5, "DOLLAR12.2", "  -$1,234.50"), (0.256, "PERCENT8.1", "   25.6%"), (7.0, "Z4.", "0007"), (1999.0, "ROMAN10.", "    MCMXCIX"[1:]), (42.0, "WORDS.", "forty-two"), (0.75, "FRACT8.", "     3/4"), (255.0, "HEX4.", "00FF"), (1234.5, "COMMAX10.2", "  1.234,50"), (3725.0, "TIME8.", " 1:02:05"), (None, "8.2", "       ."), (12.0, "BEST8.", "      12"), (2.5, "BEST8.", "     2.5"), (1234567.891, "EURO14.2", " €1,234,567.89")],
)
def test_numeric_formats(spark, x, fmt, want):
    assert one(spark, formats.put(F.lit(x).cast("double"), fmt)) == want


def test_user_formats(spark, tmp_path):
    c = formats.Catalog()
    c.value("AGE", [(None, 13, "child", False, True), (13, 20, "teen", False, True), (65, None, "senior")], other="adult", missing="none")
    c.value("$SEX", [("M", "male"), ("F", "female")])
    c.value("GRADE", [("A", 4), ("B", 3)], kind="INVALUE", other=0)
    c.value("PHONE", [(None, None, "999-9999")], kind="PICTURE")
    for x, want in ((5, "child"), (13, "teen"), (70, "senior"), (30, "adult"), (None, "none")):
        assert one(spark, call("PUT", F.lit(x).cast("double"), "AGE.", c)) == want
    assert one(spark, call("PUT", F.lit("M "), "$SEX.", c)) == "male" and one(spark, call("INPUT", F.lit("B"), "GRADE.", c)) == 3
    assert one(spark, call("PUT", F.lit(5551234.0), "PHONE.", c)) == "555-1234"
    c.save(str(tmp_path / "f.json"))
    d = formats.Catalog()
    d.load(str(tmp_path / "f.json"))
    assert one(spark, call("PUT", F.lit(14.0), "AGE.", d)) == "teen" and len(d.contents()) == 4


def test_informats(spark):
    assert str(one(spark, call("INPUT", F.lit("02jan2020"), "DATE9."))) == "2020-01-02"
    assert one(spark, call("INPUT", F.lit("$1,234.5"), "DOLLAR10.")) == 1234.5 and one(spark, call("INPUT", F.lit("(12)"), "COMMA6.")) == -12
    assert one(spark, call("INPUT", F.lit("12345"), "6.2")) == 123.45 and one(spark, call("INPUT", F.lit("abc"), "6.")) is None
    assert one(spark, call("INPUT", F.lit("1:02:03"), "TIME8.")) == 3723 and str(one(spark, call("INPUT", F.lit("12/31/99"), "MMDDYY8.")))[5:] == "12-31"


def test_values(spark):
    null = F.lit(None).cast("double")
    assert one(spark, values.lt(null, F.lit(-1e9))) and one(spark, values.eq(null, null)) and not one(spark, values.truth(null))
    assert one(spark, values.eq(F.lit("a "), F.lit("a"), char=True)) and one(spark, values.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, values.power(F.lit(-8.0), F.lit(1 / 3))) is None and one(spark, values.date_number(F.lit("1960-01-11").cast("date"))) == 10


def test_character_edges(spark):
    assert one(spark, call("SOUNDEX", F.lit("Pfister"))) == "P123" and one(spark, call("SOUNDEX", F.lit(""))) == "0000"
    assert one(spark, call("SCAN", F.lit("a,b c"), -1)) == "c" and one(spark, call("SCAN", F.lit("a"), 3)) == ""
    assert one(spark, call("SUBSTR", F.lit("abc"), 9)) == "" and one(spark, call("CATX", "-", F.lit(" a "), F.lit(None).cast("string"), F.lit("b"))) == "a-b"
    assert one(spark, call("PROPCASE", F.lit("o'neil-smith"), " -'")) == "O'Neil-Smith" and one(spark, call("CATQ", ",", F.lit('a"b'), F.lit("c"))) == '"a""b",c'
    assert one(spark, call("PRXCHANGE", "s/a/b/", 2, F.lit("aaa"))) == "bba" and one(spark, X.prxparen("/(a)|(b)/", F.lit("xb"))) == 2


def test_maths_edges(spark):
    assert one(spark, call("ROUND", F.lit(-2.5))) == -3 and one(spark, call("ROUNDZ", F.lit(2.5))) == 2 and one(spark, call("LOG", F.lit(-1.0))) is None
    assert one(spark, call("GAMMA", F.lit(5.0))) == 24 and math.isclose(one(spark, call("DIGAMMA", F.lit(1.0))), -0.5772156649015329, rel_tol=1e-12)
    assert one(spark, call("COMB", F.lit(3), F.lit(5))) == 0 and one(spark, call("FACT", F.lit(20))) == 2432902008176640000


def test_merge_update_and_flags(spark):
    a = spark.createDataFrame([(1, "a1"), (1, "a2"), (2, "a3"), (None, "a4")], "k int, x string")
    b = spark.createDataFrame([(1, "b1"), (3, "b2"), (None, "b3")], "k int, y string")
    got = sorted(map(repr, map(tuple, D.match_merge([a, b], ["k"], [["x"], ["y"]], ["ina", "inb"]).collect())))
    assert got == sorted(map(repr, [(1, "a1", "b1", 1, 1), (1, "a2", "b1", 1, 1), (2, "a3", None, 1, 0), (3, None, "b2", 0, 1), (None, "a4", "b3", 1, 1)]))
    up = D.update(a.where("x <> 'a2'"), spark.createDataFrame([(1, None), (2, "new"), (9, "no")], "k int, x string"), ["k"])
    assert sorted(r["x"] for r in up.collect()) == ["a1", "a4", "new"]
    assert R.delete_where(a, F.col("k") > 1).count() == 3


def test_sources(spark, tmp_path):
    lines = sources.datalines(spark, "Ann 12 01JAN2020\nBob . 02FEB2021\nCy 7 03MAR2022")
    got = sources.read_records(lines, "name $ age d : date9.").orderBy("_line").collect()
    assert [(r["name"], r["age"], str(r["d"])) for r in got] == [("Ann", 12.0, "2020-01-01"), ("Bob", None, "2021-02-02"), ("Cy", 7.0, "2022-03-03")]
    column = sources.read_records(sources.datalines(spark, "AnnX 12\nBob   7"), "name $ 1-4 age 5-7").collect()
    assert sorted((r["name"].strip(), r["age"]) for r in column) == [("AnnX", 12.0), ("Bob", 7.0)]
    assert [r["x"] for r in sources.held_records(sources.datalines(spark, "1 2 3"), "x").orderBy("_at").collect()] == [1.0, 2.0, 3.0]
    dsd = sources.read_records(sources.datalines(spark, 'a,"b,c",3'), "p $ q $ n", dsd=True).first()
    assert (dsd["p"], dsd["q"], dsd["n"]) == ("a", "b,c", 3.0)
    sources.export_file(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "o"), single=True)
    assert tuple(sources.import_file(spark, str(tmp_path / "o")).first()) == (1, "x")


def test_session(spark, tmp_path):
    s = Session(spark)
    s.libname("d", str(tmp_path / "lib"))
    s.save("d.one", spark.createDataFrame([(1, "x")], "a int, b string"))
    s.save("two", spark.range(3).toDF("n"))
    assert s.table().count() == 3 and s.table("d.one").count() == 1 and s.libraries["d"].list() == ["one"]
    assert {(r["memname"], r["nobs"]) for r in s.table("dictionary.tables").collect()} == {("ONE", 1), ("TWO", 3)}
    assert [r["name"] for r in s.table("sashelp.vcolumn").orderBy("memname", "varnum").collect()] == ["a", "b", "n"]
    s.libraries["d"].rename("one", "uno")
    s.symput(s.table("two"), "last", "n")
    assert s.libraries["d"].list() == ["uno"] and s.symbols["LAST"] == "2"
    with pytest.raises(PermissionError):
        Library(spark, "s3://bucket/x").delete("t")


def test_dialect():
    assert rewrite("select * from t where a contains 'x.y' and b is not missing").count("'x.y'") == 2
    assert "pow(a, 2)" in rewrite("select a**2 as b from t") and "is null" in rewrite("select * from t where a = .")
    assert "(a + 1)" in rewrite("select a + 1 as b, calculated b * 2 as c from t")


def test_listings(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 1), ("b", None, 2)], "g string, x double, n int")
    shown = output.text(df, "Title")
    assert "Title" in shown and "1.5" in shown and " . " in shown
    total = output.print_report(df, ["x", "n"], ["n"], ["g"]).collect()
    assert [(r["g"], r["n"], r["_SUM_"]) for r in total if r["_SUM_"]] == [("a", 1, "subtotal"), ("b", 2, "subtotal"), (None, 3, "total")]
    for kind in ("html", "rtf", "pdf", "excel"):
        getattr(output, f"to_{kind}")(df, str(tmp_path / f"o.{kind}"))
    assert b"%PDF" in (tmp_path / "o.pdf").read_bytes() and "<v>1.5</v>" in zipfile.ZipFile(tmp_path / "o.excel").read("xl/worksheets/sheet1.xml").decode()
