"""Programs in the text language over a small class table."""

import pytest

from lumenstep.program import Program, statements

CLASS = [("Alfred", "M", 14, 69.0, 112.5), ("Alice", "F", 13, 56.5, 84.0), ("Barbara", "F", 13, 65.3, 98.0), ("Carol", "F", 14, 62.8, 102.5), ("Henry", "M", 14, 63.5, 102.5), ("James", "M", 12, 57.3, 83.0), ("Jane", "F", 12, 59.8, None)]


@pytest.fixture
def p(spark):
    out = Program(spark)
    out.session.save("class", spark.createDataFrame(CLASS, "name string, sex string, age int, height double, weight double").coalesce(1))
    return out


def rows(p, name):
    return [tuple(r) for r in p.session.table(name).collect()]


def test_statements():
    assert statements("a='x;y'; * note; b; /* c; */ d;") == ["a='x;y'", "b", "d"]


def test_data_step_expressions(p):
    p.run("data out; set class; where age > 12; bmi = round(weight / height**2 * 703, 0.1); length grp $ 5; if sex = 'F' then grp = 'girls'; else grp = 'boys_'; label bmi = 'Index'; drop height weight; run;")
    got = {r["name"]: r for r in p.session.table("out").collect()}
    assert got["Alfred"]["bmi"] == 16.6 and got["Alice"]["grp"] == "girls" and len(got) == 5
    assert p.session.table("out").schema["bmi"].metadata["label"] == "Index"


def test_by_groups_and_totals(p):
    p.run("proc sort data=class out=s; by sex descending age; run; data t; set s; by sex; if first.sex then n = 0; n + 1; total + weight; if last.sex then output; keep sex n total; run;")
    assert sorted(rows(p, "t")) == [("F", 4.0, 284.5), ("M", 3.0, 582.5)]


def test_merge_and_outputs(p):
    p.run("""data a; input id x; datalines;
1 10
2 20
3 30
;
data b; input id y $; datalines;
2 two
3 three
4 four
;
data both onlya; merge a(in=ina) b(in=inb); by id; if ina and inb then output both; else if ina then output onlya; run;""")
    assert rows(p, "both") == [(2.0, 20.0, "two"), (3.0, 30.0, "three")] and rows(p, "onlya") == [(1.0, 10.0, None)]


def test_loops_arrays_and_select(p):
    p.run("""data w; set class(obs=1); array v{3} v1-v3; do i = 1 to 3; v{i} = i * age; end; s = sum(of v1-v3);
        select (sex); when ('F') k = 1; when ('M', 'X') k = 2; otherwise k = 3; end; keep v1-v3 s k; keep v1 v2 v3; run;
        data e; do i = 1 to 3; x = i ** 2; output; end; run; data f; set e; do j = 1 to i; output; end; run;""")
    assert rows(p, "w")[0][-1] == 2 and 14 * 6 in rows(p, "w")[0]
    assert sorted(r["x"] for r in p.session.table("e").collect()) == [1, 4, 9] and p.session.table("f").count() == 6


def test_sql(p):
    p.run("""proc sql; create table g as select sex, count(*) as n, avg(age) as m from class group by sex having count(*) > 1 order by sex;
        insert into g values ('X', 0, .); update g set n = n + 1 where sex = 'F'; delete from g where sex = 'M';
        select name into :names separated by ',' from class where name contains 'Al'; quit; %let k = &names;""".replace(", .)", ", null)"))
    assert rows(p, "g") == [("F", 5, 13.0), ("X", 0, None)] and p.macros.get("k") == "Alfred,Alice"


def test_procedures(p):
    p.run("""proc means data=class nway noprint; class sex; var age; output out=m mean=avg_age n=cnt; run;
        proc freq data=class; tables sex / out=fr; tables sex*age / chisq; run; proc rank data=class out=r; var height; ranks rh; run;
        proc transpose data=fr out=tr; id sex; var count; run; proc reg data=class; model weight = height; output out=o p=pred r=res; run;
        proc corr data=class; var height weight; run; proc ttest data=class; class sex; var height; run; proc univariate data=class; var age; run;
        proc append base=all data=class; run; proc contents data=class; run; proc print data=class; var name; sum age; run;""")
    got = {r["sex"]: r for r in p.session.table("m").collect()}
    assert got["F"]["avg_age"] == 13 and got["M"]["cnt"] == 3
    assert {(r["sex"], r["COUNT"]) for r in p.session.table("fr").collect()} == {("F", 4), ("M", 3)}
    assert p.session.table("tr").first()["F"] == 4 and p.session.table("o").where("pred is not null").count() >= 6
    assert max(r["rh"] for r in p.session.table("r").collect()) == 7 and p.session.table("all").count() == 7
    assert {"Summary", "OneWayFreqs", "CrossTabFreqs", "Chisq", "PearsonCorr", "TTest", "Moments"} <= set(p.results)


def test_formats_macros_and_matrix(p):
    p.run("""proc format; value ag low-<13 = 'child' 13-19 = 'teen' other = 'adult'; value $sx 'M' = 'male' 'F' = 'female'; run;
        %macro one(v); data f_&v; set class; g = put(&v, %if &v = age %then ag.; %else $sx.;); keep name g; run; %mend; %one(age) %one(sex)""")
    assert dict(rows(p, "f_age"))["James"] == "child" and dict(rows(p, "f_sex"))["Alice"] == "female"
    p.run("proc iml; use class; read all var {age height} into x; m = x[+, ] / nrow(x); create mm from m; append from m; quit;")
    assert rows(p, "mm")[0][0] == pytest.approx(92 / 7)


def test_symput_and_call_execute(p):
    p.run("data _null_; set class end=last; if last then call symput('total', age); run; data z; x = &total; run;")
    assert rows(p, "z") == [(12,)]
    p.run("data _null_; set class(obs=2); call execute('data ' || strip(name) || '; y = 1; run;'); run;")
    assert {"alfred", "alice"} <= set(p.session.libraries["work"].list())


def test_row_loops_are_refused(p):
    with pytest.raises(NotImplementedError):
        p.run("data x; set class; do while (age > 1); age = age - 1; end; run;")


def test_plots(p):
    p.run("""proc sgplot data=class; scatter x=height y=weight / group=sex; vbar sex / response=age stat=mean; histogram height; density height; vbox height / category=sex; reg x=height y=weight; loess x=height y=age; run;
        proc gchart data=class; vbar sex / sumvar=age type=sum; pie sex; run; proc gplot data=class; plot weight*height=sex; run; proc plot data=class; plot weight*height; run;""")
    assert len([k for k in p.results if k.startswith("SGPLOT")]) == 7
    assert {r["sex"]: r["SUM"] for r in p.results["GCHART vbar sex"].collect()} == {"F": 52, "M": 40}
    assert p.results["GPLOT weight*height"].count() == 6 and "A" in p.listing[-1]


def test_more_procedures(p):
    p.run("""data big; set class; do k = 1 to 6; z = (k > 3); c = mod(k * age, 4); h2 = height + k + mod(k * age, 3) / 10; output; end; run;
        proc logistic data=big; model z(event='1') = c h2; output out=lo p=ph; run; proc genmod data=big; model c = h2 / dist=poisson; run;
        proc glm data=big; class sex; model height = sex weight; lsmeans sex; run; proc npar1way data=class wilcoxon; class sex; var height; run;
        proc princomp data=class out=pc; var height age; run; proc fastclus data=class maxclusters=2 out=fc; var height age; run;
        proc discrim data=class out=di; class sex; var height age; run; proc tabulate data=class out=tb; class sex; var age; table sex all, age*mean; run;
        proc report data=class out=rp; column sex age; define sex / group; define age / analysis mean; run;
        proc compare base=class compare=class; id name; run; proc datasets lib=work; change pc=pc2; delete fc; run; proc mixed data=big; class name; model h2 = k; random intercept / subject=name; run;""")
    assert p.session.table("lo").where("ph between 0 and 1").count() == 42 and "Type3" in p.results
    assert "pc2" in p.session.libraries["work"].list() and "fc" not in p.session.libraries["work"].list()
    assert p.session.table("tb").count() == 3 and {r["sex"]: r["age"] for r in p.session.table("rp").collect()}["F"] == 13
    assert p.results["CompareDifferences"].count() == 0 and abs(p.results["Fit"]["beta"][1] - 1) < 0.1


def test_limits_raise(p, spark):
    control = spark.range(100_001).selectExpr("'BIG' AS FMTNAME", "cast(id AS string) AS START", "cast(id AS string) AS END", "'x' AS LABEL", "'N' AS TYPE")
    p.session.save("ctl", control)
    with pytest.raises(ValueError, match="CNTLIN"):
        p.run("proc format cntlin=ctl; run;")
    p.session.into(spark.range(3), ["some"], ",", most=3)
    assert p.session.symbols["SOME"].count(",") == 2
    with pytest.raises(ValueError, match="INTO"):
        p.session.into(spark.range(4), ["some"], ",", most=3)
    p.session.into(spark.range(4), ["first"], most=3)
