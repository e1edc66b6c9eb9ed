"""Small inputs for faults that were once found, against plain recomputation."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep import formats
from lumenstep.operators import datastep, inference, multivariate, relational, running, summary
from lumenstep.stats import dists


def test_range_lookup_keeps_rows_without_a_range(spark):
    ranges = spark.createDataFrame([(0.0, 1.0, "a"), (1.0, 2.0, "b"), (10.0, 20.0, "c")], "low double, high double, label string")
    df = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (99.0,), (15.0,), (None,)], "x double")
    want = {0.5: "a", 1.0: "b", 5.0: None, 99.0: None, 15.0: "c", None: None}
    for most in (1 << 30, 0):
        assert {r["x"]: r["label"] for r in relational.range_lookup(df, "x", ranges, "label", most_bytes=most).collect()} == want


def test_lookup_takes_the_first_row(spark):
    table = spark.createDataFrame([(1, "z", 3), (1, "a", 1), (1, "m", 2), (2, "q", 9)], "k long, v string, t long").coalesce(1)
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert {r["k"]: r["v"] for r in relational.lookup(df, table, ["k"], ["v"]).collect()} == {1: "z", 2: "q", 3: None}
    assert {r["k"]: r["v"] for r in relational.lookup(df, table, ["k"], ["v"], order=["t"]).collect()} == {1: "a", 2: "q", 3: None}


@pytest.mark.parametrize("order", [["a", "k"], ["-a", "-k"], ["a", "-k"], ["c", "k"]])
def test_running_operators_without_groups(spark, order):
    rng = random.Random(5)
    data = [(k, rng.choice([None, 1.0, 2.0, 3.5]), "same", rng.choice([None, k, -k])) for k in range(500)]
    df = spark.createDataFrame(data, "k long, a double, c string, v long").repartition(5)
    at = {"k": 0, "a": 1, "c": 2}
    rows = sorted(data, key=lambda r: r[0])
    for key in reversed(order):
        i, down = at[key.lstrip("-")], key.startswith("-")
        rows.sort(key=lambda r, i=i: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=down)
    total, last, want = 0, None, {}
    for n, r in enumerate(rows):
        total += r[3] or 0
        last = r[3] if r[3] is not None else last
        want[r[0]] = (total, last, rows[n - 1][3] if n else None, rows[n - 3][3] if n >= 3 else None, n + 1)
    got = running.cumulate(df, F.coalesce("v", F.lit(0)), order, "s")
    got = running.carried(got, F.col("v"), order, "last")
    got = running.lagged(running.lagged(got, F.col("v"), order, "l1"), F.col("v"), order, "l3", 3)
    got = datastep.row_numbers(got, order)
    assert {r["k"]: (r["s"], r["last"], r["l1"], r["l3"], r["_n_"]) for r in got.collect()} == want


def test_a_tied_first_column_is_dealt_over_the_next(spark):
    df = spark.range(4000).select(F.lit(7).alias("tie"), F.col("id").alias("k"))
    assert running.dealt(df, ["tie", "k"]).select("__cum_b").distinct().count() > 20


def test_words_of_large_numbers(spark):
    numbers = [0, 15, -21, 1_000, 2_000_000_005, 7_000_000_000_000, 9_000_000_000_000_120]
    df = spark.createDataFrame([(float(n),) for n in numbers], "x double")
    assert [r[0] for r in df.select(formats.put(F.col("x"), "WORDS200.")).collect()] == [
        "zero", "fifteen", "minus twenty-one", "one thousand", "two billion five", "seven trillion", "nine quadrillion one hundred twenty",
    ]
    with pytest.warns(UserWarning):
        formats.put(F.col("x"), "NOSUCH8.")


def test_fisher_of_large_and_many_tables():
    tea = inference.fisher(np.array([[3, 1], [1, 3]]))
    assert abs(tea["TWO"] - 34 / 70) < 1e-12 and abs(tea["RIGHT"] - 17 / 70) < 1e-12
    big = inference.fisher(np.array([[1_000_000, 1_001_000], [1_000_500, 1_000_500]]))
    assert 0.60 < big["TWO"] < 0.63
    table = np.array([[3, 1, 2], [0, 4, 3], [2, 2, 1]])
    exact, drawn = inference.fisher(table), inference.fisher(table, most_tables=10)
    assert exact["DRAWS"] == 0 and drawn["DRAWS"] == 10_000 and abs(exact["TWO"] - drawn["TWO"]) < 0.03


def test_prefix_comparison(spark):
    from lumenstep.program import Program

    p = Program(spark)
    p.run("data work.a; input name $ n; datalines;\nANNA 1\nAndrew 2\nAn 3\nBob 4\n;\nrun; data work.b; set work.a; where name =: 'An'; run;")
    assert sorted(r["name"] for r in p.session.table("work.b").collect()) == ["An", "Andrew"]


def test_incomplete_beta_at_the_border():
    from lumenstep.stats import dists

    for a in (0.5, 1.0, 2.5, 8.0):
        for b in (0.5, 1.0, 2.5, 8.0):
            edge = (a + 1) / (a + b + 2)
            for x in (edge, np.nextafter(edge, 0), np.nextafter(edge, 1), 1 - edge):
                assert abs(dists.beta_i(a, b, float(x)) + dists.beta_i(b, a, 1 - float(x)) - 1) < 1e-12
    assert all(abs(dists.beta_i(0.5, 0.5, k / 1000) - 2 / np.pi * np.arcsin(np.sqrt(k / 1000))) < 1e-12 for k in range(1, 1000))


def test_clustering_along_a_line_takes_any_number_of_rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=40), 2)
    flat = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)], "i int, v double, w double")
    for method in ("WARD", "SINGLE", "COMPLETE", "AVERAGE"):  # the second variable, a constant, goes through the matrix
        got, want = multivariate.cluster(flat, ["v"], "i", method), multivariate.cluster(flat, ["v", "w"], "i", method)
        assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)
        assert sorted(r[4] for r in got) == sorted(r[4] for r in want)
    many = spark.range(3500).select("id", (F.col("id") * F.col("id") % 7919).cast("double").alias("v"))
    tree = multivariate.cluster(many, ["v"], "id", "WARD")
    assert len(tree) == 3499 and tree[-1][4] == 3500


def test_normality_far_from_normal(spark):
    # A2 of these is over 300, where the last parabola of its p-value curve overflowed; that of W2 had risen to 1
    n = 20_000
    row = inference.normality(spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("x")), "x").first()
    assert row["A2"] > 310 and row["W2"] > 3 and row["P_A2"] == 0 and row["P_W2"] == 0
    # ties and plain recomputation
    x = np.sort(np.round(np.random.default_rng(2).normal(size=300), 1))
    f = np.array([dists.norm_cdf(v) for v in (x - x.mean()) / x.std(ddof=1)])
    got = inference.normality(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    i = np.arange(1, 301)
    assert abs(got["W2"] - (1 / 3600 + ((f - (2 * i - 1) / 600) ** 2).sum())) < 1e-10
    assert abs(got["A2"] - (-300 - ((2 * i - 1) * np.log(f) + (601 - 2 * i) * np.log(1 - f)).sum() / 300)) < 1e-8


def test_end_flag_as_the_first_query_of_a_session():
    # the optimizer put the order column on the wrong side of the hand-over, in a session's first runs
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '12').getOrCreate(); r = e.queries()['ds_end_nobs'](s, '/root/testdata/sf0.001').collect(); print(sum(x['eof'] for x in r), {x['nobs'] for x in r})"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[0] == "1 {25}", done.stderr[-2000:]


def test_first_and_last_over_ranges(spark):
    rng = random.Random(9)
    data = [(k, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), rng.randrange(40)) for k in range(600)] + [(600 + k, "a", 1, k) for k in range(200)]
    df = spark.createDataFrame(data, "k long, g string, h int, o long").repartition(4)
    for by in (["g", "h"], ["-g", "h"], ["g", "-h"], ["-g", "-h"]):
        rows = sorted(data, key=lambda r: (r[3], r[0]))
        for at, b in ((2, by[1]), (1, by[0])):
            rows.sort(key=lambda r, at=at: (r[at] is not None, r[at] if r[at] is not None else ("" if at == 1 else 0)), reverse=b.startswith("-"))
        ends = lambda i, j, upto: int(not 0 <= j < len(rows) or rows[i][1 : 1 + upto] != rows[j][1 : 1 + upto])
        want = {r[0]: (ends(i, i - 1, 1), ends(i, i + 1, 1), ends(i, i - 1, 2), ends(i, i + 1, 2)) for i, r in enumerate(rows)}
        out = datastep.first_last(df, by, ["o", "k"])
        assert {r["k"]: (r["first_g"], r["last_g"], r["first_h"], r["last_h"]) for r in out.collect()} == want
    # no window over a whole BY group is left
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__cum_b" in line for line in plan.splitlines() if "Window [" in line)


def test_numeric_formats_round_the_value_itself(spark):
    x = spark.createDataFrame([(-0.04, 9172.755, 0.25)], "a double, b double, c double")
    put = lambda c, f: formats.put(F.col(c), f)
    # 9172.755 is a little under its shortest decimal text
    row = x.select(put("a", "6.1"), put("c", "6.1"), put("b", "COMMA9.2"), put("b", "DOLLAR10.2"), put("b", "E12."), put("b", "SCIENTIFIC12.5")).first()
    assert [v.strip() for v in row] == ["-0.0", "0.3", "9,172.75", "$9,172.75", "9.17275E+03", "9.17275E+03"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_spread_join_of_heavy_keys(spark, how, monkeypatch):
    monkeypatch.setattr(relational, "HEAVY_ROWS", 4)
    a = spark.createDataFrame([(None if k % 3 == 0 else k % 3, k % 20) for k in range(60)] + [(7, 1), (8, 2)], "k int, x int")
    b = spark.createDataFrame([(None if k % 2 == 0 else 1, k) for k in range(20)] + [(1, 5), (1, 5), (7, 3), (9, 4)] + [(2, 0)], "k int, y int")
    got = relational.spread_join(a, b, ["k"], how)
    want = relational.key_join(a, b, ["k"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_distances_in_cells(spark, monkeypatch):
    monkeypatch.setattr(multivariate, "CELL_ROWS", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x[7] = x[3] + 1e-9
    df = spark.createDataFrame([(f"v{i}", [float(v) for v in r]) for i, r in enumerate(x)] + [("gone", [1.0, None, 0.0, 0.0, 0.0])], "id string, e array<double>")
    got = {(r["ID1"], r["ID2"]): r["DISTANCE"] for r in multivariate.distance(df, "id", "e", most_rows=None).collect()}
    assert len(got) == 61 * 60 // 2 and all(a < b for a, b in got)
    for (a, b), d in got.items():
        assert d is None if "gone" in (a, b) else abs(d - np.sqrt(((x[int(a[1:])] - x[int(b[1:])]) ** 2).sum())) <= 1e-12


def test_distribution_functions_over_arrays():
    rng = np.random.default_rng(8)
    a, b, x, p, z = rng.uniform(0.1, 50, 400), rng.uniform(0.1, 50, 400), rng.uniform(-0.1, 1.1, 400), rng.uniform(0.001, 0.999, 400), rng.normal(size=400) * 4
    for name, value, *q in (("T", z, a), ("F", z, a, b), ("CHISQ", 20 * x, a), ("BETA", x, a, b), ("GAMMA", 20 * x, a, b), ("NORMAL", z), ("POISSON", np.floor(20 * x), a)):
        want = [dists.cdf(name, *row) for row in zip(value.tolist(), *[v.tolist() for v in q], strict=True)]
        assert np.allclose(dists.cdf_many(name, value, *q), want, rtol=1e-11, atol=1e-13)
        if name in ("T", "F", "CHISQ", "BETA", "GAMMA"):
            want = [dists.quantile(name, *row) for row in zip(p[:40].tolist(), *[v[:40].tolist() for v in q], strict=True)]
            assert np.allclose(dists.quantile_many(name, p[:40], *[v[:40] for v in q]), want, rtol=1e-9, atol=1e-12)


def test_quantiles_of_few_keys_are_dealt_over_ranges(spark):
    rng = np.random.default_rng(1)
    data = [(k % 2 if k % 7 else None, float(v)) for k, v in enumerate(np.round(rng.normal(size=900), 2))]
    counted = spark.createDataFrame(data, "g int, __x double").groupBy("g", "__x").agg(F.count("*").alias("__c"))
    out = summary.definition5(counted, ["g"], {"Q1": 0.25, "MEDIAN": 0.5})
    for r in out.collect():
        x = sorted(v for g, v in data if g == r["g"])
        for q, c in ((0.25, "q_Q1"), (0.5, "q_MEDIAN")):
            k = len(x) * q
            assert r[c] == ((x[int(k) - 1] + x[int(k)]) / 2 if k == int(k) else x[int(k)])
    windows = [w for w in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [sum(__c#" in w]
    assert windows and all("__cum_b" in w for w in windows)
