"""Statistics against closed forms and plain numpy."""

import math

import numpy as np
import pytest
from harness import DATA
from pyspark.sql import functions as F

from lumenstep.operators import inference as I
from lumenstep.operators import likelihood as L
from lumenstep.operators import multivariate as M
from lumenstep.operators import regression as R
from lumenstep.operators import running
from lumenstep.operators import summary as S
from lumenstep.plans import catalog, proc_queries  # noqa: F401
from lumenstep.stats import dists


def test_distributions():
    assert math.isclose(dists.norm_cdf(1.959963984540054), 0.975, rel_tol=1e-12)
    assert math.isclose(dists.t_cdf(2.228138851964939, 10), 0.975, rel_tol=1e-9)
    assert math.isclose(dists.f_cdf(4.964602743730711, 1, 10), 0.95, rel_tol=1e-9)
    assert math.isclose(dists.chi_cdf(3.841458820694124, 1), 0.95, rel_tol=1e-9)
    assert math.isclose(dists.quantile("GAMMA", 0.5, 1.0), math.log(2), rel_tol=1e-9)
    assert dists.quantile("BINOMIAL", 0.5, 0.5, 10) == 5 and math.isclose(dists.cdf("POISSON", 2, 1.0), 2.5 / math.e, rel_tol=1e-12)
    for name, q in (("NORMAL", ()), ("T", (5,)), ("F", (3, 8)), ("CHISQ", (4,)), ("BETA", (2, 3)), ("GAMMA", (2.5,))):
        for p in (0.01, 0.3, 0.9):
            assert math.isclose(dists.cdf(name, dists.quantile(name, p, *q), *q), p, rel_tol=1e-8)


def test_exact_tests():
    tea = I.fisher(np.array([[3, 1], [1, 3]]))
    assert math.isclose(tea["RIGHT"], 17 / 70) and math.isclose(tea["TWO"], 34 / 70) and math.isclose(tea["TABLE"], 16 / 70)
    three = I.fisher(np.array([[3, 1, 0], [0, 2, 3]]))
    assert 0.09 < three["TWO"] < 0.2
    k = I.kappa(np.array([[20, 5], [10, 15]]))
    assert math.isclose(k["KAPPA"], 0.4)
    assert math.isclose(I.relative_risk(np.array([[10, 20], [5, 40]]))["OR"], 4.0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    g = rng.integers(0, 3, n)
    y = 1 + 2 * x1 - x2 + g + rng.normal(size=n)
    z = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x1)))).astype(int)
    c = rng.poisson(np.exp(0.2 + 0.5 * x1))
    rows = [(int(k), *map(float, (x1[k], x2[k], y[k])), "abc"[g[k]], int(z[k]), int(c[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, y double, g string, z int, c int"), (x1, x2, y, g, z, c)


def test_regression(data):
    df, (x1, x2, y, *_) = data
    fit = R.regress(df, "y", ["x1", "x2"])
    a = np.column_stack([np.ones_like(x1), x1, x2])
    beta, sse, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert np.allclose(fit.beta, beta) and math.isclose(fit.sse, sse[0], rel_tol=1e-9)
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    out = R.output(df, fit).orderBy("id").select("H", "R", "COOKD", "RSTUDENT", "PRESS").toPandas()
    e = y - a @ beta
    s2 = sse[0] / (len(y) - 3)
    assert np.allclose(out["H"], h) and np.allclose(out["R"], e) and np.allclose(out["PRESS"], e / (1 - h))
    assert np.allclose(out["COOKD"], e**2 * h / (3 * s2 * (1 - h) ** 2))
    est = R.estimates(df, fit).toPandas()
    assert math.isclose(R.linear_test(fit, [[0, 1, 0]])["F"], est["T"][1] ** 2, rel_tol=1e-9)
    assert math.isclose(est["VIF"][1], 1 / (1 - np.corrcoef(x1, x2)[0, 1] ** 2), rel_tol=1e-9)
    d = R.durbin_watson(df, fit, ["id"])
    assert math.isclose(d["DW"], (np.diff(e) ** 2).sum() / (e**2).sum(), rel_tol=1e-9)
    assert set(R.select(fit, "FORWARD", 0.01)[0].x) == {"x1", "x2"} and len(R.all_subsets(fit)) == 3
    noint = R.regress(df, "y", ["x1"], intercept=False)
    assert math.isclose(noint.beta[0], (x1 @ y) / (x1 @ x1), rel_tol=1e-9)


def test_general_linear(data):
    df, (x1, _, y, g, *_) = data
    m = R.general_linear(df, "y", ["g", "x1"], ["g"])
    a = np.column_stack([g == 0, g == 1, g == 2, x1]).astype(float)
    beta, sse, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert math.isclose(m.sse, sse[0], rel_tol=1e-8) and m.rank == 4
    ls = {r["g"]: r["ESTIMATE"] for r in m.lsmeans("g")}
    assert math.isclose(ls["b"] - ls["a"], beta[1] - beta[0], rel_tol=1e-8)
    small = np.linalg.lstsq(np.column_stack([np.ones_like(x1), x1]), y, rcond=None)[1][0]
    assert math.isclose(R.type_three(m)[0]["SS"], small - sse[0], rel_tol=1e-7)


def test_likelihood_models(data):
    df, (x1, _, y, g, z, c) = data
    fit = L.logistic(df, "z", ["x1"], event=1)
    a = np.column_stack([np.ones_like(x1), x1])
    p = 1 / (1 + np.exp(-(a @ fit["beta"])))
    assert np.allclose(a.T @ (z - p), 0, atol=1e-6) and fit["LR"] > 0
    scored = L.logistic_output(df, fit).orderBy("id").toPandas()
    assert np.allclose(scored["P_1"], p)
    pois = L.genmod(df, "c", ["x1"], "POISSON")
    assert np.allclose(a.T @ (c - np.exp(a @ pois["beta"])), 0, atol=1e-5)
    norm = L.genmod(df, "y", ["x1"])
    assert np.allclose(norm["beta"], np.linalg.lstsq(a, y, rcond=None)[0])
    ordinal = L.logistic_ordinal(df.withColumn("o", F.col("z")), "o", ["x1"])
    assert np.allclose(ordinal["beta"], [-fit["beta"][0], -fit["beta"][1]], atol=1e-4)
    mixed = L.mixed(df, "y", ["x1"], "g")
    assert abs(mixed["fixed"][1]["ESTIMATE"] - 2) < 0.3 and mixed["covariance"]["SUBJECT"] > 0.1
    ar = L.mixed(df.withColumn("s", F.floor(F.col("id") / 10)), "y", ["x1"], "s", structure="AR(1)", time="id")
    un = L.mixed(df.withColumn("s", F.floor(F.col("id") / 4)).withColumn("t", F.col("id") % 4), "y", ["x1"], "s", structure="UN", time="t")
    assert abs(ar["covariance"]["RHO"]) < 0.5 and un["covariance"]["UN(1,1)"] > 0
    for method in ("RSPL", "LAPLACE"):
        glm = L.glimmix(df, "c", ["x1"], "g", "POISSON", method=method)
        assert abs(glm["fixed"]["x1"] - pois["beta"][1]) < 0.1


def test_multivariate(data, spark):
    df, (x1, x2, *_) = data
    stats, out = M.princomp(df, ["x1", "x2"])
    assert np.allclose(stats["eigenvalues"].sum(), 2) and {"Prin1", "Prin2"} <= set(out.columns)
    f, _ = M.factor(df, ["x1", "x2", "y"], 2, "VARIMAX")
    assert np.allclose(f["loadings"] @ f["loadings"].T, f["unrotated"] @ f["unrotated"].T)
    centers, km = M.fastclus(df, ["x1", "x2"], 3)
    assert centers.shape == (3, 2) and km.where("CLUSTER is null").count() == 0
    tree = M.cluster(spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 10.0)], "i int, v double"), ["v"], "i", "SINGLE")
    assert [(a, b, h) for _, a, b, h, _ in tree] == [("1", "2", 1.0), ("CL2", "3", 9.0)]
    lda, scored = M.discrim(df, ["y", "x1"], "g")
    assert M.error_rates(scored, "g").agg(F.max("RATE")).first()[0] < 0.8 and lda["levels"] == ["a", "b", "c"]


def test_running_totals(spark):
    df = spark.createDataFrame([(k, float((k * 37) % 101)) for k in range(500)] + [(500, None)], "id int, v double").repartition(5)
    got = running.cumulate(df, F.lit(1), ["v", "id"], "n").orderBy(F.col("v").asc_nulls_first(), "id").toPandas()
    assert got["n"].tolist() == list(range(1, 502))
    down = running.cumulate(df, F.lit(1), ["-v", "id"], "n").orderBy(F.col("v").desc_nulls_last(), "id").toPandas()
    assert down["n"].tolist() == list(range(1, 502))
    text = spark.createDataFrame([(f"w{k % 300}", k) for k in range(900)], "w string, k int")
    got = running.cumulate(text, F.lit(1), ["w", "k"], "n").orderBy("w", "k").toPandas()
    assert got["n"].tolist() == list(range(1, 901))


def test_means_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", None), (None, 7.0)], "g string, x double")
    got = {(r["g"], r["_TYPE_"]): r for r in S.means(df, ["x"], ["N", "NMISS", "P25", "MEDIAN", "STD"], ["g"]).collect()}
    assert got["a", 1]["x_P25"] == 1.5 and got["a", 1]["x_MEDIAN"] == 2.5
    assert got["b", 1]["x_N"] == 0 and got["b", 1]["x_NMISS"] == 1 and got["b", 1]["x_P25"] is None
    assert got[None, 1]["x_STD"] is None and got[None, 0]["_FREQ_"] == 6
    assert I.exact_wilcoxon(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double"), "v", "g").first()["P_TWO"] == pytest.approx(1 / 3)
    w = I.shapiro_wilk(spark.createDataFrame([(float(v),) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)], "v double"), "v").first()
    assert abs(w["W"] - 0.79) < 0.01 and abs(w["P"] - 0.0067) < 0.002


def brute_kendall(x, y):
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i)]
    return sum(a * b for a, b in pairs) / math.sqrt(sum(abs(a) for a, _ in pairs) * sum(abs(b) for _, b in pairs))


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 150, 150)
    df = spark.createDataFrame([(int(a), float(a * 3 + b)) for a, b in zip(x, y, strict=True)], "a int, b double")
    assert math.isclose(I.kendall(df, "a", "b")[0], brute_kendall(x, x * 3.0 + y), rel_tol=1e-12)


def test_kendall_limit_raises(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (-F.col("id")).alias("b"))
    assert I.kendall(df.where("a < 9"), "a", "b", most_levels=3)[0] == -1
    with pytest.raises(ValueError):
        I.kendall(df, "a", "b", most_levels=3)


def test_kendall_query_takes_the_table(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet").toPandas()
    got = catalog.QUERIES["proc_corr_kendall_all"](spark, DATA).first()
    assert got["N"] == len(part) and math.isclose(got["R"], brute_kendall(part["p_size"].to_numpy(), part["p_retailprice"].to_numpy()), abs_tol=1e-8)


def test_distance_query_takes_all_pairs(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert catalog.QUERIES["proc_distance_all"](spark, DATA).count() == n * (n - 1) // 2
