"""Mixed models against dense matrices on a small unbalanced table."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from shoalspark.functions import special as S
from shoalspark.models.design import terms_of
from shoalspark.models.gamma import gamma_glm
from shoalspark.models.lmm import compare_models, lmm, lmm_candidates
from shoalspark.models.ols import ols

LEVELS = {"part": ["Before", "After"], "treatment": ["a", "b", "c"]}
FULL = "y ~ part*treatment*z"
FORMULAS = [FULL, "y ~ part*treatment + z", "y ~ part + treatment*z", "y ~ part*z + treatment", "y ~ part + z + treatment"]


def rows():
    rng = np.random.default_rng(7)
    out = []
    for g in range(12):
        tr = "abc"[g % 3]
        shift = rng.normal()
        for i in range(6 + g % 4):
            part = "Before" if i % 2 == 0 else "After"
            z = float(i) - 3.1
            y = 5 + (part == "After") * 0.7 + (tr == "b") * 1.1 + 0.3 * z + shift + rng.normal() * 0.8
            out.append((f"g{g:02d}", part, tr, z, float(y)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "g string, part string, treatment string, z double, y double").cache()


def dense(cols):
    """X, y, group index for columns given as functions of a row."""
    r = rows()
    x = np.array([[f(v) for f in cols] for v in r], dtype=float)
    return x, np.array([v[4] for v in r]), np.array([int(v[0][1:]) for v in r])


def gls(x, y, g, theta):
    n, p = x.shape
    v = np.eye(n) + theta * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    rss = (y - x @ beta) @ vi @ (y - x @ beta)
    crit = (n - p) * (1 + np.log(2 * np.pi * rss / (n - p))) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return beta, rss / (n - p) * np.linalg.inv(a), crit, rss / (n - p), vi


ONE = lambda v: 1.0
AFTER = lambda v: float(v[1] == "After")
B = lambda v: float(v[2] == "b")
C = lambda v: float(v[2] == "c")
Z = lambda v: v[3]


def test_terms():
    assert terms_of("y ~ a*b + z") == ("y", [("a",), ("b",), ("z",), ("a", "b")])
    assert terms_of(["a", "z", "a:z"]) == (None, [("a",), ("z",), ("a", "z")])


def test_lmm_equals_dense_reml(data):
    fit = lmm(data, "y ~ part + z + treatment", "g", levels=LEVELS)
    x, y, g = dense([ONE, AFTER, Z, B, C])
    beta, vcov, crit, s2, vi = gls(x, y, g, fit.theta)
    assert np.allclose(fit.beta, beta, atol=1e-8)
    assert np.allclose(fit.vcov, vcov, atol=1e-9)
    assert abs(fit.criterion - crit) < 1e-7
    for other in (fit.theta * 0.9, fit.theta * 1.1):
        assert gls(x, y, g, other)[2] > crit
    # predicted entity effects and leverages
    resid = y - x @ beta
    eff = {r["g"]: r["effect"] for r in fit.effects().collect()}
    want = [fit.theta * np.array([(g == k).astype(float)]) @ vi @ resid for k in range(12)]
    assert np.allclose([eff[f"g{k:02d}"] for k in range(12)], np.ravel(want), atol=1e-8)
    same = (g[:, None] == g[None, :]).astype(float)
    m = np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    hat = x @ m + fit.theta * same @ vi @ (np.eye(len(y)) - x @ m)
    got = fit.cooks(data).select("y", "leverage", "resid").toPandas().sort_values("y")
    order = np.argsort(y)
    assert np.allclose(got["leverage"], np.diag(hat)[order], atol=1e-8)
    assert np.allclose(got["resid"], (y - hat @ y)[order], atol=1e-8)


def test_candidates_share_sums_and_spark_path_agrees(data):
    local = lmm_candidates(data, FORMULAS, "g", levels=LEVELS)
    x, y, g = dense([ONE, AFTER, B, C, Z, lambda v: AFTER(v) * B(v), lambda v: AFTER(v) * C(v),
                     lambda v: AFTER(v) * Z(v), lambda v: B(v) * Z(v), lambda v: C(v) * Z(v),
                     lambda v: AFTER(v) * B(v) * Z(v), lambda v: AFTER(v) * C(v) * Z(v)])
    assert local[0].design.names[-1] == "partAfter:treatmentc:z"
    assert np.allclose(local[0].beta, gls(x, y, g, local[0].theta)[0], atol=1e-7)
    table = {r["model"]: r for r in compare_models(local).collect()}
    assert sum(r["best"] for r in table.values()) == 1 and len(table) == 5
    far = lmm_candidates(data, FORMULAS[4:], "g", levels=LEVELS, driver_cells=1)[0]
    assert far.groups.local is None
    assert abs(far.theta - local[4].theta) < 1e-5 * far.theta
    assert np.allclose(far.beta, local[4].beta, atol=1e-7)


def test_satterthwaite_and_tables(data):
    fit = lmm(data, FULL, "g", levels=LEVELS)
    coef = {r["term"]: r for r in fit.coef().collect()}
    # a between-entity contrast has about (entities - groups) df, a within one about N - p - entities
    assert 5 < coef["treatmentb"]["df"] < 30
    assert coef["z"]["df"] > 40
    anova = {r["term"]: r for r in fit.anova().collect()}
    assert [r for r in anova] == ["part", "treatment", "z", "part:treatment", "part:z", "treatment:z", "part:treatment:z"]
    assert anova["treatment"]["df1"] == 2
    # a one-df type III test of the last kind equals the squared t of a two-level additive model
    add = lmm(data, "y ~ part + z", "g", levels=LEVELS)
    t = {r["term"]: r for r in add.coef().collect()}
    f = {r["term"]: r for r in add.anova().collect()}
    assert abs(f["part"]["f"] - t["partAfter"]["t"] ** 2) < 1e-8
    assert abs(f["part"]["p"] - t["partAfter"]["p"]) < 1e-8
    r2 = fit.r2().first()
    assert 0 < r2["r2_marginal"] < r2["r2_conditional"] < 1
    assert all(r["gvif"] >= 1 - 1e-9 for r in add.vif().collect())


def test_emmeans_contrasts_predict(data):
    fit = lmm(data, "y ~ part*treatment + z", "g", levels=LEVELS)
    zbar = np.mean([v[3] for v in rows()])
    b = dict(zip(fit.design.names, fit.beta))
    em = {(r["part"], r["treatment"]): r for r in fit.emmeans(["part", "treatment"]).collect()}
    want = b["(Intercept)"] + b["partAfter"] + b["treatmentb"] + b["partAfter:treatmentb"] + b["z"] * zbar
    assert abs(em["After", "b"]["emmean"] - want) < 1e-9
    half = {r["treatment"]: r["emmean"] for r in fit.emmeans(["treatment"]).collect()}
    assert abs(half["b"] - (em["Before", "b"]["emmean"] + em["After", "b"]["emmean"]) / 2) < 1e-9
    con = fit.contrasts(["part", "treatment"], "treatment").collect()
    assert len(con) == 6
    first = next(r for r in con if r["part"] == "Before" and r["contrast"] == "a - b")
    assert abs(first["estimate"] + b["treatmentb"]) < 1e-9
    assert first["p"] <= first["p_tukey"] <= first["p_bonferroni"] + 1e-12
    rev = fit.contrasts(["part", "treatment"], "part", reverse=True).collect()
    assert rev[0]["contrast"] == "After - Before"
    pred = fit.predict(fit.grid({"z": [0.0, 1.0], "part": LEVELS["part"], "treatment": LEVELS["treatment"]}))
    row = pred.where("z = 1.0 and part = 'After' and treatment = 'c'").first()
    x = np.zeros(len(fit.beta))
    for name, v in {"(Intercept)": 1, "partAfter": 1, "treatmentc": 1, "z": 1, "partAfter:treatmentc": 1}.items():
        x[fit.design.names.index(name)] = v
    assert abs(row["predicted"] - x @ fit.beta) < 1e-9
    assert abs(row["se"] - np.sqrt(x @ fit.vcov @ x)) < 1e-9


def test_singular_fit(spark):
    # every entity has the same mean: no between-entity variance
    pattern = [1.0, -1.0, 0.5, -0.5]
    flat = [(f"g{g}", "Before" if i % 2 else "After", pattern[i] + 2) for g in range(6) for i in range(4)]
    df = spark.createDataFrame(flat, "g string, part string, y double")
    fit = lmm(df, "y ~ part", "g", levels={"part": LEVELS["part"]})
    assert fit.theta == 0.0 and fit.is_singular()


def test_checks_and_residual_views(data):
    fit = lmm(data, "y ~ part + z", "g", levels=LEVELS)
    checks = {r["check"]: r for r in fit.checks(data).collect()}
    assert set(checks) == {"normality", "heteroscedasticity", "outliers"}
    assert 0 < checks["normality"]["statistic"] <= 1
    assert fit.qq(data).count() == len(rows())
    bins = fit.residual_histogram(data, 30)
    assert sum(r["count"] for r in bins.collect()) == len(rows())


def test_ols(data):
    fit = ols(data, "y ~ part*z", levels=LEVELS)
    x, y, _ = dense([ONE, AFTER, Z, lambda v: AFTER(v) * Z(v)])
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(fit.beta, beta, atol=1e-9)
    assert abs(fit.sigma2 * fit.df_resid - rss[0]) < 1e-8
    table = fit.anova().collect()
    assert abs(sum(r["sum_sq"] for r in table) - ((y - y.mean()) ** 2).sum()) < 1e-8
    resid = [r["resid"] for r in fit.residuals(data).collect()]
    assert abs(sum(resid)) < 1e-8


def test_gamma(data):
    pos = data.where("y > 0").withColumnRenamed("y", "resp")
    table = {r["term"]: r for r in gamma_glm(pos, "resp ~ part", levels=LEVELS).collect()}
    r = rows()
    before = np.mean([v[4] for v in r if v[1] == "Before" and v[4] > 0])
    after = np.mean([v[4] for v in r if v[1] == "After" and v[4] > 0])
    assert abs(table["(Intercept)"]["estimate"] - np.log(before)) < 1e-6
    assert abs(table["partAfter"]["estimate"] - np.log(after / before)) < 1e-6


def test_special_functions():
    # fixed values: textbook quantiles
    assert abs(S.t_two_sided(2.228138852, 10) - 0.05) < 1e-9
    assert abs(S.f_sf(4.102821, 2, 10) - 0.05) < 1e-6
    assert abs(float(S.norm_ppf(np.array([0.975]))[0]) - 1.959963984540054) < 1e-12
    assert abs(S.t_ppf(0.975, 10) - 2.228138852) < 1e-8
    assert abs(S.tukey_sf(3.877, 3, 10) - 0.05) < 2e-4
    assert abs(S.tukey_sf(3.314, 3, 1e9) - 0.05) < 2e-4
    assert S.signed_rank_exact(0, 5) == 2 / 32
    p = np.array([1e-12, 1e-5, 0.3, 0.5, 0.9, 1 - 1e-9])
    assert np.allclose(S.norm_cdf(S.norm_ppf(p)), p, rtol=1e-12)


def test_gamma_refuses_rows_it_cannot_use_and_counts_the_rest(data):
    zero = data.withColumn("resp", F.when(F.col("part") == "After", F.lit(0.0)).otherwise(F.exp(F.col("y") / 10)))
    with pytest.raises(ValueError, match="rows have"):
        gamma_glm(zero, "resp ~ part", levels=LEVELS)
    table = gamma_glm(zero, "resp ~ part", levels=LEVELS, offset=0.5).collect()
    assert {r["n"] for r in table} == {data.count()}


def test_undeclared_levels_are_an_error(data):
    odd = data.withColumn("part", F.when(F.col("part") == "After", "Aftr").otherwise(F.col("part")))
    for fit in (lambda: ols(odd, "y ~ part", levels=LEVELS), lambda: lmm(odd, "y ~ part", "g", levels=LEVELS)):
        with pytest.raises(Exception, match="undeclared level"):
            fit()


def test_ml_and_reml_df_of_a_balanced_within_contrast(spark):
    rng = np.random.default_rng(8)
    rows = [(f"f{i}", p, float(rng.normal() + b)) for i, b in enumerate(rng.normal(0, 2, 12)) for p in ("Before", "After") for _ in range(5)]
    df = spark.createDataFrame(rows, "fish string, part string, y double")
    reml = {r["term"]: r["df"] for r in lmm(df, "y ~ part", "fish", levels={"part": ["Before", "After"]}).coef().collect()}
    ml = {r["term"]: r["df"] for r in lmm(df, "y ~ part", "fish", levels={"part": ["Before", "After"]}, method="ML").coef().collect()}
    assert reml["partAfter"] == pytest.approx(12 * 10 - 12 - 1, rel=1e-7)
    assert ml["partAfter"] == pytest.approx(12 * 10 - 12, rel=1e-6)
