"""Least squares over observed cells: the dense fit where both can be had, large factors, refusals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.models.ols import ols
from shoalspark.models.sparse import sparse_ols


@pytest.fixture(scope="module")
def plots(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i % 4}", ["x", "y:z", "w"][i % 3], float(i % 17), float(rng.normal(i % 5, 1))) for i in range(400)]
    rows += [(None, "x", 1.0, 2.0), ("a1", "x", None, 2.0), ("a1", "x", 1.0, None)]
    return spark.createDataFrame(rows, "a string, b string, z double, y double").repartition(5)


@pytest.mark.parametrize("formula", ["y ~ a*b + z", "y ~ a + b + a:z + z", "y ~ z", "y ~ b"])
def test_equals_the_dense_fit(plots, formula):
    want, got = ols(plots, formula), sparse_ols(plots, formula)
    a, b = ({r["term"]: r for r in f.coef().collect()} for f in (want, got))
    assert a.keys() == b.keys() and got.df_resid == want.df_resid
    for k in a:
        assert all(b[k][c] == pytest.approx(a[k][c], rel=1e-7, abs=1e-9) for c in ("estimate", "se", "t", "p"))
    for r, q in zip(want.anova().collect(), got.anova().collect()):
        assert (r["term"], r["df"]) == (q["term"], q["df"]) and q["sum_sq"] == pytest.approx(r["sum_sq"], rel=1e-7)


def test_two_factors_of_two_thousand_levels(spark):
    """Their product of levels would have four million cells; 20,000 occur, one level holds a third of all rows."""
    n = 20_000
    u = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000)
    v = (F.col("id") * 7 + F.floor(F.col("id") / 2000)) % 2000
    df = spark.range(n).select(F.format_string("u%04d", u).alias("u"), F.format_string("v%04d", v.cast("int")).alias("v"),
                               (u * 0.5 - v * 0.25 + 3).alias("y"))
    fit = sparse_ols(df, "y ~ u + v")
    got = {r["term"]: r["estimate"] for r in fit.coef().collect()}
    assert len(got) == len(fit.effects) > 3300
    assert got["(Intercept)"] == pytest.approx(3.0, abs=1e-6)
    assert all(b == pytest.approx((0.5 if k[0] == "u" else -0.25) * int(k[2:]), abs=1e-5) for k, b in got.items() if k != "(Intercept)")


def test_refusals(plots):
    with pytest.raises(ValueError, match="7 columns need 392 bytes"):
        sparse_ols(plots, "y ~ a + b + z", max_bytes=100)
    with pytest.raises(ValueError, match="determined by earlier"):
        sparse_ols(plots.withColumn("c", F.concat("a", F.lit("!"))), "y ~ a + c")
    with pytest.raises(ValueError, match="no complete row"):
        sparse_ols(plots.limit(0), "y ~ a")
    with pytest.raises(ValueError, match="is zero in all rows"):
        sparse_ols(plots.withColumn("z", F.lit(0.0)), "y ~ a + z")
    other = {r["term"] for r in sparse_ols(plots, "y ~ a", base={"a": "a2"}).coef().collect()}
    assert other == {"(Intercept)", "aa0", "aa1", "aa3"}
