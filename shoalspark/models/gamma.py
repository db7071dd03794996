"""Gamma regression with log link on the fixed effects (no random intercept)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.models.design import basis_for, design, linear_form, terms_of
from shoalspark.staging import stage


def gamma_glm(df: DataFrame, formula: str | Sequence[str], response: str | None = None,
              levels: Mapping[str, Sequence[str]] | None = None, offset: float = 0.0) -> DataFrame:
    """Coefficient table of a gamma/log regression, with the number of rows it used as ``n``.

    The family needs a positive response: a row with response + ``offset`` <= 0 is an error. The offset is added
    to every row. Rows with a null in the model's columns are left out. The fish effect of a gamma mixed
    model is not fitted: estimates are population averages.
    """
    named, terms = terms_of(formula)
    response = response or named
    basis = basis_for(df, [terms], levels)
    d = design(basis, terms)
    columns = {f"__x{j}": linear_form(basis, d.matrix[:, j]) for j in range(1, d.p)}
    rows = stage(df.withColumns(columns).select((F.col(response).cast("double") + offset).alias("__y"), *columns).dropna("any"))
    n, bad = rows.agg(F.count("*"), F.count_if(F.col("__y") <= 0)).first()
    if bad:
        raise ValueError(f"{bad} of {n} rows have {response} + {offset} <= 0, which a gamma model does not allow")
    data = VectorAssembler(inputCols=list(columns), outputCol="__x").transform(rows).select("__x", "__y")
    fit = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="__x", labelCol="__y",
                                      maxIter=50, tol=1e-10).fit(data)
    s = fit.summary
    names = [*d.names[1:], d.names[0]]  # the library lists the intercept last
    est = [*np.asarray(fit.coefficients), fit.intercept]
    out = [(name, float(e), float(se), float(t), float(p), n) for name, e, se, t, p in
           zip(names, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, se double, t double, p double, n bigint")
