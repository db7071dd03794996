"""Ordinary least squares from one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.functions import special as S
from shoalspark.models.design import (Basis, Design, Moments, basis_for, cell_sums, collect_moments, design,
                                      linear_form, terms_of, usable_rows)


@dataclass
class OlsFit:
    spark: SparkSession
    basis: Basis
    design: Design
    moments: Moments
    response: str
    beta: np.ndarray
    vcov: np.ndarray
    sigma2: float

    @property
    def df_resid(self) -> int:
        return int(self.moments.n) - self.design.p

    def coef(self) -> DataFrame:
        """Estimate, SE, t, df and p per coefficient."""
        rows = []
        for j, name in enumerate(self.design.names):
            se = float(np.sqrt(self.vcov[j, j]))
            t = float(self.beta[j]) / se if se > 0 else None
            p = float(S.t_two_sided(t, self.df_resid)) if t is not None else None
            rows.append((name, float(self.beta[j]), se, t, self.df_resid, p))
        return self.spark.createDataFrame(
            rows, "term string, estimate double, se double, t double, df int, p double")

    def fit_stats(self) -> DataFrame:
        """N, residual sd, R2, adjusted R2, and the marginal R2 of a model without random part."""
        m, p = self.moments, self.design.p
        rss = self.sigma2 * self.df_resid
        tss = m.yy - _sum_y(m, self.basis) ** 2 / m.n
        r2 = 1 - rss / tss
        explained = (tss - rss) / (m.n - 1)
        row = (int(m.n), float(np.sqrt(self.sigma2)), r2, 1 - (1 - r2) * (m.n - 1) / (m.n - p),
               explained / (explained + self.sigma2))
        return self.spark.createDataFrame(
            [row], "n bigint, sigma double, r2 double, r2_adjusted double, r2_marginal double")

    def anova(self) -> DataFrame:
        """Sequential F table."""
        rss_full = self.sigma2 * self.df_resid
        rows, previous, done = [], None, [self.design.term_of.index(0)]
        previous = _rss(self.moments, self.design.matrix[:, done])
        for number, term in enumerate(self.design.terms, start=1):
            mine = [j for j, t in enumerate(self.design.term_of) if t == number]
            done = done + mine
            rss = _rss(self.moments, self.design.matrix[:, done])
            ss, k = previous - rss, len(mine)
            f = (ss / k) / self.sigma2
            rows.append((":".join(term), k, float(ss), float(f), float(S.f_sf(f, k, self.df_resid))))
            previous = rss
        rows.append(("Residuals", self.df_resid, float(rss_full), None, None))
        return self.spark.createDataFrame(rows, "term string, df int, sum_sq double, f double, p double")

    def residuals(self, df: DataFrame) -> DataFrame:
        fitted = linear_form(self.basis, self.design.matrix @ self.beta)
        out = df.withColumn("fitted", fitted)
        return out.where(F.col("fitted").isNotNull() & F.col(self.response).isNotNull()) \
            .withColumn("resid", F.col(self.response) - F.col("fitted"))


def _sum_y(m: Moments, basis: Basis) -> float:
    return float(m.zy.reshape(len(basis.cells), -1)[:, 0].sum())


def _rss(m: Moments, b: np.ndarray) -> float:
    c = b.T @ m.zy
    return float(m.yy - c @ np.linalg.solve(b.T @ m.zz @ b, c))


def ols(df: DataFrame, formula: str | Sequence[str], response: str | None = None,
        levels: Mapping[str, Sequence[str]] | None = None) -> OlsFit:
    """Least squares of ``y ~ terms``; only p-by-p sums reach the driver."""
    named, terms = terms_of(formula)
    response = response or named
    basis = basis_for(df, [terms], levels)
    moments = collect_moments(cell_sums(usable_rows(df, basis, response), basis, ["__cell"]), basis)
    d = design(basis, terms)
    a = d.matrix.T @ moments.zz @ d.matrix
    c = d.matrix.T @ moments.zy
    beta = np.linalg.solve(a, c)
    sigma2 = float(moments.yy - c @ beta) / (moments.n - d.p)
    return OlsFit(df.sparkSession, basis, d, moments, response, beta, sigma2 * np.linalg.inv(a), sigma2)
