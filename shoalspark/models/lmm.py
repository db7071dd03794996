"""Random-intercept linear mixed models from distributed sufficient statistics.

With theta the variance ratio and w = theta / (1 + theta n) for an entity of n rows, the profiled
likelihood needs only sums over entities of w times outer products of each entity's row sums.
w depends on an entity through n alone, so the outer products are added up per n once; any theta
and any nested model is then evaluated from that short table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.functions import special as S
from shoalspark.models.design import (Basis, Design, Moments, basis_for, cell_sums, collect_moments, design,
                                      linear_form, terms_of, usable_rows)
from shoalspark.models.ols import ols
from shoalspark.operators.paired import shapiro
from shoalspark.operators.ranks import qq_points
from shoalspark.operators.summary import histogram
from shoalspark.staging import stage

# size up to which the per-n table may sit on the driver; beyond it each theta is a Spark job
#: numbers of the table by entity size that may be kept on the driver
DRIVER_CELLS = 4_000_000


@dataclass
class Sums:
    """Entity sums at one theta, with derivatives."""

    w: np.ndarray
    logdet: float
    dw: np.ndarray
    dlogdet: float


@dataclass
class GroupSums:
    """Outer products of entity row sums, added up per entity size n."""

    table: DataFrame
    width: int
    local: tuple[np.ndarray, np.ndarray, np.ndarray] | None

    def at(self, thetas: Sequence[float]) -> list[Sums]:
        """For each theta the sums of w r r' and log(1 + theta n), and their derivatives in theta."""
        k = self.width
        if self.local is not None:
            n, groups, outer = self.local
            out = []
            for th in thetas:
                d = 1 + th * n
                out.append(Sums(np.tensordot(th / d, outer, axes=1), float((groups * np.log(d)).sum()),
                                np.tensordot(1 / d**2, outer, axes=1), float((groups * n / d).sum())))
            return out
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("th"))
                                   for i, t in enumerate(thetas)])).alias("g")
        th, v = F.col("g.th"), F.col("value")
        d = 1 + th * F.col("n")
        # position -1 holds the number of entities of that size
        head = F.col("pos") < 0
        rows = self.table.select("n", "pos", "value", grid).groupBy("g.i", "pos").agg(
            F.sum(F.when(head, v * F.log(d)).otherwise(v * th / d)).alias("value"),
            F.sum(F.when(head, v * F.col("n") / d).otherwise(v / (d * d))).alias("slope")).collect()
        mats, slopes = np.zeros((len(thetas), k * k + 1)), np.zeros((len(thetas), k * k + 1))
        for r in rows:
            mats[r["i"], r["pos"] + 1] = r["value"]
            slopes[r["i"], r["pos"] + 1] = r["slope"]
        return [Sums(m[1:].reshape(k, k), float(m[0]), q[1:].reshape(k, k), float(q[0]))
                for m, q in zip(mats, slopes)]


def entity_sums(sums: DataFrame, basis: Basis) -> DataFrame:
    """Per entity: its size ``n`` and the array ``r`` of row sums per basis column, sum of y last."""
    k = len(basis.monomials)
    parts = [F.coalesce(F.sum(F.when(F.col("__cell") == c, F.col(f"__s0_{a}"))), F.lit(0.0))
             for c in range(len(basis.cells)) for a in range(k)]
    return sums.groupBy("__group").agg(F.sum("__s0_0").alias("n"),
                                       F.array(*parts, F.sum("__sy0")).alias("r"))


def group_sums(entities: DataFrame, width: int, driver_cells: int = DRIVER_CELLS) -> GroupSums:
    def outer(batches):
        held: dict[float, np.ndarray] = {}

        def flush():
            ns, rows = list(held), [held[x] for x in held]
            held.clear()
            return pd.DataFrame({"n": ns, "v": rows})

        for pdf in batches:
            r = np.stack(pdf["r"].to_numpy()).astype(float)
            n = pdf["n"].to_numpy(dtype=float)
            for size in np.unique(n):
                rows = r[n == size]
                flat = np.concatenate([[len(rows)], (rows.T @ rows).ravel()])
                held[size] = held[size] + flat if size in held else flat
            if len(held) > 1000:
                yield flush()
        if held:
            yield flush()

    partial = entities.select("n", "r").mapInPandas(outer, "n double, v array<double>")
    long = partial.select("n", F.posexplode("v").alias("pos", "value")) \
        .groupBy("n", (F.col("pos") - 1).alias("pos")).agg(F.sum("value").alias("value"))
    table = stage(long)
    sizes = table.where(F.col("pos") == -1).count()
    if sizes * (width * width + 1) > driver_cells:
        return GroupSums(table, width, None)
    pdf = table.toPandas()
    ns = np.sort(pdf["n"].unique())
    at = {x: i for i, x in enumerate(ns)}
    grid = np.zeros((len(ns), width * width + 1))
    grid[[at[x] for x in pdf["n"]], pdf["pos"].to_numpy() + 1] = pdf["value"].to_numpy()
    return GroupSums(table, width, (ns, grid[:, 0], grid[:, 1:].reshape(-1, width, width)))


@dataclass
class Point:
    """The model profiled at one theta."""

    a: np.ndarray
    beta: np.ndarray
    rss: float
    logdet_groups: float
    logdet_a: float
    slope: float
    drss: float
    dlogdet: float
    da: np.ndarray


@dataclass
class LmmFit:
    spark: SparkSession
    basis: Basis
    design: Design
    moments: Moments
    groups: GroupSums
    entities: DataFrame
    response: str
    group: str
    method: str
    formula: str
    theta: float = 0.0
    criterion: float = 0.0
    beta: np.ndarray = field(default=None)
    vcov: np.ndarray = field(default=None)
    sigma2: float = 0.0
    _var: tuple = field(default=None)

    # --- fitting

    def points(self, thetas: Sequence[float]) -> list[Point]:
        b, m = self.design.matrix, self.moments
        k = self.basis.size
        n, p = m.n, self.design.p
        out = []
        for g in self.groups.at(thetas):
            a = b.T @ (m.zz - g.w[:k, :k]) @ b
            c = b.T @ (m.zy - g.w[:k, k])
            beta = np.linalg.solve(a, c)
            rss = float(m.yy - g.w[k, k] - c @ beta)
            full = np.append(-(b @ beta), 1.0)
            drss = -float(full @ g.dw @ full)
            da, dlogdet = -(b.T @ g.dw[:k, :k] @ b), g.dlogdet
            if self.method != "ML":
                dlogdet += float(np.trace(np.linalg.solve(a, da)))
            slope = (n if self.method == "ML" else n - p) * drss / rss + dlogdet
            out.append(Point(a, beta, rss, g.logdet, float(np.linalg.slogdet(a)[1]), slope, drss, dlogdet, da))
        return out

    def objective(self, pt: Point) -> float:
        """-2 log likelihood (REML or ML) with beta and sigma profiled out."""
        n, p = self.moments.n, self.design.p
        if self.method == "ML":
            return n * (1 + np.log(2 * np.pi * pt.rss / n)) + pt.logdet_groups
        return (n - p) * (1 + np.log(2 * np.pi * pt.rss / (n - p))) + pt.logdet_groups + pt.logdet_a

    def optimise(self) -> LmmFit:
        """Best point of a grid over log theta, then the root of the slope next to it."""
        grid = np.linspace(np.log(1e-8), np.log(1e8), 33)
        points = self.points(np.exp(grid))
        i = int(np.argmin([self.objective(q) for q in points]))
        if points[i].slope >= 0 and i == 0:
            best = 0.0
        else:
            lo, hi = (grid[i - 1], grid[i]) if points[i].slope >= 0 else (grid[i], grid[min(i + 1, 32)])
            for _ in range(12):
                inner = np.linspace(lo, hi, 17)
                up = [q.slope >= 0 for q in self.points(np.exp(inner))]
                j = up.index(True) if True in up else 16
                lo, hi = inner[max(j - 1, 0)], inner[j]
            best = float(np.exp((lo + hi) / 2))
        at_best, at_zero = self.points([best, 0.0])
        if self.objective(at_zero) < self.objective(at_best):
            best, at_best = 0.0, at_zero
        dof = self.moments.n if self.method == "ML" else self.moments.n - self.design.p
        self.theta, self.beta, self.criterion = best, at_best.beta, float(self.objective(at_best))
        self.sigma2 = at_best.rss / dof
        self.vcov = self.sigma2 * np.linalg.inv(at_best.a)
        return self

    @property
    def aic(self) -> float:
        return self.criterion + 2 * (self.design.p + 2)

    def is_singular(self, tol: float = 1e-4) -> bool:
        return bool(np.sqrt(self.theta) < tol)

    # --- inference

    def _variance_law(self):
        """Covariance of (tau, sigma) and the derivative of V in tau, for Satterthwaite's df.

        First derivatives of the criterion (of the method used) are exact; only the second one in tau is a
        difference of them, by the five-point rule.
        """
        if self._var is None:
            tau, sigma = np.sqrt(self.theta), np.sqrt(self.sigma2)
            if self.is_singular():
                self._var = (None, None)
            else:
                dof = self.moments.n - (0 if self.method == "ML" else self.design.p)
                h = 1e-3 * tau
                steps = np.array([-2, -1, 0, 1, 2])
                points = self.points(list((tau + steps * h) ** 2))
                first = [2 * (tau + s * h) * (q.dlogdet + q.drss / self.sigma2) for s, q in zip(steps, points)]
                mid = points[2]
                tt = (first[0] - 8 * first[1] + 8 * first[3] - first[4]) / (12 * h)
                ts = -4 * tau * mid.drss / sigma**3
                ss = -2 * dof / sigma**2 + 6 * mid.rss / sigma**4
                law = 2 * np.linalg.inv(np.array([[tt, ts], [ts, ss]]))
                inverse = np.linalg.inv(mid.a)
                self._var = (law, -self.sigma2 * 2 * tau * inverse @ mid.da @ inverse)
        return self._var

    def satterthwaite(self, contrast: np.ndarray) -> float:
        """Degrees of freedom of one contrast of the coefficients."""
        law, dv = self._variance_law()
        if law is None:
            return self.moments.n - self.design.p
        v = contrast @ self.vcov @ contrast
        grad = np.array([contrast @ dv @ contrast, 2 * v / np.sqrt(self.sigma2)])
        return float(2 * v * v / (grad @ law @ grad))

    def coef(self) -> DataFrame:
        """Estimate, SE, Satterthwaite df, t and p per coefficient."""
        rows = []
        for j, name in enumerate(self.design.names):
            unit = np.eye(self.design.p)[j]
            se, df = float(np.sqrt(self.vcov[j, j])), self.satterthwaite(unit)
            t = float(self.beta[j]) / se
            rows.append((name, float(self.beta[j]), se, float(df), t, float(S.t_two_sided(t, df))))
        return self.spark.createDataFrame(
            rows, "term string, estimate double, se double, df double, t double, p double")

    def variance(self) -> DataFrame:
        """Variance parts, criterion, AIC and the singularity flag."""
        row = (self.formula, int(self.moments.n), float(self.theta * self.sigma2), float(self.sigma2),
               float(self.criterion), float(self.aic), self.is_singular())
        return self.spark.createDataFrame(
            [row], "model string, n bigint, var_group double, var_resid double, criterion double, aic double, "
                   "singular boolean")

    def anova(self) -> DataFrame:
        """Type III F table: the terms tested under sum-to-zero coding."""
        sum_coded = design(self.basis, self.design.terms, coding="sum")
        to_sum = np.linalg.lstsq(sum_coded.matrix, self.design.matrix, rcond=None)[0]
        rows = []
        for number, term in enumerate(self.design.terms, start=1):
            lmat = to_sum[[j for j, t in enumerate(sum_coded.term_of) if t == number]]
            q = len(lmat)
            cov = lmat @ self.vcov @ lmat.T
            f = float((lmat @ self.beta) @ np.linalg.solve(cov, lmat @ self.beta)) / q
            _, vectors = np.linalg.eigh(cov)
            each = [self.satterthwaite(vectors[:, i] @ lmat) for i in range(q)]
            if q == 1:
                df2 = each[0]
            else:
                e = sum(v / (v - 2) for v in each if v > 2)
                df2 = 2 * e / (e - q) if e > q else 0.0
            p = float(S.f_sf(f, q, df2)) if df2 > 0 else None
            rows.append((":".join(term), q, float(df2), f, p))
        return self.spark.createDataFrame(rows, "term string, df1 int, df2 double, f double, p double")

    def r2(self) -> DataFrame:
        """Marginal and conditional R2."""
        weights = self.design.matrix @ self.beta
        ones = np.zeros((len(self.basis.cells), len(self.basis.monomials)))
        ones[:, 0] = 1
        n = self.moments.n
        mean = float(weights @ self.moments.zz @ ones.ravel()) / n
        fixed = (float(weights @ self.moments.zz @ weights) - n * mean**2) / (n - 1)
        total = fixed + self.theta * self.sigma2 + self.sigma2
        row = (fixed / total, (fixed + self.theta * self.sigma2) / total)
        return self.spark.createDataFrame([row], "r2_marginal double, r2_conditional double")

    def vif(self) -> DataFrame:
        """Generalised variance inflation per term (empty with fewer than two terms)."""
        keep = [j for j, t in enumerate(self.design.term_of) if t > 0]
        v = self.vcov[np.ix_(keep, keep)]
        d = np.sqrt(np.diag(v))
        cor = v / np.outer(d, d)
        owner = [self.design.term_of[j] for j in keep]
        rows = []
        if len(self.design.terms) > 1:
            for number, term in enumerate(self.design.terms, start=1):
                mine = [i for i, t in enumerate(owner) if t == number]
                rest = [i for i in range(len(keep)) if i not in mine]
                gvif = (np.linalg.det(cor[np.ix_(mine, mine)]) * np.linalg.det(cor[np.ix_(rest, rest)])
                        / np.linalg.det(cor))
                rows.append((":".join(term), float(gvif), len(mine), float(gvif ** (1 / (2 * len(mine))))))
        return self.spark.createDataFrame(rows, "term string, gvif double, df int, gvif_scaled double")

    # --- estimated means, contrasts, prediction

    def _covariate_means(self) -> dict[str, float]:
        ones = np.zeros((len(self.basis.cells), len(self.basis.monomials)))
        ones[:, 0] = 1
        totals = (self.moments.zz @ ones.ravel()).reshape(ones.shape).sum(axis=0)
        return {m[0]: float(totals[i] / self.moments.n)
                for i, m in enumerate(self.basis.monomials) if len(m) == 1}

    def reference_grid(self, specs: Sequence[str], at: Mapping[str, Sequence[float]] | None = None):
        """(labels, contrast rows) over factor levels and covariate values; other factors are averaged."""
        means, at = self._covariate_means(), dict(at or {})
        used = {v for t in self.design.terms for v in t}
        values: dict[str, list] = {}
        for name in specs:
            if name not in used:
                raise ValueError(f"{name} is not in the model")
            values[name] = self.basis.factors[name] if name in self.basis.factors else \
                list(at.get(name, [means[name]]))
        labels, rows = [{}], []
        for name, choices in values.items():
            labels = [{**old, name: v} for old in labels for v in choices]
        order = list(self.basis.factors)
        for lab in labels:
            cov = {c: float(lab.get(c, at.get(c, [means[c]])[0])) for c in means}
            cells = [c for c in self.basis.cells
                     if all(self.basis.factors[f][c[order.index(f)]] == lab[f] for f in order if f in lab)]
            rows.append(np.mean([self.basis.vector(c, cov) @ self.design.matrix for c in cells], axis=0))
        return labels, np.array(rows)

    def _label_schema(self, names: Sequence[str]) -> str:
        return ", ".join(f"`{n}` {'string' if n in self.basis.factors else 'double'}" for n in names)

    def emmeans(self, specs: Sequence[str], at: Mapping[str, Sequence[float]] | None = None,
                level: float = 0.95) -> DataFrame:
        """Estimated marginal means with SE, df and confidence limits."""
        labels, rows = self.reference_grid(specs, at)
        out = []
        for lab, x in zip(labels, rows):
            est, se, df = float(x @ self.beta), float(np.sqrt(x @ self.vcov @ x)), self.satterthwaite(x)
            half = S.t_ppf(1 - (1 - level) / 2, df) * se
            out.append((*[lab[s] for s in specs], est, se, float(df), est - half, est + half))
        return self.spark.createDataFrame(
            out, f"{self._label_schema(specs)}, emmean double, se double, df double, lower double, upper double")

    def contrasts(self, specs: Sequence[str], simple: str, reverse: bool = False,
                  at: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
        """Pairwise differences over ``simple`` within each combination of the other ``specs``.

        p is given unadjusted and by the Tukey, Bonferroni and Holm rules within each family.
        """
        labels, rows = self.reference_grid(specs, at)
        by = [s for s in specs if s != simple]
        families: dict[tuple, list[int]] = {}
        for i, lab in enumerate(labels):
            families.setdefault(tuple(lab[s] for s in by), []).append(i)
        out = []
        for key, members in families.items():
            block = []
            for i, j in combinations(members, 2):
                i, j = (j, i) if reverse else (i, j)
                x = rows[i] - rows[j]
                est, se, df = float(x @ self.beta), float(np.sqrt(x @ self.vcov @ x)), self.satterthwaite(x)
                t = est / se
                block.append([f"{labels[i][simple]} - {labels[j][simple]}", est, se, float(df), t,
                              float(S.t_two_sided(t, df))])
            m, k = len(block), len(members)
            running = 0.0
            holm = {}
            for rank, i in enumerate(sorted(range(m), key=lambda i: block[i][5])):
                running = max(running, min(1.0, (m - rank) * block[i][5]))
                holm[i] = running
            for i, b in enumerate(block):
                tukey = S.tukey_sf(abs(b[4]) * np.sqrt(2.0), k, b[3])
                out.append((*key, *b, float(tukey), min(1.0, m * b[5]), holm[i]))
        head = f"{self._label_schema(by)}, " if by else ""
        return self.spark.createDataFrame(
            out, head + "contrast string, estimate double, se double, df double, t double, p double, "
                        "p_tukey double, p_bonferroni double, p_holm double")

    def grid(self, terms: Mapping[str, Sequence]) -> DataFrame:
        """A scoring grid of the given values; factors not named stay at their reference level."""
        means = self._covariate_means()
        rows, names = [()], []
        used = {v for t in self.design.terms for v in t}
        plan = {**{k: list(v) for k, v in terms.items()},
                **{f: [lv[0]] for f, lv in self.basis.factors.items() if f in used and f not in terms},
                **{c: [m] for c, m in means.items() if c not in terms}}
        for name, values in plan.items():
            names.append(name)
            rows = [(*r, v if name in self.basis.factors else float(v)) for r in rows for v in values]
        return self.spark.createDataFrame(rows, self._label_schema(names))

    def predict(self, df: DataFrame) -> DataFrame:
        """Population prediction and 95 % limits for any rows with the model's columns."""
        root = np.linalg.cholesky(self.vcov)
        var = None
        for j in range(self.design.p):
            piece = linear_form(self.basis, self.design.matrix @ root[:, j])
            var = piece * piece if var is None else var + piece * piece
        unused = [f for f in self.basis.factors if f not in df.columns]
        scored = df.withColumns({f: F.lit(self.basis.factors[f][0]) for f in unused}) if unused else df
        pred = linear_form(self.basis, self.design.matrix @ self.beta)
        return scored.withColumns({"predicted": pred, "se": F.sqrt(var)}).withColumns({
            "conf_low": F.col("predicted") - 1.959963984540054 * F.col("se"),
            "conf_high": F.col("predicted") + 1.959963984540054 * F.col("se"),
        }).drop(*unused)

    # --- random effects, residuals, checks

    def effects(self) -> DataFrame:
        """Predicted intercept deviation per entity."""
        weights = np.append(-(self.design.matrix @ self.beta), 1.0)
        dot = F.aggregate(F.zip_with("r", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b),
                          F.lit(0.0), lambda acc, v: acc + v)
        shrink = F.lit(self.theta) / (1 + F.lit(self.theta) * F.col("n"))
        return self.entities.select(F.col("__group").alias(self.group), "n", (shrink * dot).alias("effect"))

    def residuals(self, df: DataFrame) -> DataFrame:
        """Rows used in the fit with ``fitted`` (fixed plus entity effect) and ``resid``."""
        fixed = linear_form(self.basis, self.design.matrix @ self.beta)
        eff = self.effects().select(F.col(self.group), "effect")
        rows = df.join(eff, self.group, "inner").withColumn("fitted", fixed + F.col("effect")).drop("effect")
        return rows.where(F.col("fitted").isNotNull() & F.col(self.response).isNotNull()) \
            .withColumn("resid", F.col(self.response) - F.col("fitted"))

    def qq(self, df: DataFrame) -> DataFrame:
        return qq_points(stage(self.residuals(df).select("resid")), "resid")

    def residual_histogram(self, df: DataFrame, bins: int = 30) -> DataFrame:
        return histogram(stage(self.residuals(df).select("resid")), "resid", bins)

    def cooks(self, df: DataFrame) -> DataFrame:
        """Residual rows with ``leverage`` and ``cook``, from the entity sums of the fit."""
        k, p = self.basis.size, self.design.p
        b = self.design.matrix
        root = np.linalg.cholesky(np.linalg.inv(self.points([self.theta])[0].a))
        per_entity = self.entities.select(
            F.col("__group").alias(self.group),
            (F.lit(self.theta) / (1 + F.lit(self.theta) * F.col("n"))).alias("__w"), "r")
        rows = self.residuals(df).join(per_entity, self.group, "inner")
        lever = F.col("__w")
        for j in range(p):
            weights = b @ root[:, j]
            group_part = F.aggregate(
                F.zip_with(F.slice("r", 1, k), F.array(*[F.lit(float(w)) for w in weights]), lambda x, y: x * y),
                F.lit(0.0), lambda acc, v: acc + v)
            piece = linear_form(self.basis, weights) - F.col("__w") * group_part
            lever = lever + piece * piece
        rows = rows.withColumn("leverage", lever).drop("__w", "r")
        h = F.col("leverage")
        cook = F.try_divide(h, (1 - h) * (1 - h)) * F.col("resid") * F.col("resid") / F.lit(self.sigma2 * p)
        return rows.withColumn("cook", cook)

    def checks(self, df: DataFrame) -> DataFrame:
        """Residual normality, heteroscedasticity (Breusch-Pagan score) and Cook outliers as rows."""
        rows = stage(self.cooks(df).select("fitted", "resid", "cook"))
        n = self.moments.n
        out = []
        sw = shapiro(rows, (), "resid").first()
        out.append(("normality", sw["w"], sw["p"], None))
        scale = float(rows.agg(F.avg(F.col("resid") * F.col("resid"))).first()[0])
        score = ols(rows.withColumn("u", F.col("resid") * F.col("resid") / scale), "u ~ fitted")
        table = {r["term"]: r for r in score.anova().collect()}
        chi2 = table["fitted"]["sum_sq"] / 2
        out.append(("heteroscedasticity", float(chi2), float(S.chi2_1_sf(chi2)), None))
        cut = S.f_median(self.design.p, n - self.design.p)
        out.append(("outliers", float(cut), None, int(rows.where(F.col("cook") > cut).count())))
        return self.spark.createDataFrame(out, "check string, statistic double, p double, flagged bigint")


def lmm(df: DataFrame, formula: str | Sequence[str], group: str, response: str | None = None,
        levels: Mapping[str, Sequence[str]] | None = None, method: str = "REML") -> LmmFit:
    """Fit ``y ~ terms + (1 | group)``.

    Rows with a missing value or a level outside the declared ones are left out; ``variance()``
    tells how many remain.
    """
    return lmm_candidates(df, [formula], group, response, levels, method)[0]


def lmm_candidates(df: DataFrame, formulas: Sequence[str | Sequence[str]], group: str,
                   response: str | None = None, levels: Mapping[str, Sequence[str]] | None = None,
                   method: str = "REML", driver_cells: int = DRIVER_CELLS) -> list[LmmFit]:
    """Fit several fixed parts; the rows are read once for all of them."""
    parsed = [terms_of(f) for f in formulas]
    response = response or parsed[0][0]
    basis = basis_for(df, [t for _, t in parsed], levels)
    sums = stage(cell_sums(usable_rows(df, basis, response, group), basis, ["__group", "__cell"]))
    moments = collect_moments(sums, basis)
    entities = entity_sums(sums, basis)
    groups = group_sums(entities, basis.size + 1, driver_cells)
    fits = []
    for text, (_, terms) in zip(formulas, parsed):
        label = text if isinstance(text, str) else " + ".join(text)
        fits.append(LmmFit(df.sparkSession, basis, design(basis, terms), moments, groups, entities, response,
                           group, method, label).optimise())
    return fits


def compare_models(fits: Sequence[LmmFit]) -> DataFrame:
    """(model, AIC, best) of fitted candidates."""
    low = min(f.aic for f in fits)
    rows = [(f.formula, float(f.aic), bool(f.aic == low)) for f in fits]
    return fits[0].spark.createDataFrame(rows, "model string, aic double, best boolean")
