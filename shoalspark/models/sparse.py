"""Least squares over factors of many levels, from the cells that occur.

A design column is a term with the levels it stands for. A cell has one such column a term at most, so sums per observed cell
give the normal equations as (column, column, sum) rows; no list of levels and no product of levels is ever built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import special as S
from shoalspark.models.design import terms_of
from shoalspark.staging import small_side, stage


@dataclass
class SparseFit:
    """Coefficients of the columns ``table`` (``at, term, label``) with the upper triangular root of the normal equations."""

    table: DataFrame
    terms: list[tuple[str, ...]]
    term_of: np.ndarray
    root: np.ndarray
    effects: np.ndarray
    yy: float
    n: int

    @property
    def df_resid(self) -> int:
        return self.n - len(self.effects)

    @property
    def sigma2(self) -> float:
        return max(0.0, float(self.yy - self.effects @ self.effects)) / self.df_resid if self.df_resid > 0 else float("nan")

    def coef(self) -> DataFrame:
        """Estimate, SE, t, df and p per column; ``term`` is its label."""
        inverse = np.linalg.inv(self.root)
        beta = inverse @ self.effects
        se = np.sqrt(self.sigma2 * (inverse ** 2).sum(axis=1))
        known = (se > 0) & (self.df_resid > 0)
        t = np.where(known, beta / np.where(known, se, 1.0), 0.0)
        p = S.t_two_sided(t, self.df_resid) if known.any() else t
        rows = [(j, float(b), float(e) if e == e else None, float(v) if ok else None, self.df_resid, float(q) if ok else None)
                for j, (b, e, v, q, ok) in enumerate(zip(beta, se, t, p, known))]
        values = self.table.sparkSession.createDataFrame(rows, "at int, estimate double, se double, t double, df int, p double")
        return self.table.select("at", F.col("label").alias("term")).join(values, "at").drop("at")

    def anova(self) -> DataFrame:
        """Sequential F table: a term's sum of squares is that of its columns' effects."""
        rows = []
        for number, term in enumerate(self.terms, start=1):
            mine = self.effects[self.term_of == number]
            if len(mine):
                ss = float(mine @ mine)
                f = ss / len(mine) / self.sigma2 if self.sigma2 > 0 else None
                rows.append((":".join(term), len(mine), ss, f, float(S.f_sf(f, len(mine), self.df_resid)) if f is not None else None))
        rows.append(("Residuals", self.df_resid, self.sigma2 * self.df_resid, None, None))
        return self.table.sparkSession.createDataFrame(rows, "term string, df int, sum_sq double, f double, p double")


def _label(term: Sequence[str], factors: Mapping[str, str]) -> Column:
    """Name of a cell's column of a term, null where a factor is at its base level."""
    parts = [F.concat(F.lit(v), F.col(v)) if v in factors else F.lit(v) for v in term]
    name = F.concat_ws(":", *parts) if parts else F.lit("(Intercept)")
    inside = [v for v in term if v in factors]
    return F.when(reduce(Column.__and__, [F.col(v) != F.lit(factors[v]) for v in inside], F.lit(True)), name)


def _identity(term: Sequence[str], factors: Mapping[str, str], number: int) -> Column:
    """A key of the column that two different ones never share."""
    inside = [v for v in term if v in factors]
    return F.to_json(F.array(F.lit(str(number)), *[F.col(v) for v in inside]))


def sparse_ols(df: DataFrame, formula: str | Sequence[str], response: str | None = None,
               base: Mapping[str, str] | None = None, max_bytes: int = 1 << 28) -> SparseFit:
    """Least squares of ``y ~ terms`` in treatment coding; string columns are factors, all others covariates.

    ``base`` names base levels, else the smallest level is it. Level combinations that no row has are no columns. The system of p
    columns needs 8 p^2 bytes on the driver; more than ``max_bytes`` is an error that names p, found before anything is collected.
    Rows with a null in the model's columns are left out; a column that others determine is an error, and so is an empty table.
    """
    named, terms = terms_of(formula)
    response = response or named
    types = dict(df.dtypes)
    used = list(dict.fromkeys(v for t in terms for v in t))
    names = [v for v in used if types[v] == "string"]
    covs = [v for v in used if v not in names]
    rows = df.select(*names, *[F.col(v).cast("double").alias(v) for v in covs], F.col(response).cast("double").alias("__y")) \
        .dropna("any", subset=[*used, "__y"])
    monomials = list(dict.fromkeys([(), *[tuple(v for v in t if v not in names) for t in terms]]))
    value = [reduce(Column.__mul__, [F.col(v) for v in m], F.lit(1.0)) for m in monomials]
    pairs = [(a, b) for a in range(len(monomials)) for b in range(a, len(monomials))]
    cells = stage(rows.groupBy(*names).agg(
        F.count("*").alias("__n"), F.sum(F.col("__y") * F.col("__y")).alias("__yy"),
        *[F.sum(value[a] * value[b]).alias(f"__s{a}_{b}") for a, b in pairs],
        *[F.sum(v * F.col("__y")).alias(f"__sy{a}") for a, v in enumerate(value)]))
    whole = cells.agg(F.sum("__n"), F.sum("__yy"), *[F.min(v) for v in names]).first()
    if not whole[0]:
        raise ValueError("no complete row")
    factors = {v: (base or {}).get(v, least) for v, least in zip(names, whole[2:])}

    everything = [(), *terms]
    active = [F.when(_label(t, factors).isNotNull(), F.struct(
        F.lit(k).alias("term"), _label(t, factors).alias("label"), _identity(t, factors, k).alias("id"),
        F.lit(monomials.index(tuple(v for v in t if v not in names))).alias("m"))) for k, t in enumerate(everything)]
    listed = cells.select(F.explode(F.array_compact(F.array(*active))).alias("c")).select("c.*").groupBy("id").agg(
        F.first("term").alias("term"), F.first("label").alias("label"))
    listed = stage(listed)
    p = listed.count()
    if 8 * p * p > max_bytes:
        raise ValueError(f"{p} columns need {8 * p * p} bytes of normal equations, more than max_bytes = {max_bytes}")
    # p is bounded by now, so the columns can be numbered on the driver
    order = sorted((r["term"], r["id"], r["label"]) for r in listed.collect())
    numbered = df.sparkSession.createDataFrame([(i, t, label, key) for i, (t, key, label) in enumerate(order)],
                                               "at int, term int, label string, id string")
    number = small_side(numbered.select("at", "id"))

    # each cell's numbered columns, one per term that is away from its base
    flat = cells.withColumn("__cell", F.monotonically_increasing_id())
    for k, t in enumerate(everything):
        here = number.select(F.col("at").alias(f"__at{k}"), F.col("id").alias(f"__id{k}"))
        mine = F.when(_label(t, factors).isNotNull(), _identity(t, factors, k))
        flat = flat.withColumn(f"__key{k}", mine).join(here, F.col(f"__key{k}") == F.col(f"__id{k}"), "left")
    place = [monomials.index(tuple(v for v in t if v not in names)) for t in everything]
    entries = [F.struct(F.least(f"__at{a}", f"__at{b}").alias("i"), F.greatest(f"__at{a}", f"__at{b}").alias("j"),
                        F.col(f"__s{min(place[a], place[b])}_{max(place[a], place[b])}").alias("v"),
                        (F.col(f"__at{a}").isNotNull() & F.col(f"__at{b}").isNotNull()).alias("there"))
               for a in range(len(everything)) for b in range(a, len(everything))]
    entries += [F.struct(F.col(f"__at{a}").alias("i"), F.lit(p).alias("j"), F.col(f"__sy{place[a]}").alias("v"),
                         F.col(f"__at{a}").isNotNull().alias("there")) for a in range(len(everything))]
    summed = flat.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("there").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (summed[c].to_numpy() for c in ("i", "j", "v"))
    system, right = np.zeros((p, p)), np.zeros(p)
    right[i[j == p]] = v[j == p]
    inner = j < p
    system[i[inner], j[inner]] = v[inner]
    system[j[inner], i[inner]] = v[inner]
    scale = np.sqrt(np.diagonal(system))
    if not np.all(scale > 0):
        raise ValueError(f"column {order[int(np.argmin(scale))][2]} is zero in all rows")
    try:
        root = np.linalg.cholesky(system / scale[:, None] / scale[None, :]).T
    except np.linalg.LinAlgError:
        root = np.zeros((p, p))
    if np.diagonal(root).min() < 1e-6:
        raise ValueError(f"column {order[int(np.argmin(np.diagonal(root)))][2]} is determined by earlier ones")
    root = root * scale[None, :]
    return SparseFit(numbered, list(terms), np.array([t for t, *_ in order]), root, np.linalg.solve(root.T, right), float(whole[1]), int(whole[0]))
