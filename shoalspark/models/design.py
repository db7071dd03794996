"""Fixed-effect designs over factors and covariates, and their sufficient statistics.

A row's design vector depends on its factor cell and, inside a cell, linearly on a few products
of covariates. So sums of those products per (entity, cell), one combined aggregate over the
rows, determine every fit, and nested candidate models share them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions.expr import level_index

def terms_of(formula: str | Sequence[str]) -> tuple[str | None, list[tuple[str, ...]]]:
    """(response, terms) of ``y ~ a*b + z`` or of a list like ``["a", "z", "a:z"]``.

    Terms come in the usual order: by degree, then as written.
    """
    response, pieces = None, formula
    if isinstance(formula, str):
        text = re.sub(r"\s", "", formula)
        if "~" in text:
            response, text = text.split("~")
        pieces = text.split("+")
    found: list[tuple[str, ...]] = []
    for piece in pieces:
        names = piece.split("*")
        for k in range(1, len(names) + 1):
            for combo in combinations(names, k):
                term = tuple(dict.fromkeys(v for name in combo for v in name.split(":")))
                if term not in found:
                    found.append(term)
    return response, sorted(found, key=len)


@dataclass(frozen=True)
class Basis:
    """Cells and covariate products that all candidate designs are columns over."""

    factors: dict[str, list[str]]
    monomials: list[tuple[str, ...]]

    @property
    def cells(self) -> list[tuple[int, ...]]:
        return list(product(*[range(len(v)) for v in self.factors.values()]))

    @property
    def size(self) -> int:
        return len(self.cells) * len(self.monomials)

    def cell_column(self) -> Column:
        """Cell number of a row, null when a factor is null; an undeclared value is an error."""
        index = F.lit(0)
        for name, levels in self.factors.items():
            at = level_index(name, levels)
            unknown = F.raise_error(F.concat(F.lit(f"undeclared level of {name}: "), F.col(name).cast("string"))).cast("int")
            index = index * len(levels) + F.when(F.col(name).isNotNull() & at.isNull(), unknown).otherwise(at)
        return index

    def monomial_columns(self) -> list[Column]:
        return [reduce(lambda a, b: a * b, [F.col(v).cast("double") for v in m], F.lit(1.0))
                for m in self.monomials]

    def vector(self, cell: tuple[int, ...], covariates: Mapping[str, float]) -> np.ndarray:
        out = np.zeros((len(self.cells), len(self.monomials)))
        out[self.cells.index(cell)] = [np.prod([covariates[v] for v in m]) for m in self.monomials]
        return out.ravel()


def basis_for(df: DataFrame, term_lists: Sequence[Sequence[tuple[str, ...]]],
              levels: Mapping[str, Sequence[str]] | None = None) -> Basis:
    """Factors are the string columns; undeclared level lists are read from the data."""
    levels = dict(levels or {})
    types = dict(df.dtypes)
    names = list(dict.fromkeys(v for terms in term_lists for t in terms for v in t))
    factors: dict[str, list[str]] = {}
    for name in names:
        if name in levels:
            factors[name] = list(levels[name])
        elif types[name] == "string":
            # one row per level; a model has a coefficient for each
            seen = df.select(name).where(F.col(name).isNotNull()).distinct().collect()
            factors[name] = sorted(r[0] for r in seen)
    monomials: list[tuple[str, ...]] = [()]
    for terms in term_lists:
        for t in terms:
            m = tuple(v for v in t if v not in factors)
            if m not in monomials:
                monomials.append(m)
    return Basis(factors, monomials)


@dataclass(frozen=True)
class Design:
    """Columns of one model as combinations of the basis (``matrix`` is basis size by p)."""

    terms: list[tuple[str, ...]]
    names: list[str]
    term_of: list[int]
    matrix: np.ndarray

    @property
    def p(self) -> int:
        return len(self.names)


def design(basis: Basis, terms: Sequence[tuple[str, ...]], coding: str = "treatment") -> Design:
    """Treatment coding (first level is the reference) or sum-to-zero coding."""
    terms = list(terms)
    for t in terms:
        for k in range(1, len(t)):
            for sub in combinations(t, k):
                if not any(set(sub) == set(u) for u in terms):
                    raise ValueError(f"term {':'.join(t)} needs {':'.join(sub)} in the model")
    names, term_of, columns = ["(Intercept)"], [0], [_column(basis, {}, (), coding)]
    for number, t in enumerate(terms, start=1):
        inside = [v for v in t if v in basis.factors]
        covs = tuple(v for v in t if v not in basis.factors)
        # the first factor's level varies fastest, as in the usual model matrix
        for picks in product(*[range(1, len(basis.factors[f])) for f in reversed(inside)]):
            choice = dict(zip(reversed(inside), picks))
            label = ":".join(f"{v}{basis.factors[v][choice[v]]}" if v in choice else v for v in t)
            names.append(label)
            term_of.append(number)
            columns.append(_column(basis, choice, covs, coding))
    return Design(terms, names, term_of, np.column_stack(columns))


def _column(basis: Basis, choice: Mapping[str, int], covs: tuple[str, ...], coding: str) -> np.ndarray:
    out = np.zeros((len(basis.cells), len(basis.monomials)))
    at = basis.monomials.index(covs)
    order = list(basis.factors)
    for row, cell in enumerate(basis.cells):
        weight = 1.0
        for name, pick in choice.items():
            level = cell[order.index(name)]
            if coding == "treatment":
                weight *= 1.0 if level == pick else 0.0
            else:  # sum-to-zero: the last level is minus all others
                last = len(basis.factors[name]) - 1
                weight *= -1.0 if level == last else (1.0 if level == pick - 1 else 0.0)
        out[row, at] = weight
    return out.ravel()


def usable_rows(df: DataFrame, basis: Basis, response: str, group: str | None = None) -> DataFrame:
    """Rows without a null in the model's columns as (group, cell, monomials, y)."""
    covs = sorted({v for m in basis.monomials for v in m})
    rows = df.where(F.col(response).isNotNull())
    for c in covs:
        rows = rows.where(F.col(c).isNotNull())
    picked = [basis.cell_column().alias("__cell"), F.col(response).cast("double").alias("__y"),
              *[m.alias(f"__m{i}") for i, m in enumerate(basis.monomial_columns())]]
    if group is not None:
        rows = rows.where(F.col(group).isNotNull())
        picked.insert(0, F.col(group).alias("__group"))
    return rows.select(*picked).where(F.col("__cell").isNotNull())


def cell_sums(rows: DataFrame, basis: Basis, by: Sequence[str]) -> DataFrame:
    """Sums of monomial products, of monomial times y and of y squared, per ``by``."""
    k = len(basis.monomials)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    return rows.groupBy(*by).agg(
        *[F.sum(F.col(f"__m{a}") * F.col(f"__m{b}")).alias(f"__s{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(f"__m{a}") * F.col("__y")).alias(f"__sy{a}") for a in range(k)],
        F.sum(F.col("__y") * F.col("__y")).alias("__syy"))


@dataclass(frozen=True)
class Moments:
    """Whole-table sums: Z'Z, Z'y, y'y and N for the basis Z."""

    zz: np.ndarray
    zy: np.ndarray
    yy: float
    n: float


def collect_moments(sums: DataFrame, basis: Basis) -> Moments:
    """Add the sums up per cell; one row per factor cell reaches the driver."""
    numeric = [c for c in sums.columns if c.startswith("__s")]
    total = sums.groupBy("__cell").agg(*[F.sum(c).alias(c) for c in numeric]).collect()
    k = len(basis.monomials)
    zz, zy, yy, n = np.zeros((basis.size, basis.size)), np.zeros(basis.size), 0.0, 0.0
    for row in total:
        lo = row["__cell"] * k
        for a in range(k):
            zy[lo + a] = row[f"__sy{a}"]
            for b in range(a, k):
                zz[lo + a, lo + b] = zz[lo + b, lo + a] = row[f"__s{a}_{b}"]
        yy += row["__syy"]
        n += row["__s0_0"]
    return Moments(zz, zy, yy, n)


def linear_form(basis: Basis, weights: np.ndarray) -> Column:
    """Row-wise ``z . weights`` as a column expression (for fitted values and scoring)."""
    per_cell = weights.reshape(len(basis.cells), len(basis.monomials))
    monomials = basis.monomial_columns()
    cell = basis.cell_column()
    total = None
    for j, m in enumerate(monomials):
        lookup = F.array(*[F.lit(float(v)) for v in per_cell[:, j]])
        piece = F.get(lookup, cell) * m
        total = piece if total is None else total + piece
    return total
