"""Multinomial-logit transition matrices: log odds against staying are linear in the covariate cells.

Everything here works on sums that a pass over the series returns (nine expected transitions and three expected
first states per cell), so its size is that of the formula, never that of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np

from shoalspark.models.design import terms_of

#: log odds never move further than this in one step
MOST = 5.0


@dataclass(frozen=True)
class LogitDesign:
    """Columns of the formula by covariate cell, and the moves (from, to; 0-based) that have coefficients."""

    names: tuple[str, ...]
    x: np.ndarray
    moves: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return len(self.moves) * len(self.names)


def design_of(cols: Sequence[str], cells: Sequence[Sequence[str]], formula: str | Sequence[str], allowed: np.ndarray,
              levels: Mapping[str, Sequence[str]] | None = None) -> LogitDesign:
    """Treatment contrasts of ``formula`` over the observed cells; the first level of each factor is its base.

    ``levels`` orders a factor's levels (sorted otherwise). A column that the earlier ones determine on the observed cells
    is left out. ``allowed`` is the 3 x 3 table of possible moves; staying must be possible.
    """
    if not np.all(np.diagonal(allowed)):
        raise ValueError("log odds are taken against staying, which must be possible in every state")
    order = {c: list((levels or {}).get(c, sorted({v[k] for v in cells}))) for k, c in enumerate(cols)}
    at = {c: k for k, c in enumerate(cols)}
    for c, known in order.items():
        unknown = {v[at[c]] for v in cells} - set(known)
        if unknown:
            raise ValueError(f"undeclared levels of {c}: {sorted(unknown)}")
    names, columns = [], []
    for term in [(), *terms_of(formula)[1]]:
        missing = [c for c in term if c not in at]
        if missing:
            raise ValueError(f"no covariate {missing[0]}")
        for chosen in product(*[order[c][1:] for c in term]):
            column = np.array([float(all(v[at[c]] == lv for c, lv in zip(term, chosen))) for v in cells])
            trial = np.column_stack([*columns, column])
            if np.linalg.matrix_rank(trial) == len(columns) + 1:
                columns.append(column)
                names.append(":".join(c + lv for c, lv in zip(term, chosen)) or "(Intercept)")
    moves = tuple((i, j) for i in range(3) for j in range(3) if i != j and allowed[i, j])
    return LogitDesign(tuple(names), np.column_stack(columns), moves)


def matrices(design: LogitDesign, beta: np.ndarray) -> np.ndarray:
    """Matrix per cell from coefficients (move, column)."""
    eta = np.full((len(design.x), 3, 3), -np.inf)
    eta[:, range(3), range(3)] = 0.0
    for m, (i, j) in enumerate(design.moves):
        eta[:, i, j] = design.x @ beta[m]
    p = np.exp(eta - eta.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def coefficients_of(design: LogitDesign, mats: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of given matrices with positive allowed entries."""
    odds = np.stack([np.log(mats[:, i, j] / mats[:, i, i]) for i, j in design.moves]) if design.moves else np.zeros((0, len(mats)))
    return np.linalg.lstsq(design.x, odds.T, rcond=None)[0].T


def stationary_laws(mats: np.ndarray) -> np.ndarray:
    """Stationary law per matrix, by the linear system that defines it."""
    a = np.eye(3) - mats + 1.0
    return np.linalg.solve(np.swapaxes(a, -1, -2), np.ones((len(mats), 3, 1)))[..., 0]


def start_pull(mats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gradient in the log odds of the expected log probability of the first states under the stationary law.

    A change dP moves the law d by d dP Z with Z the inverse of I - P + 1 d; rows sum to zero, so the result acts
    like additional expected transitions that leave their totals as they are.
    """
    law = stationary_laws(mats)
    z = np.linalg.inv(np.eye(3) - mats + law[:, None, :])
    ratio = np.where(starts > 0, starts / np.maximum(law, 1e-300), 0.0)
    g = law[:, :, None] * np.einsum("sjk,sk->sj", z, ratio)[:, None, :]
    return mats * (g - (mats * g).sum(axis=-1, keepdims=True))


def objective(mats: np.ndarray, counts: np.ndarray, starts: np.ndarray | None) -> float:
    """Expected log probability of the paths."""
    with np.errstate(divide="ignore"):
        value = np.where(counts > 0, counts * np.log(np.where(counts > 0, mats, 1.0)), 0.0).sum()
        if starts is not None:
            law = stationary_laws(mats)
            value += np.where(starts > 0, starts * np.log(np.where(starts > 0, np.maximum(law, 0.0), 1.0)), 0.0).sum()
    return float(value)


def score(design: LogitDesign, mats: np.ndarray, counts: np.ndarray, starts: np.ndarray | None) -> np.ndarray:
    """Gradient by coefficient (move, column). With counts expected under ``mats`` it is the likelihood's own."""
    gap = counts - counts.sum(axis=-1, keepdims=True) * mats
    if starts is not None:
        gap = gap + start_pull(mats, starts)
    return np.stack([design.x.T @ gap[:, i, j] for i, j in design.moves]) if design.moves else np.zeros((0, len(design.names)))


def curvature(design: LogitDesign, mats: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Information of complete paths, (move, column) by (move, column), from totals (cell, from)."""
    q = len(design.names)
    out = np.zeros((design.size, design.size))
    for a, (i, j) in enumerate(design.moves):
        for b, (i2, k) in enumerate(design.moves):
            if i == i2:
                w = totals[:, i] * mats[:, i, j] * ((j == k) - mats[:, i, k])
                out[a * q:(a + 1) * q, b * q:(b + 1) * q] = design.x.T @ (w[:, None] * design.x)
    return out


def ascend(design: LogitDesign, beta: np.ndarray, counts: np.ndarray, starts: np.ndarray | None, steps: int = 25,
           tol: float = 1e-10) -> np.ndarray:
    """Newton steps on the expected log probability, halved until it does not fall."""
    mats = matrices(design, beta)
    value = objective(mats, counts, starts)
    for _ in range(steps):
        gradient = score(design, mats, counts, starts).ravel()
        bend = curvature(design, mats, counts.sum(axis=-1))
        bend[np.diag_indices_from(bend)] += 1e-12 * (1 + np.trace(bend))
        move = np.linalg.solve(bend, gradient).reshape(beta.shape)
        furthest = np.abs(move @ design.x.T).max(initial=0.0)
        move *= min(1.0, MOST / furthest) if furthest > 0 else 1.0
        for _ in range(30):
            trial = matrices(design, beta + move)
            reached = objective(trial, counts, starts)
            if reached >= value:
                break
            move = move / 2
        else:
            return beta
        beta, mats, gain, value = beta + move, trial, reached - value, reached
        if gain <= tol * (1 + abs(value)):
            break
    return beta
