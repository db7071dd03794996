"""Random entity intercepts on the log odds of hidden Markov transitions.

The log odds of a move against staying are a formula's value in the row's covariate cell plus an intercept of the entity,
normal around zero with a standard deviation per move. An entity's intercepts are found where its series lies, so a
round returns only sums over entities: scores and curvatures of the coefficients and of the variances.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalspark.models import hmm as H
from shoalspark.models import logits as L
from shoalspark.staging import stage

#: half the distance of the central differences that give an entity's observed information
SHIFT = 1e-3


@dataclass(frozen=True)
class Law:
    """What a task must know: the formula's coefficients (move, column), a standard deviation per move, the start law."""

    design: L.LogitDesign
    beta: np.ndarray
    sd: np.ndarray
    initial: object
    shapes: tuple

    @property
    def precision(self) -> np.ndarray:
        return self.sd ** -2

    def stack(self, modes: np.ndarray) -> np.ndarray:
        """Matrices (entity, cell, 3, 3) under intercepts (entity, move)."""
        eta = np.full((len(modes), len(self.design.x), 3, 3), -np.inf)
        eta[..., range(3), range(3)] = 0.0
        fixed = self.design.x @ self.beta.T
        for m, (i, j) in enumerate(self.design.moves):
            eta[..., i, j] = fixed[None, :, m] + modes[:, None, m]
        p = np.exp(eta - eta.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def flat(self, modes: np.ndarray, s: np.ndarray):
        """Matrices and start laws of all entities one after the other, and ``s`` pointing into them."""
        mats = self.stack(modes)
        n, k = mats.shape[:2]
        flat = mats.reshape(n * k, 3, 3)
        return s + k * np.arange(n)[:, None], flat, H._start_law(flat, self.initial)


def _expected(law: Law, modes, x, s, lens, at=None, behind=None):
    """Expected transitions (entity, cell, 3, 3), first states (entity, cell, 3) and log-likelihoods."""
    where, mats, delta = law.flat(modes, s)
    k = len(law.design.x)
    counts, first, ll = H._expected_counts(x, where, lens, mats, delta, law.shapes, at, behind, cells=k)
    starts = np.zeros((len(modes), k, 3))
    starts[np.arange(len(modes)), s[:, 0]] = first
    return counts, starts, ll


def _gap(law: Law, mats, counts, starts):
    """Gradient of the expected log probability in the log odds, (entity, cell, move)."""
    gap = counts - counts.sum(axis=-1, keepdims=True) * mats
    if law.initial == "stationary":
        gap = gap + L.start_pull(mats.reshape(-1, 3, 3), starts.reshape(-1, 3)).reshape(gap.shape)
    return np.stack([gap[..., i, j] for i, j in law.design.moves], axis=-1)


def _bend(law: Law, mats, counts):
    """Information of complete paths on the log odds, (entity, cell, move, move)."""
    moves = law.design.moves
    totals = counts.sum(axis=-1)
    out = np.zeros((*mats.shape[:2], len(moves), len(moves)))
    for a, (i, j) in enumerate(moves):
        for b, (i2, k) in enumerate(moves):
            if i == i2:
                out[..., a, b] = totals[..., i] * mats[..., i, j] * ((j == k) - mats[..., i, k])
    return out


def _penalised(law: Law, modes, counts, starts):
    """Expected log probability with the intercepts' penalty, by entity."""
    mats = law.stack(modes)
    value = np.where(counts > 0, counts * np.log(np.where(counts > 0, mats, 1.0)), 0.0).sum(axis=(1, 2, 3))
    if law.initial == "stationary":
        start = L.stationary_laws(mats.reshape(-1, 3, 3)).reshape(starts.shape)
        value = value + np.where(starts > 0, starts * np.log(np.where(starts > 0, np.maximum(start, 1e-300), 1.0)), 0.0).sum(axis=(1, 2))
    return value - 0.5 * (modes ** 2 * law.precision).sum(axis=1)


def step(law: Law, modes, counts, starts):
    """One Newton step of each entity's intercepts on the penalised expected log probability, halved until that does not fall."""
    mats = law.stack(modes)
    slope = _gap(law, mats, counts, starts).sum(axis=1) - modes * law.precision
    move = np.linalg.solve(_bend(law, mats, counts).sum(axis=1) + np.diag(law.precision), slope[..., None])[..., 0]
    move *= np.minimum(1.0, L.MOST / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
    before = _penalised(law, modes, counts, starts)
    for _ in range(30):
        worse = _penalised(law, modes + move, counts, starts) < before - 1e-12 * (1 + np.abs(before))
        if not worse.any():
            break
        move = np.where(worse[:, None], move / 2, move)
    else:
        move = np.where(worse[:, None], 0.0, move)
    return modes + move


def _shifts(size: int) -> np.ndarray:
    """Offsets of the intercepts at which gradients are taken: none, then up and down by move."""
    return np.concatenate([np.zeros((1, size)), *[np.stack([e, -e]) * SHIFT for e in np.eye(size)]])


def _spread(law: Law, slopes):
    """Covariance of each entity's intercepts given its series, and log determinant of its inverse, from shifted slopes."""
    info = -(slopes[1::2] - slopes[2::2]) / (2 * SHIFT)  # (move, entity, move)
    info = np.moveaxis(info, 0, 1)
    values, vectors = np.linalg.eigh((info + np.swapaxes(info, 1, 2)) / 2 + np.diag(law.precision))
    values = np.maximum(values, 1e-3 * law.precision.min())
    return np.einsum("nij,nj,nkj->nik", vectors, 1 / values, vectors), np.log(values).sum(axis=1)


def _terms(law: Law, modes, counts, starts, ll, slopes):
    """An entity's share of all sums: score and curvature of the coefficients with its intercepts eliminated, twice
    the score and the information of the logarithms of the variances, Laplace's log-likelihood; also the standard errors of its intercepts."""
    x, m, q = law.design.x, len(law.design.moves), len(law.design.names)
    n = len(modes)
    mats = law.stack(modes)
    gap, bend = _gap(law, mats, counts, starts), _bend(law, mats, counts)
    own = np.linalg.inv(bend.sum(axis=1) + np.diag(law.precision))
    cross = np.einsum("kc,nkab->nacb", x, bend).reshape(n, m * q, m)
    slope = gap.sum(axis=1) - modes * law.precision
    score = np.einsum("kc,nka->nac", x, gap).reshape(n, m * q) - np.einsum("nab,nbc,nc->na", cross, own, slope)
    full = np.einsum("kc,kd,nkab->nacbd", x, x, bend, optimize=True).reshape(n, m * q, m * q)
    curve = full - np.einsum("nab,nbc,ndc->nad", cross, own, cross, optimize=True)
    spread, logdet = _spread(law, slopes)
    variance = np.diagonal(spread, axis1=1, axis2=2)
    laplace = ll - 0.5 * (modes ** 2 * law.precision).sum(axis=1) + 0.5 * np.log(law.precision).sum() - 0.5 * logdet
    stats = np.concatenate([score, curve.reshape(n, -1), (modes ** 2 + variance) * law.precision - 1, (1 - variance * law.precision) ** 2,
                            laplace[:, None], np.ones((n, 1))], axis=1)
    return stats, np.sqrt(variance)


def _solve(law: Law, x, s, lens, most: int, tol: float):
    """Intercepts of a block of whole series, their standard errors and shares of the sums, and how far the last step went."""
    modes, far = np.zeros((len(lens), len(law.design.moves))), np.full(len(lens), np.inf)
    for _ in range(most):
        counts, starts, _ = _expected(law, modes, x, s, lens)
        moved = step(law, modes, counts, starts)
        far, modes = np.abs(moved - modes).max(axis=1), moved
        if far.max() <= tol:
            break
    seen = [_expected(law, modes + o, x, s, lens) for o in _shifts(modes.shape[1])]
    slopes = np.stack([_gap(law, law.stack(modes + o), c, st).sum(axis=1) for o, (c, st, _) in zip(_shifts(modes.shape[1]), seen)])
    stats, se = _terms(law, modes, *seen[0], slopes)
    return modes, se, stats, far


# --- passes over the series


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of short arrays ``v``, added up in the tasks first."""
    def run(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf["v"].to_numpy()).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in rows.select("v").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _whole(seqs: DataFrame, law: Law, most: int, tol: float, output: str) -> DataFrame:
    """Entities in one piece: ``sums`` of a task as one array ``v``, or ``modes`` as ``key, b, se, far``."""
    none = F.lit(None).cast("array<double>")
    rows = seqs.where("not cut").select("__key", "x", "s", none.alias("at"), none.alias("behind"))

    def sums(batches):
        for pdf in batches:
            for _, (x, s, lens), _ in H._blocks(pdf):
                *_, stats, far = _solve(law, x, s, lens, most, tol)
                yield pd.DataFrame({"v": [np.append(stats.sum(axis=0), (far > tol).sum())]})

    def modes(batches):
        for pdf in batches:
            for part, (x, s, lens), _ in H._blocks(pdf):
                b, se, _, far = _solve(law, x, s, lens, most, tol)
                yield pd.DataFrame({"key": part["__key"].to_numpy(), "b": list(b), "se": list(se), "far": far})

    return rows.mapInPandas(sums, "v array<double>") if output == "sums" else rows.mapInPandas(modes, MODES)


MODES = "key string, b array<double>, se array<double>, far double"


def _pieced(pieces: DataFrame, table: DataFrame, law: Law) -> DataFrame:
    """One step of the intercepts of entities in several pieces: ``key, b`` with the new ones, and at the old ones ``se`` and ``v``.

    Each piece becomes one 3 x 3 product per shift, these are chained by entity, and every piece is worked on again
    between its bounds. An entity's pieces meet as sums only, a few hundred numbers a piece, in one sorted stream.
    """
    size, k = len(law.design.moves), len(law.design.x)
    shifts = _shifts(size)
    width = 12 * k + 1
    given = pieces.join(table.select(F.col("key").alias("__key"), "b"), "__key")

    def products(batches):
        for pdf in batches:
            for part, (x, s, lens), b in blocks(pdf):
                for w, o in enumerate(shifts):
                    where, mats, delta = law.flat(b + o, s)
                    m = H._product(x, where, lens, mats, delta, law.shapes, False)
                    yield pd.DataFrame({"key": [f"{w}:{v}" for v in part["__key"]], "piece": part["piece"].to_numpy(), "m": list(m.reshape(-1, 12))})

    def blocks(pdf):
        order = np.argsort([len(v) for v in pdf["x"]], kind="stable")
        for lo in range(0, len(order), H.BLOCK):
            part = pdf.iloc[order[lo:lo + H.BLOCK]]
            yield part, H._pad(part["x"].to_numpy(), part["s"].to_numpy()), np.stack(part["b"].to_numpy()).astype(float)

    def counted(batches):
        for pdf in batches:
            for part, (x, s, lens), b in blocks(pdf):
                bounds = [[H._given([a[w][side] for a in part["around"]]) for side in ("at", "behind")] for w in range(len(shifts))]
                sums = [_expected(law, b + o, x, s, lens, *bound) for o, bound in zip(shifts, bounds)]
                v = np.concatenate([np.concatenate([c.reshape(len(b), -1), st.reshape(len(b), -1), ll[:, None]], axis=1) for c, st, ll in sums], axis=1)
                yield pd.DataFrame({"key": part["__key"].to_numpy(), "piece": part["piece"].to_numpy(), "b": list(b), "v": list(v)})

    def stepped(batches):
        held: list = []  # key, intercepts, sums so far

        def told():
            b = held[1][None]
            parts = held[2].reshape(len(shifts), width)
            seen = [(p[:9 * k].reshape(1, k, 3, 3), p[9 * k:-1].reshape(1, k, 3), p[-1:]) for p in parts]
            slopes = np.stack([_gap(law, law.stack(b + o), c, st).sum(axis=1) for o, (c, st, _) in zip(shifts, seen)])
            stats, se = _terms(law, b, *seen[0], slopes)
            new = step(law, b, *seen[0][:2])
            far = float(np.abs(new - b).max())
            return pd.DataFrame({"key": [held[0]], "b": [new[0]], "se": [se[0]], "far": [far], "v": [np.append(stats[0], 0.0)]})
        for pdf in batches:
            for key, b, v in zip(pdf["key"], pdf["b"], pdf["v"]):
                if held and held[0] != key:
                    yield told()
                    held = []
                if not held:
                    held = [key, np.asarray(b, dtype=float), np.zeros(len(shifts) * width)]
                held[2] = held[2] + np.asarray(v, dtype=float)
        if held:
            yield told()

    maps = given.select("__key", "piece", "x", "s", "b").mapInPandas(products, "key string, piece bigint, m array<double>")
    chain = H._chained(maps)
    around = chain.select(F.substring_index("key", ":", 1).cast("int").alias("w"), F.expr("substring(key, instr(key, ':') + 1)").alias("__key"),
                          "piece", "at", "behind") \
        .groupBy("__key", "piece").agg(F.array_sort(F.collect_list(F.struct("w", "at", "behind"))).alias("around"))
    sums = given.join(stage(around), ["__key", "piece"]).select("__key", "piece", "x", "s", "b", "around") \
        .mapInPandas(counted, "key string, piece bigint, b array<double>, v array<double>")
    return stage(sums.repartition("key").sortWithinPartitions("key", "piece").mapInPandas(stepped, MODES + ", v array<double>"))


# --- the fit


@dataclass
class EffectFit:
    """Coefficients, standard deviations and, by entity, intercepts (``modes_by_key``) of a fitted model."""

    seqs: DataFrame
    entity: tuple[str, ...]
    strata: H.Strata
    law: Law
    modes_by_key: DataFrame
    trace: list[float]
    converged: bool

    def _rows(self, rows, schema):
        return self.seqs.sparkSession.createDataFrame(rows, schema)

    def summary(self) -> DataFrame:
        return self._rows([(i + 1, v, self.converged) for i, v in enumerate(self.trace)], "round int, loglik double, converged boolean")

    def coefficients(self) -> DataFrame:
        """(from, to, term, estimate) of the log odds against staying."""
        return self._rows([(f"state{i + 1}", f"state{j + 1}", name, float(v)) for (i, j), row in zip(self.law.design.moves, self.law.beta)
                           for name, v in zip(self.law.design.names, row)], "`from` string, `to` string, term string, estimate double")

    def deviations(self) -> DataFrame:
        """(from, to, sd): how far entities scatter, by move."""
        return self._rows([(f"state{i + 1}", f"state{j + 1}", float(v)) for (i, j), v in zip(self.law.design.moves, self.law.sd)],
                          "`from` string, `to` string, sd double")

    def _named(self) -> DataFrame:
        names = self.seqs.where("piece = first_piece").select("__key", *self.entity)
        return names.join(self.modes_by_key.withColumnRenamed("key", "__key"), "__key")

    def effects(self) -> DataFrame:
        """(entity, from, to, effect, se): intercepts and their standard errors given the coefficients."""
        moves = F.array(*[F.struct(F.lit(f"state{i + 1}").alias("from"), F.lit(f"state{j + 1}").alias("to")) for i, j in self.law.design.moves])
        rows = self._named().select(*self.entity, F.explode(F.arrays_zip(moves.alias("move"), "b", "se")).alias("q"))
        return rows.select(*self.entity, F.col("q.move.from").alias("from"), F.col("q.move.to").alias("to"), F.col("q.b").alias("effect"), F.col("q.se").alias("se"))

    def transitions(self) -> DataFrame:
        """(entity, covariates, p): the matrix of every entity in each covariate cell it was seen in."""
        cells = self.seqs.select("__key", F.explode(F.array_distinct("s")).alias("s")).distinct()
        fixed = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.law.design.x @ self.law.beta.T])[F.col("s")]
        moves = {m: n for n, m in enumerate(self.law.design.moves)}
        odds = [[F.lit(1.0) if i == j else F.exp(fixed[moves[i, j]] + F.col("b")[moves[i, j]]) if (i, j) in moves else F.lit(0.0)
                 for j in range(3)] for i in range(3)]
        p = F.array(*[F.array(*[v / (row[0] + row[1] + row[2]) for v in row]) for row in odds])
        rows = self._named().join(cells, "__key").select(*self.entity, "s", p.alias("p"))
        extra = [F.array(*[F.lit(lv[i]) for lv in self.strata.levels])[F.col("s")].alias(c)
                 for i, c in enumerate(self.strata.cols) if c not in self.entity]
        return rows.select(*self.entity, *extra, "p")


def keyed(seqs: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Packed series with one text key an entity and its first piece, staged."""
    out = seqs.withColumn("__key", F.to_json(F.struct(*entity)))
    first = out.groupBy("__key").agg(F.min("piece").alias("first_piece"))
    return stage(out.join(first, "__key"))


def _evaluate(seqs: DataFrame, cut: bool, law: Law, table: DataFrame | None, most: int, tol: float) -> tuple[np.ndarray, DataFrame | None]:
    size = law.design.size + law.design.size ** 2 + 2 * len(law.design.moves) + 2 + 1
    if not cut:
        return _sums(_whole(seqs, law, most, tol, "sums"), size), None
    told = _pieced(seqs.where("cut"), table, law)
    return _sums(_whole(seqs, law, most, tol, "sums").unionByName(told.select("v")), size), told


def fit_effects(df: DataFrame, entity: Sequence[str], value: str, strata_cols: Sequence[str], formula: str | Sequence[str],
                start=H.START, zeros: Sequence[tuple[int, int]] = (), shapes=H.SHAPES, levels: Mapping[str, Sequence[str]] | None = None,
                sd: float = 0.5, max_iter: int = 200, tol: float = 1e-7, initial="stationary", time: str = "time", strict: bool = True,
                inner: int = 100, inner_tol: float = 1e-5, piece_steps: int = 8192) -> EffectFit:
    """Log odds of the moves as a formula plus normal entity intercepts, emissions fixed.

    A round finds every entity's intercepts at the present coefficients (penalised likelihood, Newton steps on expected counts),
    then moves the coefficients by a Newton step with the intercepts eliminated, and the variances by a scoring step towards the mean of squared
    intercept plus its variance given the series (from the observed information); the latter is bounded, and by half as much after a round that lost
    likelihood. Entities in several pieces keep their intercepts in a table and
    take one step a round. Rounds end when Laplace's log-likelihood, logged in ``trace``, changes by less than ``tol`` relatively;
    not getting there in ``max_iter`` rounds, or an entity still moving by over ``inner_tol`` after ``inner`` steps, is an error unless
    ``strict`` is off. The coefficients maximise the penalised likelihood jointly with the intercepts, which is close to Laplace's own
    maximum when series are long. ``zeros`` are (from, to) pairs that stay impossible; a variance cannot fall below 1e-8.
    """
    rows = stage(df.select(*dict.fromkeys([*entity, *strata_cols, time, value])))
    strata = H.strata_of(rows, strata_cols)
    seqs = keyed(H.sequences(rows, entity, value, strata, time, piece_steps), entity)
    cut = not seqs.where("cut").isEmpty()
    mats = H._matrices(start, strata).copy()
    for i, j in zeros:
        mats[:, i - 1, j - 1] = 0.0
    mats = mats / mats.sum(axis=-1, keepdims=True)
    design = L.design_of(strata.cols, strata.levels, formula, (mats > 0).all(axis=0), levels)
    m, q = len(design.moves), len(design.names)
    if not m:
        raise ValueError("no move is possible, so there is nothing to fit")
    law = Law(design, L.coefficients_of(design, mats), np.full(m, float(sd)), initial, tuple(shapes))
    table = seqs.where("cut and piece = first_piece").select(F.col("__key").alias("key"), F.array(*[F.lit(0.0)] * m).alias("b")) if cut else None
    trace, converged, reached, limit = [], False, law, 1.0
    while not converged and len(trace) < max_iter:
        total, told = _evaluate(seqs, cut, law, table, inner, inner_tol)
        score, curve = total[:m * q], total[m * q:m * q + (m * q) ** 2].reshape(m * q, m * q)
        (pull, weight), (value_now, _, stuck) = total[-3 - 2 * m:-3].reshape(2, m), total[-3:]
        if strict and stuck:
            raise RuntimeError(f"intercepts of {int(stuck)} entities still move after {inner} steps; raise inner or inner_tol")
        reached, trace = law, [*trace, float(value_now)]
        far = told.agg(F.max("far")).first()[0] if cut else 0.0
        converged = len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol * (1 + abs(trace[-1])) and far <= max(inner_tol, 1e-3)
        table = told.select("key", "b") if cut else None
        curve = (curve + curve.T) / 2
        curve[np.diag_indices_from(curve)] += 1e-10 * (1 + np.trace(curve))
        move = np.linalg.solve(curve, score).reshape(m, q)
        furthest = np.abs(design.x @ move.T).max()
        move *= min(1.0, 1.0 / furthest) if furthest > 0 else 1.0
        if len(trace) > 1 and trace[-1] < trace[-2]:
            limit /= 2
        if not converged:
            wider = np.clip(pull / np.maximum(weight, 1e-12), -limit, limit)
            law = Law(design, law.beta + move, np.sqrt(np.maximum(law.sd ** 2 * np.exp(wider), 1e-8)), initial, tuple(shapes))
    if strict and not converged:
        raise RuntimeError(f"no convergence in {max_iter} rounds; raise max_iter or tol, or pass strict=False")
    found = _whole(seqs, reached, inner, inner_tol, "modes")
    if cut:
        found = found.unionByName(told.select("key", "b", "se", "far"))
    return EffectFit(seqs, tuple(entity), strata, reached, stage(found), trace, converged)


def one_step(seqs: DataFrame, entity: Sequence[str], tpm, strata: H.Strata, sd: float, shapes=H.SHAPES) -> DataFrame:
    """(entity, from, to, effect): intercepts after one Newton step from zero under one matrix for all cells and a uniform start law."""
    mats = H._matrices(tpm, strata)
    design = L.design_of(strata.cols, strata.levels, [], (mats > 0).all(axis=0))
    law = Law(design, L.coefficients_of(design, mats), np.full(len(design.moves), float(sd)), "uniform", tuple(shapes))
    packed = H.expected_counts(seqs, entity, mats, strata, "uniform", shapes).groupBy(*entity) \
        .agg(F.array(*[F.sum(F.col("c")[i]) for i in range(9)]).alias("c"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                counts = np.zeros((len(pdf), len(mats), 3, 3))
                counts[:, 0] = np.stack(pdf["c"].to_numpy()).reshape(-1, 3, 3)
                b = step(law, np.zeros((len(pdf), len(design.moves))), counts, np.zeros((len(pdf), len(mats), 3)))
                for m, (i, j) in enumerate(design.moves):
                    yield pdf[list(entity)].assign(**{"from": f"state{i + 1}", "to": f"state{j + 1}", "effect": b[:, m]})

    schema = T.StructType([*H._fields(seqs, entity), T.StructField("from", T.StringType()), T.StructField("to", T.StringType()),
                           T.StructField("effect", T.DoubleType())])
    return packed.mapInPandas(run, schema)
