"""Three-state hidden Markov models with beta observations on regular series.

Sequences are packed in time order inside the JVM, one row per entity unless it is longer than a piece. The
recursions run over all rows of an Arrow batch at once; pieces of a long entity first become one 3 x 3 product
each, these few are chained, and every piece is then worked on between what bounds it. Only expected counts per stratum
(a 3 x 3 table for each) return to the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalspark.functions import special as S
from shoalspark.functions.expr import beta_log_density, second_bucket, shape_to_prec, stationary3
from shoalspark.models import logits as L
from shoalspark.operators.reshape import flag_pairs, matrix_long, params_wide, tidy_param_names
from shoalspark.operators.summary import median_qi, poisson_weights
from shoalspark.staging import shuffle_partitions, small_side, stage

# fixed values: state shapes, names and starting transitions of the behaviour model
SHAPES = ((3.0, 10.0), (200.0, 200.0), (10.0, 3.0))
STATE_NAMES = ("Repoussé", "Indifférent", "Attiré")
START = ((0.8, 0.1, 0.1), (0.1, 0.8, 0.1), (0.1, 0.1, 0.8))
START_NEIGHBOURS = ((0.8, 0.2, 0.0), (0.1, 0.8, 0.1), (0.0, 0.2, 0.8))

BLOCK = 512
STRETCH = 4096
EPS = 1e-9


# --- series and emission columns


def series(df: DataFrame, entity: Sequence[str], values: Mapping[str, str], by: Sequence[str] = ("part",),
           secs: str = "secs", width: float = 1.0, na_rm: bool = True) -> DataFrame:
    """One row per (entity, bucket): mean of each value, incomplete rows dropped, ``time`` = 1..n.

    With ``na_rm=False`` one missing frame makes its whole bucket missing. Dropped buckets close up. Buckets are numbered inside
    stretches of ``STRETCH`` and the stretches' counts summed up, so no task holds an entity; buckets shared by several
    ``by`` follow their order.
    """
    def mean(c: str) -> Column:
        avg = F.avg(c)
        return avg if na_rm else F.when(F.count(c) == F.count("*"), avg)

    means = df.groupBy(*entity, *by, second_bucket(secs, width).alias("secs")) \
        .agg(*[mean(c).alias(name) for name, c in values.items()]).dropna("any")
    row = F.struct("secs", *by, *values)
    packed = stage(means.groupBy(*entity, F.floor(F.col("secs") / STRETCH).cast("bigint").alias("__stretch"))
                   .agg(F.array_sort(F.collect_list(row)).alias("__rows")).withColumn("__n", F.size("__rows")))
    earlier = Window.partitionBy(*entity).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = small_side(packed.select(*entity, "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    rows = packed.join(first, [*entity, "__stretch"]).select(*entity, "__before", F.posexplode("__rows").alias("__at", "__row"))
    return rows.select(*entity, *[F.col(f"__row.{c}").alias(c) for c in (*by, "secs", *values)],
                       (F.col("__before") + F.col("__at") + 1).cast("int").alias("time"))


def emission(df: DataFrame, value: str, shapes: Sequence[tuple[float, float]] = SHAPES) -> DataFrame:
    """Log density of every state as columns ``log_b1 ...``."""
    return df.withColumns({f"log_b{i + 1}": beta_log_density(value, a, b) for i, (a, b) in enumerate(shapes)})


def nearest_state(shapes: Sequence[tuple[float, float]] = SHAPES) -> Column:
    """State with the largest density, the lowest one on ties; needs the ``emission`` columns."""
    best = F.greatest(*[F.col(f"log_b{i + 1}") for i in range(len(shapes))])
    out = F.when(F.col("log_b1") == best, 1)
    for i in range(1, len(shapes)):
        out = out.when(F.col(f"log_b{i + 1}") == best, i + 1)
    return out


# --- packing


@dataclass(frozen=True)
class Strata:
    """Combinations of covariate levels with a transition matrix of their own."""

    cols: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]

    def index(self) -> Column:
        """0-based number of a row's combination; any other combination is an error."""
        here = F.concat_ws("\u0001", *self.cols) if self.cols else F.lit("")
        labels = F.array(*[F.lit("\u0001".join(v)) for v in self.levels])
        at = F.array_position(labels, here)
        unknown = F.raise_error(F.concat(F.lit("undeclared covariate cell: "), here)).cast("bigint")
        return F.when(at > 0, at - 1).otherwise(unknown).cast("int")

    def frame(self, spark, extra: Sequence[tuple], schema: str) -> DataFrame:
        head = "".join(f"`{c}` string, " for c in self.cols)
        rows = [(*self.levels[s], *rest) for s, *rest in extra]
        return spark.createDataFrame(rows, head + schema)


def strata_of(df: DataFrame, cols: Sequence[str]) -> Strata:
    """The observed combinations, sorted; each has a transition matrix of its own on the driver."""
    cols = tuple(cols)
    if not cols:
        return Strata((), ((),))
    seen = df.select(*cols).distinct().collect()
    if any(v is None for r in seen for v in r):
        raise ValueError(f"a row has no value in one of {cols}")
    return Strata(cols, tuple(sorted(tuple(r) for r in seen)))


def sequences(df: DataFrame, entity: Sequence[str], value: str, strata: Strata, time: str = "time",
              piece_steps: int = 8192) -> DataFrame:
    """One row per entity and ``piece`` of its time with arrays ``t`` (time), ``x`` (value) and ``s`` (stratum of the row).

    A piece spans ``piece_steps`` time steps; ``cut`` marks entities of several pieces, whose recursions are put
    together by ``_bounded``. The table is staged.
    """
    step = F.struct(F.col(time).cast("bigint").alias("t"), F.col(value).alias("x"), strata.index().alias("s"))
    piece = F.floor((F.col(time).cast("bigint") - 1) / piece_steps).cast("bigint").alias("piece")
    packed = df.groupBy(*entity, piece).agg(F.array_sort(F.collect_list(step)).alias("q"))
    packed = packed.repartition(shuffle_partitions(df.sparkSession), *entity, "piece")
    seqs = stage(packed.select(*entity, "piece", *[F.col(f"q.{c}").alias(c) for c in ("t", "x", "s")]))
    long = seqs.groupBy(*entity).agg(F.count("*").alias("pieces")).where("pieces > 1").select(*[F.col(c).alias(f"__{c}") for c in entity])
    if long.isEmpty():
        return seqs.withColumn("cut", F.lit(False))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in entity])
    return stage(seqs.join(long.withColumn("cut", F.lit(True)), same, "left").select(*seqs.columns, F.coalesce("cut", F.lit(False)).alias("cut")))


# --- recursions over a block of sequences


def stationary(tpm: np.ndarray) -> np.ndarray:
    """Stationary law of each 3 x 3 matrix of a stack."""
    p = lambda i, j: tpm[..., i - 1, j - 1]
    w = np.stack([p(2, 1) * p(3, 1) + p(2, 3) * p(3, 1) + p(3, 2) * p(2, 1),
                  p(1, 2) * p(3, 2) + p(1, 3) * p(3, 2) + p(3, 1) * p(1, 2),
                  p(1, 3) * p(2, 3) + p(1, 2) * p(2, 3) + p(2, 1) * p(1, 3)], axis=-1)
    total = w.sum(axis=-1, keepdims=True)
    return np.where(total > 0, w / np.where(total > 0, total, 1), 1 / 3)


def _pad(xs: Sequence, ss: Sequence):
    lens = np.array([len(v) for v in xs])
    x = np.full((len(xs), lens.max()), 0.5)
    s = np.zeros((len(xs), lens.max()), dtype=int)
    for i, (a, b) in enumerate(zip(xs, ss)):
        x[i, :len(a)] = a
        s[i, :len(b)] = b
    return x, s, lens


def _log_emission(x: np.ndarray, shapes) -> np.ndarray:
    x = np.clip(x, EPS, 1 - EPS)
    lx, l1 = np.log(x), np.log1p(-x)
    return np.stack([(a - 1) * lx + (b - 1) * l1 - (lgamma(a) + lgamma(b) - lgamma(a + b)) for a, b in shapes], axis=-1)


def _left(row: np.ndarray, mats: np.ndarray) -> np.ndarray:
    """Row vector times matrix for each sequence."""
    return row[:, :1] * mats[:, 0] + row[:, 1:2] * mats[:, 1] + row[:, 2:] * mats[:, 2]


def _entered(at, s, delta, tpm):
    """Law of the first step: the start law, or one step after the filtered law ``at`` in front of a piece."""
    first = delta[s[:, 0]]
    return first if at is None else np.where(np.isnan(at[:, :1]), first, _left(at, tpm[s[:, 0]]))


def _forward(x, s, lens, tpm, delta, shapes, at=None):
    """Filtered laws, one-step predictions, scaled emissions and log-likelihood per sequence."""
    n, t_max = x.shape
    log_b = _log_emission(x, shapes)
    top = log_b.max(axis=-1)
    b = np.exp(log_b - top[..., None])
    alpha = np.zeros((n, t_max, 3))
    pred = np.zeros((n, t_max, 3))
    scale = np.ones((n, t_max))
    loglik = np.zeros(n)
    current = None
    for t in range(t_max):
        live = t < lens
        pred[:, t] = _entered(at, s, delta, tpm) if t == 0 else _left(current, tpm[s[:, t]])
        joint = pred[:, t] * b[:, t]
        c = joint.sum(axis=1)
        alpha[:, t] = joint / c[:, None]
        scale[:, t] = np.where(live, c, 1.0)
        loglik += np.where(live, np.log(c) + top[:, t], 0.0)
        current = np.where(live[:, None], alpha[:, t], 0.0 if current is None else current)
    return alpha, pred, b, scale, loglik


def _last_beta(alpha, lens, behind):
    """Scaled likelihood of what follows the last step of each sequence, by state."""
    if behind is None:
        return np.ones((len(lens), 3))
    given = np.where(np.isnan(behind), 1.0, behind)
    return given / (alpha[np.arange(len(lens)), lens - 1] * given).sum(axis=1, keepdims=True)


def _expected_counts(x, s, lens, tpm, delta, shapes, at=None, behind=None, cells=None):
    """Expected transitions (sequence, stratum of the destination row, from, to), law of the first state (zeros
    for a later piece) and log-likelihood.

    ``at`` is the filtered law in front of a piece, ``behind`` the likelihood of what follows it by state. With
    ``cells`` every sequence has matrices of its own: ``tpm`` holds that many for each, one sequence after the other,
    ``s`` points into it and counts come by place in a sequence's own.
    """
    alpha, _, b, scale, loglik = _forward(x, s, lens, tpm, delta, shapes, at)
    n, t_max = x.shape
    k = len(tpm) if cells is None else cells
    counts = np.zeros((n, k, 3, 3))
    rows = np.arange(n)
    beta = _last_beta(alpha, lens, behind)
    for t in range(t_max - 1, 0, -1):
        live = t < lens
        g = tpm[s[:, t]]
        ahead = b[:, t] * beta / scale[:, t, None]
        xi = alpha[:, t - 1, :, None] * g * ahead[:, None, :]
        counts[rows, s[:, t] % k] += np.where(live[:, None, None], xi, 0.0)
        beta = np.where(live[:, None], (g * ahead[:, None, :]).sum(axis=2), beta)
    if at is not None:  # the step into a piece
        xi = at[:, :, None] * tpm[s[:, 0]] * (b[:, 0] * beta / scale[:, 0, None])[:, None, :]
        counts[rows, s[:, 0] % k] += np.where(np.isnan(xi), 0.0, xi)
    first = alpha[:, 0] * beta
    if at is not None:
        first = np.where(np.isnan(at[:, :1]), first, 0.0)
    return counts, first, loglik


def _viterbi(x, s, lens, tpm, delta, shapes, at=None, behind=None):
    """Most likely state path per sequence (1-based); ties go to the lowest state.

    ``at`` are the best scores in front of a piece, the first of ``behind`` its last state.
    """
    with np.errstate(divide="ignore"):
        log_p, log_d = np.log(tpm), np.log(delta)
    log_b = _log_emission(x, shapes)
    n, t_max = x.shape
    back = np.zeros((n, t_max, 3), dtype=np.int8)
    score = log_d[s[:, 0]] + log_b[:, 0]
    if at is not None:
        inside = (at[:, :, None] + log_p[s[:, 0]]).max(axis=1) + log_b[:, 0]
        score = np.where(np.isnan(at[:, :1]), score, inside)
    for t in range(1, t_max):
        live = t < lens
        cand = score[:, :, None] + log_p[s[:, t]]
        back[:, t] = np.where(live[:, None], cand.argmax(axis=1), np.arange(3)[None, :])
        score = np.where(live[:, None], cand.max(axis=1) + log_b[:, t], score)
    path = np.zeros((n, t_max), dtype=int)
    path[:, -1] = score.argmax(axis=1)
    if behind is not None:
        path[:, -1] = np.where(np.isnan(behind[:, 0]), path[:, -1], np.nan_to_num(behind[:, 0]))
    for t in range(t_max - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path + 1


def _given(column: Sequence) -> np.ndarray:
    """Three numbers a row, not-a-number where a piece has no neighbour on that side."""
    return np.array([v if v is not None else [np.nan] * 3 for v in column], dtype=float).reshape(-1, 3)


def _blocks(pdf: pd.DataFrame):
    """Slices of an Arrow batch with sequences of similar length together: rows, padded arrays, what bounds the pieces."""
    order = np.argsort([len(v) for v in pdf["x"]], kind="stable")
    for lo in range(0, len(order), BLOCK):
        part = pdf.iloc[order[lo:lo + BLOCK]]
        yield part, _pad(part["x"].to_numpy(), part["s"].to_numpy()), (_given(part["at"]), _given(part["behind"]))


def _start_law(tpm: np.ndarray, initial) -> np.ndarray:
    if initial == "stationary":
        return stationary(tpm)
    if initial == "uniform":
        return np.full((len(tpm), 3), 1 / 3)
    return np.tile(np.asarray(initial, dtype=float), (len(tpm), 1))


def _matrices(tpm, strata: Strata) -> np.ndarray:
    tpm = np.asarray(tpm, dtype=float)
    return np.tile(tpm, (len(strata.levels), 1, 1)) if tpm.ndim == 2 else tpm


def _fields(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


# --- pieces of long sequences


def _product(x, s, lens, tpm, delta, shapes, best: bool):
    """What a piece does to any law in front of it: four rows, three for the states and one for the start law.

    Sums of products, each row set scaled, or with ``best`` greatest sums of logarithms.
    """
    log_b = _log_emission(x, shapes)
    with np.errstate(divide="ignore"):
        step = np.log(tpm) if best else tpm
        start = np.log(delta) if best else delta
    b = log_b if best else np.exp(log_b - log_b.max(axis=-1, keepdims=True))
    m = np.concatenate([step[s[:, 0]], start[s[:, 0]][:, None]], axis=1)
    m = m + b[:, 0, None] if best else m * b[:, 0, None]
    for t in range(1, x.shape[1]):
        live = (t < lens)[:, None, None]
        g = step[s[:, t]]
        if best:
            new = (m[:, :, :, None] + g[:, None]).max(axis=2) + b[:, t, None]
        else:
            new = (m @ g) * b[:, t, None]
            new /= np.maximum(np.concatenate([np.repeat(new[:, :3].max(axis=(1, 2), keepdims=True), 3, axis=1), new[:, 3:].max(axis=2, keepdims=True)], axis=1), 1e-300)
        m = np.where(live, new, m)
    return m


def _chain(products: list[np.ndarray], best: bool):
    """What bounds each piece of one sequence: the law or scores in front of it and what follows, None at the ends."""
    at, behind = [None], [None]
    for k, m in enumerate(products[:-1]):
        if best:
            v = m[3] if k == 0 else (at[-1][:, None] + m[:3]).max(axis=0)
            at.append(v - v.max())
        else:
            v = m[3] if k == 0 else at[-1] @ m[:3]
            at.append(v / v.sum())
    if best:
        state = int((at[-1][:, None] + products[-1][:3]).max(axis=0).argmax())
    for k in range(len(products) - 1, 0, -1):
        if best:
            state = int((at[k] + products[k][:3, state]).argmax())
            behind.append(np.full(3, float(state)))
        else:
            v = products[k][:3] @ (np.ones(3) if behind[-1] is None else behind[-1])
            behind.append(v / v.max())
    return at, behind[::-1]


def _chained(maps: DataFrame, best: bool = False) -> DataFrame:
    """Products (``key, piece, m``) to what bounds every piece (``key, piece, at, behind``); a key's products pass in order."""
    def run(batches):
        key, pieces, ms = None, [], []

        def told():
            at, behind = _chain(ms, best)
            return pd.DataFrame({"key": key, "piece": pieces, "at": at, "behind": behind}) if ms else pd.DataFrame(columns=["key", "piece", "at", "behind"])
        for pdf in batches:
            for now, piece, m in zip(pdf["key"], pdf["piece"], pdf["m"]):
                if ms and now != key:
                    yield told()
                    pieces, ms = [], []
                key = now
                pieces.append(piece)
                ms.append(np.asarray(m, dtype=float).reshape(4, 3))
        if ms:
            yield told()

    return maps.repartition("key").sortWithinPartitions("key", "piece").mapInPandas(run, "key string, piece bigint, at array<double>, behind array<double>")


def _bounded(seqs: DataFrame, entity: Sequence[str], mats: np.ndarray, delta: np.ndarray, shapes, best: bool = False) -> tuple[DataFrame, bool]:
    """``seqs`` with ``at`` and ``behind``, what bounds a piece of a cut entity, and whether there are such entities.

    Every piece becomes a 3 x 3 product by itself; only these are chained by entity, 12 numbers a piece.
    """
    none = F.lit(None).cast("array<double>")
    if seqs.where("cut").isEmpty():
        return seqs.withColumns({"at": none, "behind": none}), False

    def products(batches):
        for pdf in batches:
            if len(pdf):
                order = np.argsort([len(v) for v in pdf["x"]], kind="stable")
                for lo in range(0, len(order), BLOCK):
                    part = pdf.iloc[order[lo:lo + BLOCK]]
                    m = _product(*_pad(part["x"].to_numpy(), part["s"].to_numpy()), mats, delta, shapes, best)
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "piece": part["piece"].to_numpy(), "m": list(m.reshape(-1, 12))})

    keyed = seqs.withColumn("__key", F.to_json(F.struct(*entity)))  # pandas would read numbers beside missing ones as floats
    maps = keyed.where("cut").select(F.col("__key").alias("key"), "piece", "x", "s").mapInPandas(products, "key string, piece bigint, m array<double>")
    chain = stage(_chained(maps, best).withColumnsRenamed({"key": "__key"}))
    return keyed.join(chain, ["__key", "piece"], "left").drop("__key"), True


# --- operators on packed sequences


def loglik(seqs: DataFrame, entity: Sequence[str], tpm, strata: Strata, initial="stationary",
           shapes=SHAPES) -> DataFrame:
    """Log-likelihood per entity."""
    mats = _matrices(tpm, strata)
    delta = _start_law(mats, initial)
    bounded, cut = _bounded(seqs, entity, mats, delta, shapes)

    def run(batches):
        for pdf in batches:
            for part, (x, s, lens), (at, _) in _blocks(pdf):
                *_, ll = _forward(x, s, lens, mats, delta, shapes, at)
                yield part[list(entity)].assign(steps=lens, loglik=ll)

    schema = T.StructType([*_fields(seqs, entity), T.StructField("steps", T.LongType()),
                           T.StructField("loglik", T.DoubleType())])
    out = bounded.select(*entity, "x", "s", "at", "behind").mapInPandas(run, schema)
    return out.groupBy(*entity).agg(F.sum("steps").alias("steps"), F.sum("loglik").alias("loglik")) if cut else out


def expected_counts(seqs: DataFrame, entity: Sequence[str], tpm, strata: Strata, initial="stationary",
                    shapes=SHAPES) -> DataFrame:
    """Expected transitions per entity and stratum: ``s`` and the row-major array ``c`` of nine."""
    mats = _matrices(tpm, strata)
    delta = _start_law(mats, initial)
    k = len(mats)
    bounded, cut = _bounded(seqs, entity, mats, delta, shapes)

    def run(batches):
        for pdf in batches:
            for part, (x, s, lens), (at, behind) in _blocks(pdf):
                counts, *_ = _expected_counts(x, s, lens, mats, delta, shapes, at, behind)
                seen = np.zeros((len(lens), k), dtype=bool)
                for i, n in enumerate(lens):
                    seen[i, np.unique(s[i, :n])] = True
                who, which = np.nonzero(seen)
                out = part[list(entity)].iloc[who].reset_index(drop=True)
                yield out.assign(s=which.astype(np.int32), c=list(counts[who, which].reshape(-1, 9)))

    schema = T.StructType([*_fields(seqs, entity), T.StructField("s", T.IntegerType()),
                           T.StructField("c", T.ArrayType(T.DoubleType()))])
    out = bounded.select(*entity, "x", "s", "at", "behind").mapInPandas(run, schema)
    return out.groupBy(*entity, "s").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(9)]).alias("c")) if cut else out


def _rounds(seqs: DataFrame, entity: Sequence[str], stacks: Sequence[tuple[np.ndarray, np.ndarray]], shapes) -> list[tuple]:
    """For each (matrices, start laws): expected counts, expected first states and log-likelihood, 12 K + 1 numbers back.

    One pass over the series serves all of them; with entities in pieces it is one each, as the pieces' bounds differ.
    """
    k = len(stacks[0][0])
    size = 12 * k + 1
    first, cut = _bounded(seqs, entity, *stacks[0], shapes)
    tables = [(first, [0] if cut else range(len(stacks)))]
    if cut:
        tables += [(_bounded(seqs, entity, *pair, shapes)[0], [w]) for w, pair in enumerate(stacks[1:], start=1)]

    def run_with(which):
        def run(batches):
            total = np.zeros((len(which), size))
            for pdf in batches:
                for _, (x, s, lens), (at, behind) in _blocks(pdf):
                    for row, w in enumerate(which):
                        counts, law, ll = _expected_counts(x, s, lens, *stacks[w], shapes, at, behind)
                        starts = np.zeros((k, 3))
                        np.add.at(starts, s[:, 0], law)
                        total[row] += np.concatenate([counts.sum(axis=0).ravel(), starts.ravel(), [ll.sum()]])
            yield pd.DataFrame({"w": np.repeat(list(which), size), "i": np.tile(np.arange(size), len(which)), "v": total.ravel()})
        return run

    flat = np.zeros((len(stacks), size))
    for table, which in tables:
        rows = table.select("x", "s", "at", "behind").mapInPandas(run_with(list(which)), "w int, i int, v double")
        for r in rows.groupBy("w", "i").agg(F.sum("v").alias("v")).collect():
            flat[r["w"], r["i"]] = r["v"]
    return [(f[:9 * k].reshape(k, 3, 3), f[9 * k:-1].reshape(k, 3), float(f[-1])) for f in flat]


def _normalise(counts: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), fallback)


@dataclass
class HmmFit:
    """Fitted matrices with the staged series (``rows``) and its packed form (``seqs``)."""

    rows: DataFrame
    seqs: DataFrame
    entity: tuple[str, ...]
    strata: Strata
    tpm: np.ndarray
    shapes: tuple
    initial: object
    trace: list[float]
    converged: bool
    design: L.LogitDesign | None = None
    beta: np.ndarray | None = None

    def transitions(self) -> DataFrame:
        """(strata, p) with the matrix as array of rows."""
        rows = [(i, m.tolist()) for i, m in enumerate(self.tpm)]
        return self.strata.frame(self.seqs.sparkSession, rows, "p array<array<double>>")

    def summary(self) -> DataFrame:
        return self.seqs.sparkSession.createDataFrame(
            [(i + 1, v, self.converged) for i, v in enumerate(self.trace)], "round int, loglik double, converged boolean")

    def coefficients(self) -> DataFrame:
        """(from, to, term, estimate) of the log odds against staying, for a fit with a formula."""
        if self.design is None:
            raise ValueError("a fit without a formula has matrices only")
        rows = [(f"state{i + 1}", f"state{j + 1}", name, float(v))
                for (i, j), row in zip(self.design.moves, self.beta) for name, v in zip(self.design.names, row)]
        return self.seqs.sparkSession.createDataFrame(rows, "`from` string, `to` string, term string, estimate double")

    def counts(self) -> DataFrame:
        return expected_counts(self.seqs, self.entity, self.tpm, self.strata, self.initial, self.shapes)


def _cell_step(mats: np.ndarray, counts: np.ndarray, starts: np.ndarray | None, steps: int) -> np.ndarray:
    """Next matrices, each cell by itself: shares of the counts, or Newton steps where the start law depends on them."""
    if starts is None:
        return _normalise(counts, mats)
    out = mats.copy()
    for s in range(len(mats)):
        one = L.design_of((), [()], [], mats[s] > 0)
        out[s:s + 1] = L.matrices(one, L.ascend(one, L.coefficients_of(one, mats[s:s + 1]), counts[s:s + 1], starts[s:s + 1], steps))
    return out


def fit_transitions(df: DataFrame, entity: Sequence[str], value: str, strata_cols: Sequence[str] = ("part",),
                    start=START, zeros: Sequence[tuple[int, int]] = (), shapes=SHAPES, max_iter: int = 100,
                    tol: float = 1e-6, initial="stationary", time: str = "time", strict: bool = True,
                    formula: str | Sequence[str] | None = None, levels: Mapping[str, Sequence[str]] | None = None,
                    newton: int = 25) -> HmmFit:
    """Transition matrices by EM with fixed emissions, one per stratum or log odds linear in a formula.

    The stratum of the destination row governs a step. ``zeros`` are (from, to) pairs that stay
    impossible. With ``formula`` (``"part + treatment"``, over ``strata_cols``) the log odds of each move against
    staying have a coefficient per column of it, treatment contrasts against the first of ``levels``; without one
    every stratum has a matrix of its own. A round takes up to ``newton`` Newton steps on the expected log probability. Under
    the stationary start law these include the law's own dependence on the matrix, and steps are halved where they would
    lower it, so the likelihood never falls. A fish effect on the
    transitions is not part of this fit, see ``shrink_by_entity``. Rounds end when the relative gain is
    below ``tol``; not getting there in ``max_iter`` rounds is an error unless ``strict`` is off. The matrices
    belong to the last logged likelihood. Staying must be possible in every state.
    """
    # the series is staged before its covariate cells are listed, so its frames are read once
    rows = stage(df.select(*dict.fromkeys([*entity, *strata_cols, time, value])))
    strata = strata_of(rows, strata_cols)
    seqs = sequences(rows, entity, value, strata, time)
    mats = _matrices(start, strata).copy()
    for i, j in zeros:
        mats[:, i - 1, j - 1] = 0.0
    mats = mats / mats.sum(axis=-1, keepdims=True)
    design = beta = None
    if formula is not None:
        design = L.design_of(strata.cols, strata.levels, formula, (mats > 0).all(axis=0), levels)
        beta = L.coefficients_of(design, mats)
        mats = L.matrices(design, beta)
    trace: list[float] = []
    converged, sums = False, None
    while not converged and len(trace) < max_iter:
        if sums is not None:
            if design is None:
                mats = _cell_step(mats, *sums, newton)
            else:
                beta = L.ascend(design, beta, *sums, newton)
                mats = L.matrices(design, beta)
        counts, starts, ll = _rounds(seqs, entity, [(mats, _start_law(mats, initial))], shapes)[0]
        sums = counts, starts if initial == "stationary" else None
        trace.append(ll)
        converged = len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol * (1 + abs(ll))
    if strict and not converged:
        raise RuntimeError(f"no convergence in {max_iter} rounds; raise max_iter or tol, or pass strict=False")
    return HmmFit(rows, seqs, tuple(entity), strata, mats, tuple(shapes), initial, trace, converged, design, beta)


def information(fit: HmmFit, step: float = 1e-4) -> np.ndarray:
    """Observed information of a formula's coefficients, (move, term) by (move, term).

    The likelihood's gradient is that of the expected log probability under the same matrices, known exactly from one pass;
    its central differences by coefficient are the information, with what the hidden states hide left out. The
    2 x coefficients evaluations share one pass over the series unless an entity is in pieces.
    """
    if fit.design is None:
        raise ValueError("information is that of a formula's coefficients")
    base = fit.beta.ravel()
    stacks = []
    for a in range(len(base)):
        for sign in (1, -1):
            moved = base.copy()
            moved[a] += sign * step
            mats = L.matrices(fit.design, moved.reshape(fit.beta.shape))
            stacks.append((mats, _start_law(mats, fit.initial)))
    sums = _rounds(fit.seqs, fit.entity, stacks, fit.shapes)
    scores = [L.score(fit.design, mats, counts, starts if fit.initial == "stationary" else None).ravel()
              for (mats, _), (counts, starts, _) in zip(stacks, sums)]
    out = -np.stack([(up - down) / (2 * step) for up, down in zip(scores[::2], scores[1::2])])
    return (out + out.T) / 2


def covariance(info: np.ndarray) -> np.ndarray:
    """Inverse of the information; one that is not positive definite is an error (a coefficient on its way to infinity)."""
    values = np.linalg.eigvalsh(info)
    if values[0] <= 1e-8 * max(1.0, values[-1]):
        raise ValueError("the information is not positive definite: some move is not identified; name it in zeros or simplify the formula")
    return np.linalg.inv(info)


def coefficient_table(fit: HmmFit, info: np.ndarray) -> DataFrame:
    """``fit.coefficients()`` with standard error ``se``, ``lower`` and ``upper`` at 95 %."""
    se = np.sqrt(np.diagonal(covariance(info)))
    rows = [(f"state{i + 1}", f"state{j + 1}", name, float(v), float(e), float(v - 1.959963984540054 * e), float(v + 1.959963984540054 * e))
            for ((i, j), name), v, e in zip([(m, n) for m in fit.design.moves for n in fit.design.names], fit.beta.ravel(), se)]
    return fit.seqs.sparkSession.createDataFrame(
        rows, "`from` string, `to` string, term string, estimate double, se double, lower double, upper double")


def law_draws(fit: HmmFit, info: np.ndarray, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Transition matrices of ``reps`` normal draws of the coefficients: (strata, s, draw, p), as ``draws`` returns them.

    A draw's numbers depend on ``seed`` and its own number alone, so a retried task repeats them.
    """
    root = np.linalg.cholesky(covariance(info))
    design, base, k = fit.design, fit.beta, len(fit.tpm)

    def run(batches):
        for pdf in batches:
            out = []
            for d in pdf["draw"]:
                z = np.random.default_rng([seed, int(d)]).standard_normal(len(root))
                mats = L.matrices(design, base + (root @ z).reshape(base.shape))
                out += [(s, int(d), mats[s].tolist()) for s in range(k)]
            yield pd.DataFrame(out, columns=["s", "draw", "p"])

    numbers = fit.seqs.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("draw"))
    drawn = numbers.mapInPandas(run, "s int, draw int, p array<array<double>>")
    return _label_strata(drawn, fit).select(*fit.strata.cols, "s", "draw", "p")


def viterbi(seqs: DataFrame, entity: Sequence[str], tpm, strata: Strata, initial="stationary",
            shapes=SHAPES) -> DataFrame:
    """Decoded ``state`` per (entity, time), with the number ``s`` of the row's stratum."""
    mats = _matrices(tpm, strata)
    delta = _start_law(mats, initial)
    bounded, _ = _bounded(seqs, entity, mats, delta, shapes, best=True)

    def run(batches):
        for pdf in batches:
            for part, (x, s, lens), (at, behind) in _blocks(pdf):
                path = _viterbi(x, s, lens, mats, delta, shapes, at, behind)
                yield part[[*entity, "t", "x", "s"]].assign(z=[path[i, :n].astype(np.int32) for i, n in enumerate(lens)])

    schema = T.StructType([*_fields(seqs, [*entity, "t", "x", "s"]), T.StructField("z", T.ArrayType(T.IntegerType()))])
    packed = bounded.select(*entity, "t", "x", "s", "at", "behind").mapInPandas(run, schema)
    rows = packed.select(*entity, F.explode(F.arrays_zip("t", "x", "s", "z")).alias("q"))
    return rows.select(*entity, F.col("q.t").alias("time"), F.col("q.x").alias("value"), F.col("q.s").alias("s"), F.col("q.z").alias("state"))


def _surrounded(x, s, lens, tpm, delta, shapes, at=None, behind=None):
    """Law of each step's state given every other step of its sequence."""
    alpha, law, b, scale, _ = _forward(x, s, lens, tpm, delta, shapes, at)
    beta = _last_beta(alpha, lens, behind)
    for t in range(x.shape[1] - 1, -1, -1):
        live = (t < lens)[:, None]
        law[:, t] = np.where(live, law[:, t] * beta, law[:, t])
        beta = np.where(live, (tpm[s[:, t]] * (b[:, t] * beta / scale[:, t, None])[:, None, :]).sum(axis=2), beta)
    return law / law.sum(axis=-1, keepdims=True)


def pseudo_residuals(seqs: DataFrame, entity: Sequence[str], tpm, strata: Strata, initial="stationary",
                     shapes=SHAPES, kind: str = "forecast") -> DataFrame:
    """Pseudo-residual per (entity, time): normal quantile of the step's distribution function at its value.

    The distribution is that given the steps before (``kind="forecast"``) or given all other steps of the entity, before
    and after (``kind="conditional"``).
    """
    if kind not in ("forecast", "conditional"):
        raise ValueError(f"unknown kind of residual: {kind}")
    mats = _matrices(tpm, strata)
    delta = _start_law(mats, initial)
    bounded, _ = _bounded(seqs, entity, mats, delta, shapes)

    def run(batches):
        for pdf in batches:
            for part, (x, s, lens), (at, behind) in _blocks(pdf):
                law = _forward(x, s, lens, mats, delta, shapes, at)[1] if kind == "forecast" else _surrounded(x, s, lens, mats, delta, shapes, at, behind)
                cdf = np.stack([S.betainc(a, b, np.clip(x, EPS, 1 - EPS)) for a, b in shapes], axis=-1)
                u = np.clip((law * cdf).sum(axis=-1), 1e-12, 1 - 1e-12)
                z = S.norm_ppf(u)
                yield part[[*entity, "t"]].assign(r=[z[i, :n] for i, n in enumerate(lens)])

    schema = T.StructType([*_fields(seqs, [*entity, "t"]), T.StructField("r", T.ArrayType(T.DoubleType()))])
    packed = bounded.select(*entity, "t", "x", "s", "at", "behind").mapInPandas(run, schema)
    rows = packed.select(*entity, F.explode(F.arrays_zip("t", "r")).alias("q"))
    return rows.select(*entity, F.col("q.t").alias("time"), F.col("q.r").alias("residual"))


# --- matrices as tables


def _cells(p: str = "p") -> dict[tuple[int, int], Column]:
    return {(i, j): F.col(p)[i - 1][j - 1] for i in (1, 2, 3) for j in (1, 2, 3)}


def normalise_counts(df: DataFrame, counts: str = "c", name: str = "p", prior: str | None = None,
                     strength: float = 0.0) -> DataFrame:
    """Nine counts, row by row, to a matrix; ``strength`` pseudo-counts follow the ``prior`` matrix.

    A row without any count takes the prior's row, or is null when there is none.
    """
    rows = []
    for i in range(3):
        c = [F.col(counts)[3 * i + j] for j in range(3)]
        total = c[0] + c[1] + c[2]
        if prior is None:
            rows.append(F.array(*[F.try_divide(v, total) for v in c]))
        else:
            pr = [F.col(prior)[i][j] for j in range(3)]
            rows.append(F.array(*[F.coalesce(F.try_divide(v + strength * q, total + strength), q)
                                  for v, q in zip(c, pr)]))
    return df.withColumn(name, F.array(*rows))


def with_stationary(df: DataFrame, p: str = "p") -> DataFrame:
    """Stationary probabilities ``state1..state3`` of the matrix column."""
    return df.withColumns({f"state{i + 1}": c for i, c in enumerate(stationary3(_cells(p)))})


def tpm_long(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Matrix column to (keys, from, to, freq)."""
    return matrix_long(df, p, keys)


def pooling_strength(counts: DataFrame, fit: HmmFit, most: float = 1e4) -> float:
    """How strongly entities resemble their stratum, as a number of pseudo-counts, by moments.

    If an entity's transition row scatters around the stratum's row p like a Dirichlet law of weight A, the squared
    gap between its n expected counts and n p has mean p (1 - p) (n + (n^2 - n) / (1 + A)). Sums over all
    entities, strata and rows give A; 0 to ``most``, which stands for no entity effect.
    """
    priors = F.array(*[F.lit([float(v) for v in m.ravel()]) for m in fit.tpm])
    c, prior = F.col("c"), priors[F.col("s")]
    gap, base, extra = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(3):
        n = c[3 * i] + c[3 * i + 1] + c[3 * i + 2]
        for j in range(3):
            p = prior[3 * i + j]
            gap = gap + (c[3 * i + j] - n * p) ** 2
            base = base + p * (1 - p) * n
            extra = extra + p * (1 - p) * (n * n - n)
    total = counts.agg(F.sum(gap), F.sum(base), F.sum(extra)).first()
    if not total[2] or total[2] <= 0:
        return most
    share = (total[0] - total[1]) / total[2]
    return float(min(most, max(0.0, 1 / share - 1))) if share > 0 else most


def shrink_by_entity(counts: DataFrame, fit: HmmFit, strength: float | None = None) -> DataFrame:
    """Matrix per entity and stratum: expected counts plus ``strength`` pseudo-counts of the stratum's.

    An approximation of an entity effect on the transitions, not the same estimator. The strength is
    estimated by ``pooling_strength`` unless it is given.
    """
    strength = pooling_strength(counts, fit) if strength is None else strength
    priors = fit.seqs.sparkSession.createDataFrame(
        [(i, m.tolist()) for i, m in enumerate(fit.tpm)], "s int, prior array<array<double>>")
    joined = counts.join(F.broadcast(priors), "s")
    labels = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(fit.strata.cols, lv)]) for lv in fit.strata.levels]) \
        if fit.strata.cols else None
    out = normalise_counts(joined, "c", "p", "prior", strength)
    # covariates that identify the entity are part of its key already
    extra = [labels[F.col("s")][c].alias(c) for c in fit.strata.cols if c not in fit.entity] if fit.strata.cols else []
    return out.select(*fit.entity, *extra, "p")


# --- uncertainty


def draws(counts: DataFrame, fit: HmmFit, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Transition matrices of ``reps`` Poisson resamples of entities: (strata, draw, p).

    Weights are hashed from the entity key. Each task returns one short row per (draw, stratum).
    """
    k = len(fit.tpm)
    rows = counts.select(F.xxhash64(*fit.entity).alias("h"), "s", "c")

    def run(batches):
        total = np.zeros((reps, k, 9))
        for pdf in batches:
            for s, part in pdf.groupby("s"):
                h, c = part["h"].to_numpy(), np.stack(part["c"].to_numpy())
                for lo in range(0, len(h), 4096):
                    total[:, s] += poisson_weights(h[lo:lo + 4096], reps, seed).T @ c[lo:lo + 4096]
        which = np.argwhere(np.ones((reps, k), dtype=bool))
        yield pd.DataFrame({"draw": which[:, 0] + 1, "s": which[:, 1],
                            **{f"c{i}": total[:, :, i].ravel() for i in range(9)}})

    schema = "draw int, s int, " + ", ".join(f"c{i} double" for i in range(9))
    sums = rows.mapInPandas(run, schema).groupBy("draw", "s").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(9)])
    prior = F.array(*[F.lit(m.tolist()) for m in fit.tpm])
    packed = sums.select("draw", "s", F.array(*[f"c{i}" for i in range(9)]).alias("c"),
                         prior[F.col("s")].alias("prior"))
    return _label_strata(normalise_counts(packed, "c", "p", "prior"), fit).select(*fit.strata.cols, "s", "draw", "p")


def _label_strata(df: DataFrame, fit: HmmFit) -> DataFrame:
    for i, c in enumerate(fit.strata.cols):
        df = df.withColumn(c, F.array(*[F.lit(lv[i]) for lv in fit.strata.levels])[F.col("s")])
    return df


def _draw_stack(draw_df: DataFrame, k: int) -> np.ndarray:
    """(stratum, draw, 3, 3); reps x strata matrices, both fixed by the caller."""
    pdf = draw_df.select("s", "draw", F.flatten("p").alias("f")).toPandas().sort_values(["s", "draw"])
    return np.stack(pdf["f"].to_numpy()).reshape(k, -1, 3, 3)


def _entity_draws(c: np.ndarray, stack: np.ndarray, strength: float) -> np.ndarray:
    """(entity, draw, 3, 3) from counts (entity, 9) and the stratum's draws."""
    c = c.reshape(-1, 1, 3, 3)
    total = c.sum(axis=-1, keepdims=True) + strength
    return np.where(total > 0, (c + strength * stack[None]) / np.where(total > 0, total, 1), stack[None])


def entity_state_interval(counts: DataFrame, draw_df: DataFrame, fit: HmmFit, strength: float | None = None,
                          width: float = 0.95) -> DataFrame:
    """Median and interval of each state's stationary probability per entity and stratum.

    The draws of an entity live and die inside its row, so no (entity x draw) table is shuffled.
    """
    stack = _draw_stack(draw_df, len(fit.tpm))
    strength = pooling_strength(counts, fit) if strength is None else strength
    entity = list(fit.entity)
    probs = [0.5, (1 - width) / 2, 1 - (1 - width) / 2]

    def run(batches):
        for pdf in batches:
            for s, part in pdf.groupby("s"):
                c = np.stack(part["c"].to_numpy())
                for lo in range(0, len(c), BLOCK):
                    law = stationary(_entity_draws(c[lo:lo + BLOCK], stack[s], strength))
                    q = np.quantile(law, probs, axis=1)
                    base = part[entity].iloc[lo:lo + BLOCK].assign(s=s)
                    for i in range(3):
                        yield base.assign(state=f"state{i + 1}", median=q[0, :, i], lower=q[1, :, i], upper=q[2, :, i])

    schema = T.StructType([*_fields(counts, entity), T.StructField("s", T.IntegerType()),
                           T.StructField("state", T.StringType()),
                           *[T.StructField(n, T.DoubleType()) for n in ("median", "lower", "upper")]])
    out = counts.select(*entity, "s", "c").mapInPandas(run, schema)
    extra = [c for c in fit.strata.cols if c not in fit.entity]
    return _label_strata(out, fit).select(*entity, *extra, "state", "median", "lower", "upper")


def marginal_draws(counts: DataFrame, draw_df: DataFrame, fit: HmmFit, strength: float | None = None) -> DataFrame:
    """Mean over entities, per stratum and draw, of the matrix ``p`` and of ``state1..state3``."""
    stack = _draw_stack(draw_df, len(fit.tpm))
    strength = pooling_strength(counts, fit) if strength is None else strength
    k, reps = stack.shape[:2]

    def run(batches):
        total = np.zeros((k, reps, 12))
        seen = np.zeros(k)
        for pdf in batches:
            for s, part in pdf.groupby("s"):
                c = np.stack(part["c"].to_numpy())
                seen[s] += len(c)
                for lo in range(0, len(c), BLOCK):
                    m = _entity_draws(c[lo:lo + BLOCK], stack[s], strength)
                    total[s, :, :9] += m.reshape(len(m), reps, 9).sum(axis=0)
                    total[s, :, 9:] += stationary(m).sum(axis=0)
        which = np.argwhere(np.ones((k, reps), dtype=bool))
        yield pd.DataFrame({"s": which[:, 0], "draw": which[:, 1] + 1, "n": seen[which[:, 0]],
                            **{f"v{i}": total[:, :, i].ravel() for i in range(12)}})

    schema = "s int, draw int, n double, " + ", ".join(f"v{i} double" for i in range(12))
    sums = counts.select("s", "c").mapInPandas(run, schema).groupBy("s", "draw") \
        .agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(12)])
    mean = [F.try_divide(F.col(f"v{i}"), F.col("n")) for i in range(12)]
    out = sums.select("s", "draw", F.array(*[F.array(*mean[3 * i:3 * i + 3]) for i in range(3)]).alias("p"),
                      *[mean[9 + i].alias(f"state{i + 1}") for i in range(3)])
    return _label_strata(out, fit).select(*fit.strata.cols, "draw", "p", "state1", "state2", "state3")


def state_interval(draw_df: DataFrame, keys: Sequence[str], width: float = 0.95) -> DataFrame:
    """Interval of each state's probability over a (staged) table with ``state1..state3``."""
    long = draw_df.select(*keys, "state1", "state2", "state3") \
        .unpivot(list(keys), ["state1", "state2", "state3"], "state", "prob")
    return median_qi(long, [*keys, "state"], "prob", width)


def transition_interval(draw_df: DataFrame, keys: Sequence[str], width: float = 0.95) -> DataFrame:
    """Interval of each transition with the flag of the direct 1-3 and 3-1 moves."""
    long = matrix_long(draw_df, "p", keys)
    return flag_pairs(median_qi(long, [*keys, "from", "to"], "freq", width))


# --- observation parameters


def state_parameters(coef: DataFrame, name: str = "name", estimate: str = "estimate") -> DataFrame:
    """Log-scale coefficients ``value.shapeK.stateJ.(Intercept)`` to shapes, mean and precision per state."""
    tidy = tidy_param_names(coef.withColumn(estimate, F.exp(estimate)), name)
    wide = params_wide(tidy, "state", "variable", estimate, ["shape1", "shape2"])
    mean, prec = shape_to_prec(F.col("shape1"), F.col("shape2"))
    return wide.withColumns({"mean": mean, "prec": prec})
