"""Recursions against enumeration of all paths, and the fit's invariants."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.functions import special as S
from shoalspark.models import hmm as H

SEQS = {
    "a": ([0.21, 0.48, 0.52, 0.80, 0.77], ["Before", "Before", "After", "After", "After"]),
    "b": ([0.5, 0.12], ["Before", "After"]),
    "c": ([0.9], ["After"]),
}
TPM = np.array([[[0.7, 0.2, 0.1], [0.15, 0.6, 0.25], [0.05, 0.3, 0.65]],
                [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.2, 0.7]]])
STRATA = H.Strata(("part",), (("After",), ("Before",)))


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(k, p, x, i + 1) for k, (xs, ps) in SEQS.items() for i, (x, p) in enumerate(zip(xs, ps))]
    return spark.createDataFrame(rows, "fish string, part string, x double, time int").repartition(4)


def brute(xs, parts, delta):
    which = {"After": 0, "Before": 1}
    dens = [[math.exp((a - 1) * math.log(x) + (b - 1) * math.log(1 - x)
                      - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) for a, b in H.SHAPES] for x in xs]
    paths = {}
    for path in itertools.product(range(3), repeat=len(xs)):
        w = delta[which[parts[0]]][path[0]] * dens[0][path[0]]
        for t in range(1, len(xs)):
            w *= TPM[which[parts[t]]][path[t - 1], path[t]] * dens[t][path[t]]
        paths[path] = w
    return paths, dens


@pytest.mark.parametrize("piece_steps", [8192, 1, 2, 3])
def test_against_enumeration(steps, piece_steps):
    delta = H.stationary(TPM)
    assert np.allclose(np.einsum("ki,kij->kj", delta, TPM), delta)
    seqs = H.sequences(steps, ["fish"], "x", STRATA, piece_steps=piece_steps)
    assert seqs.count() == sum(-(-len(xs) // piece_steps) for xs, _ in SEQS.values())
    ll = {r["fish"]: r["loglik"] for r in H.loglik(seqs, ["fish"], TPM, STRATA).collect()}
    decoded = {}
    for r in H.viterbi(seqs, ["fish"], TPM, STRATA).collect():
        decoded.setdefault(r["fish"], {})[r["time"]] = r["state"]
    counts = {(r["fish"], r["s"]): np.array(r["c"]).reshape(3, 3)
              for r in H.expected_counts(seqs, ["fish"], TPM, STRATA).collect()}
    resid = {(r["fish"], r["time"]): r["residual"] for r in H.pseudo_residuals(seqs, ["fish"], TPM, STRATA).collect()}
    around = {(r["fish"], r["time"]): r["residual"]
              for r in H.pseudo_residuals(seqs, ["fish"], TPM, STRATA, kind="conditional").collect()}
    for k, (xs, ps) in SEQS.items():
        paths, dens = brute(xs, ps, delta)
        total = sum(paths.values())
        for t, x in enumerate(xs):  # the law of a state given all other steps
            law = np.zeros(3)
            for path, w in paths.items():
                law[path[t]] += w / dens[t][path[t]]
            u = sum(law[j] / law.sum() * float(S.betainc(a, b, x)) for j, (a, b) in enumerate(H.SHAPES))
            assert around[k, t + 1] == pytest.approx(float(S.norm_ppf(np.array([u]))[0]), abs=1e-8)
        assert ll[k] == pytest.approx(math.log(total), abs=1e-10)
        best = max(paths, key=paths.get)
        assert [decoded[k][t + 1] - 1 for t in range(len(xs))] == list(best)
        want = np.zeros((2, 3, 3))
        for path, w in paths.items():
            for t in range(1, len(xs)):
                want[0 if ps[t] == "After" else 1, path[t - 1], path[t]] += w / total
        for s in (0, 1):
            if (k, s) in counts:
                assert np.allclose(counts[k, s], want[s], atol=1e-10)
            else:
                assert want[s].sum() == 0
        # predictive law of the last step given the earlier ones
        if len(xs) > 1:
            head, _ = brute(xs[:-1], ps[:-1], delta)
            law = np.zeros(3)
            for path, w in head.items():
                law += w / sum(head.values()) * TPM[0 if ps[-1] == "After" else 1][path[-1]]
        else:
            law = delta[0]
        u = sum(law[j] * float(S.betainc(a, b, xs[-1])) for j, (a, b) in enumerate(H.SHAPES))
        assert resid[k, len(xs)] == pytest.approx(float(S.norm_ppf(np.array([u]))[0]), abs=1e-9)


@pytest.fixture(scope="module")
def long_steps(spark):
    rng = np.random.default_rng(11)
    rows = []
    for f in range(20):
        z = 0
        for t in range(60):
            part = "Before" if t < 30 else "After"
            p = [[0.85, 0.15, 0.0], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]][z] if part == "Before" else \
                [[0.6, 0.4, 0.0], [0.05, 0.75, 0.2], [0.0, 0.1, 0.9]][z]
            z = rng.choice(3, p=p)
            rows.append((f"f{f}", part, float(rng.beta(*H.SHAPES[z])), t + 1))
    return spark.createDataFrame(rows, "fish string, part string, x double, time int")


def test_fit_rises_and_keeps_zeros(long_steps):
    fit = H.fit_transitions(long_steps, ["fish"], "x", ["part"], H.START_NEIGHBOURS, zeros=[(1, 3), (3, 1)],
                            max_iter=25, tol=0.0, initial="uniform", strict=False)
    assert all(b >= a - 1e-9 for a, b in zip(fit.trace, fit.trace[1:]))
    assert np.allclose(fit.tpm.sum(axis=-1), 1)
    assert np.all(fit.tpm[:, 0, 2] == 0) and np.all(fit.tpm[:, 2, 0] == 0)
    after = fit.tpm[[lv[0] for lv in fit.strata.levels].index("After")]
    assert abs(after[2, 2] - 0.9) < 0.12
    loose = H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=25, tol=0.0, strict=False)
    assert all(b >= a - 1e-5 for a, b in zip(loose.trace, loose.trace[1:]))


def test_draws_and_intervals(long_steps):
    fit = H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=15, strict=False)
    counts = fit.counts()
    d = H.draws(counts, fit, reps=60)
    again = H.draws(counts.repartition(3), fit, reps=60)
    key = lambda df: sorted((r["part"], r["draw"], str(np.round(r["p"], 9))) for r in df.collect())
    assert key(d) == key(again) and d.count() == 120
    marg = H.marginal_draws(counts, d, fit)
    states = H.state_interval(marg, ["part"]).collect()
    assert len(states) == 6 and all(r["lower"] <= r["median"] <= r["upper"] for r in states)
    moves = H.transition_interval(marg, ["part"]).collect()
    assert len(moves) == 18 and sum(r["of_interest"] for r in moves) == 4
    per = H.entity_state_interval(counts, d, fit).collect()
    assert len(per) == 20 * 2 * 3 and all(0 <= r["lower"] <= r["upper"] <= 1 for r in per)
    shrunk = H.shrink_by_entity(counts, fit, strength=1e12).first()
    which = [lv[0] for lv in fit.strata.levels].index(shrunk["part"])
    assert np.allclose(shrunk["p"], fit.tpm[which], atol=1e-9)
    # one entity's draws agree with the marginal mean over entities
    big = H.marginal_draws(counts, d, fit, strength=1e12).where("draw = 1 and part = 'After'").first()
    raw = d.where("draw = 1 and part = 'After'").first()
    assert np.allclose(big["p"], raw["p"], atol=1e-9)


def test_stationary_column_and_series(spark):
    m = [[0.7, 0.3, 0.0], [0.1, 0.8, 0.1], [0.0, 0.4, 0.6]]
    row = H.with_stationary(spark.createDataFrame([("k", m)], "k string, p array<array<double>>")).first()
    law = np.array([row["state1"], row["state2"], row["state3"]])
    assert np.allclose(law @ np.array(m), law) and abs(law.sum() - 1) < 1e-12
    df = spark.createDataFrame([("f", "Before", 0.2, 0.1), ("f", "Before", 0.7, None), ("f", "Before", 2.5, 0.4),
                                ("f", "Before", 1.5, None)], "fish string, part string, secs double, x double")
    loose = H.series(df, ["fish"], {"v": "x"}).orderBy("secs").collect()
    assert [(r["secs"], r["time"], r["v"]) for r in loose] == [(1, 1, 0.1), (3, 2, 0.4)]
    strict = H.series(df, ["fish"], {"v": "x"}, na_rm=False).collect()
    assert [(r["secs"], r["time"]) for r in strict] == [(3, 1)]


def test_series_numbers_run_through_stretches(spark, monkeypatch):
    """An entity over many stretches, with gaps, empty stretches and a second shared by two parts."""
    monkeypatch.setattr(H, "STRETCH", 7)
    kept = [s for s in range(200) if s % 5 and not 60 <= s < 90]
    rows = [(f, "After" if s > 100 else "Before", s + 0.5, s / 200) for f in ("a", "b") for s in kept if f == "a" or s > 150]
    rows.append(("a", "Before", 101.7, 0.9))
    df = spark.createDataFrame(rows, "fish string, part string, secs double, x double").repartition(5)
    got = sorted(H.series(df, ["fish"], {"v": "x"}).collect(), key=lambda r: (r["fish"], r["time"]))
    want = [("a", s + 1, p, 0.9 if (s, p) == (101, "Before") else s / 200) for s in kept
            for p in (["After", "Before"] if s == 101 else ["After" if s > 100 else "Before"])]
    want += [("b", s + 1, "After", s / 200) for s in kept if s > 150]
    assert [(r["fish"], r["secs"], r["part"], r["v"]) for r in got] == want
    assert [r["time"] for r in got] == [*range(1, len(kept) + 2), *range(1, len(want) - len(kept))]
    assert H.series(df, ["fish"], {"v": "x"}).columns == ["fish", "part", "secs", "v", "time"]


def test_state_parameters(spark):
    rows = [(f"n_cuex.{s}.state{i}.(Intercept)", math.log(v))
            for i, (a, b) in enumerate(H.SHAPES, 1) for s, v in (("shape1", a), ("shape2", b))]
    got = {r["state"]: r for r in H.state_parameters(spark.createDataFrame(rows, "name string, estimate double")).collect()}
    assert got["state2"]["prec"] == pytest.approx(400.0) and got["state3"]["mean"] == pytest.approx(10 / 13)
    near = H.emission(spark.createDataFrame([(0.2,), (0.5,), (0.8,), (0.0,), (1.0,)], "x double"), "x")
    assert [r[0] for r in near.select(H.nearest_state()).collect()] == [1, 2, 3, 1, 3]
    assert near.where(F.col("log_b1").isNull()).count() == 0


def test_unknown_covariate_cell_is_an_error(spark):
    df = spark.createDataFrame([("f", "During", 0.4, 1)], "fish string, part string, x double, time int")
    with pytest.raises(Exception, match="undeclared covariate cell"):
        H.sequences(df, ["fish"], "x", STRATA).collect()
    with pytest.raises(ValueError):
        H.strata_of(df.withColumn("part", F.lit(None).cast("string")), ["part"])


def test_fit_tells_whether_it_converged(long_steps):
    with pytest.raises(RuntimeError, match="no convergence"):
        H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=2)
    short = H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=2, strict=False)
    assert [r["converged"] for r in short.summary().collect()] == [False, False]
    # the matrices are those of the last logged likelihood
    again = H.loglik(short.seqs, ["fish"], short.tpm, short.strata).agg({"loglik": "sum"}).first()[0]
    assert again == pytest.approx(short.trace[-1], rel=1e-9)
    done = H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=200)
    assert done.converged and done.summary().first()["converged"]


def test_pooling_strength_is_found_from_the_counts(spark, long_steps):
    fit = H.fit_transitions(long_steps, ["fish"], "x", ["part"], max_iter=3, strict=False)
    rng = np.random.default_rng(4)
    rows = []
    for e in range(800):
        c = [rng.multinomial(60, rng.dirichlet(12.0 * np.maximum(row, 1e-6))) for row in fit.tpm[0]]
        rows.append((f"f{e}", 0, [float(v) for v in np.concatenate(c)]))
    counts = spark.createDataFrame(rows, "fish string, s int, c array<double>")
    assert H.pooling_strength(counts, fit) == pytest.approx(12.0, rel=0.3)
    assert H.shrink_by_entity(counts, fit).count() == 800


def test_one_entity_with_half_of_all_steps(spark):
    """Cut in pieces, a long entity gives what it gives in one row."""
    rng = np.random.default_rng(5)
    rows = [((1 << 60) + 1, "After", float(x), i + 1) for i, x in enumerate(rng.beta(3, 4, 6000))]
    rows += [((1 << 60) + 2 + k, ["Before", "After"][i > 90], float(x), i + 1) for k in range(30) for i, x in enumerate(rng.beta(4, 3, 200))]
    df = spark.createDataFrame(rows, "fish bigint, part string, x double, time int").repartition(8)
    one, cut = (H.sequences(df, ["fish"], "x", STRATA, piece_steps=p) for p in (10_000, 512))
    assert one.count() == 31 and cut.count() == 30 + 12 and cut.where("cut").count() == 12

    def both(make, key):
        return [{tuple(r[k] for k in key): r for r in make(seqs).collect()} for seqs in (one, cut)]
    a, b = both(lambda q: H.loglik(q, ["fish"], TPM, STRATA), ["fish"])
    assert a.keys() == b.keys() and all(a[k]["steps"] == b[k]["steps"] and a[k]["loglik"] == pytest.approx(b[k]["loglik"], rel=1e-12) for k in a)
    a, b = both(lambda q: H.expected_counts(q, ["fish"], TPM, STRATA), ["fish", "s"])
    assert a.keys() == b.keys() and all(np.allclose(a[k]["c"], b[k]["c"], rtol=1e-9) for k in a)
    a, b = both(lambda q: H.viterbi(q, ["fish"], TPM, STRATA), ["fish", "time"])
    assert a.keys() == b.keys() and all(a[k]["state"] == b[k]["state"] for k in a)
    a, b = both(lambda q: H.pseudo_residuals(q, ["fish"], TPM, STRATA), ["fish", "time"])
    assert a.keys() == b.keys() and all(a[k]["residual"] == pytest.approx(b[k]["residual"], abs=1e-9) for k in a)
    a, b = both(lambda q: H.pseudo_residuals(q, ["fish"], TPM, STRATA, kind="conditional"), ["fish", "time"])
    assert a.keys() == b.keys() and all(a[k]["residual"] == pytest.approx(b[k]["residual"], abs=1e-8) for k in a)


def crossed_steps(spark, sharp: bool = False):
    """Series of 24 fish over part x treatment whose log odds are additive; ``sharp`` shows the states nearly plainly."""
    rng = np.random.default_rng(11)
    shapes = ((300.0, 2700.0), (1500.0, 1500.0), (2700.0, 300.0)) if sharp else H.SHAPES
    rows, kept = [], {}
    for fish in range(24):
        treatment, z = ["a", "b", "c"][fish % 3], int(rng.integers(3))
        for t in range(1, 161):
            part = "After" if t > 80 else "Before"
            if t > 1:
                eta = -1.6 + 0.7 * (part == "After") + 0.5 * (treatment == "b") - 0.4 * (treatment == "c")
                p = np.array([1.0 if j == z else (0.0 if abs(j - z) == 2 else math.exp(eta)) for j in range(3)])
                new = int(rng.choice(3, p=p / p.sum()))
                kept.setdefault((part, treatment), np.zeros((3, 3)))[z, new] += 1
                z = new
            rows.append((fish, treatment, part, float(rng.beta(*shapes[z])), t))
    df = spark.createDataFrame(rows, "fish int, treatment string, part string, x double, time int").repartition(4)
    return df, shapes, kept


FORMULA = {"strata_cols": ["part", "treatment"], "start": H.START_NEIGHBOURS, "zeros": [(1, 3), (3, 1)], "levels": {"part": ["Before", "After"]}}


def test_full_formula_is_the_saturated_fit(spark):
    df, shapes, _ = crossed_steps(spark)
    for initial in ("uniform", "stationary"):
        full = H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part*treatment", initial=initial, max_iter=6, tol=0.0, strict=False)
        cells = H.fit_transitions(df, ["fish"], "x", **FORMULA, initial=initial, max_iter=6, tol=0.0, strict=False)
        assert len(full.design.names) == 6 and full.coefficients().count() == 24
        assert np.allclose(full.trace, cells.trace, rtol=1e-9) and np.allclose(full.tpm, cells.tpm, atol=1e-5)


def test_additive_formula(spark):
    df, shapes, _ = crossed_steps(spark)
    fit = H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part + treatment", max_iter=200, tol=1e-9)
    assert all(b >= a - 1e-8 for a, b in zip(fit.trace, fit.trace[1:]))
    assert fit.design.names == ("(Intercept)", "partAfter", "treatmentb", "treatmentc")
    odds = {lv: np.log(m[1, 0] / m[1, 1]) for lv, m in zip(fit.strata.levels, fit.tpm)}
    assert all(odds["After", t] - odds["Before", t] == pytest.approx(odds["After", "a"] - odds["Before", "a"], abs=1e-9) for t in "abc")
    # the gradient vanishes at the optimum, and is the likelihood's own: central differences of the log-likelihood
    seqs, beta = fit.seqs, fit.beta + 0.3
    def at(b):
        m = H.L.matrices(fit.design, b)
        return H._rounds(seqs, ["fish"], [(m, H.stationary(m))], H.SHAPES)[0]
    counts, starts, _ = at(beta)
    exact = H.L.score(fit.design, H.L.matrices(fit.design, beta), counts, starts)
    for m, c in ((0, 0), (1, 2), (3, 1)):
        step = np.zeros_like(beta)
        step[m, c] = 1e-4
        assert exact[m, c] == pytest.approx((at(beta + step)[2] - at(beta - step)[2]) / 2e-4, rel=1e-5, abs=1e-5)


def test_stationary_start_never_lowers_the_likelihood(spark):
    """Two steps a fish, so that the start law carries much of the likelihood."""
    df, *_ = crossed_steps(spark)
    short = df.where("time in (80, 81)").withColumn("time", F.col("time") - 79)
    for formula in (None, "part"):
        fit = H.fit_transitions(short, ["fish"], "x", ["part"], max_iter=30, tol=0.0, strict=False, formula=formula)
        assert all(b >= a - 1e-9 for a, b in zip(fit.trace, fit.trace[1:])) and fit.trace[-1] > fit.trace[0]


def test_information_and_draws_when_the_states_are_plain(spark):
    """Nearly nothing is hidden: the information is that of a multinomial regression on the moves made."""
    df, shapes, kept = crossed_steps(spark, sharp=True)
    fit = H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part + treatment", shapes=shapes, initial="uniform", tol=1e-12)
    info = H.information(fit)
    totals = np.stack([kept[lv].sum(axis=1) for lv in fit.strata.levels])
    assert np.allclose(info, H.L.curvature(fit.design, fit.tpm, totals), rtol=1e-3, atol=1e-3)
    cov = H.covariance(info)
    table = {(r["from"], r["to"], r["term"]): r for r in H.coefficient_table(fit, info).collect()}
    truth = {"(Intercept)": -1.6, "partAfter": 0.7, "treatmentb": 0.5, "treatmentc": -0.4}
    assert len(table) == 16 and all(abs(r["estimate"] - truth[k[2]]) < 4 * r["se"] for k, r in table.items())
    d = H.law_draws(fit, info, reps=2000).cache()
    assert d.count() == 2000 * 6
    first = d.where("part = 'Before' and treatment = 'a'").select(F.log(F.col("p")[1][0] / F.col("p")[1][1]).alias("o"))
    row = first.agg(F.avg("o"), F.stddev("o")).first()
    at = [m for m, ij in enumerate(fit.design.moves) if ij == (1, 0)][0] * 4
    assert row[0] == pytest.approx(fit.beta.ravel()[at], abs=0.1 * math.sqrt(cov[at, at])) and row[1] == pytest.approx(math.sqrt(cov[at, at]), rel=0.08)
    again = H.law_draws(fit, info, reps=2000).repartition(3)
    assert d.exceptAll(again).isEmpty()
    states = H.state_interval(H.marginal_draws(fit.counts(), d.where("draw <= 50"), fit, strength=5.0), ["part", "treatment"])
    assert states.count() == 18


def test_formula_errors(spark):
    df, *_ = crossed_steps(spark)
    with pytest.raises(ValueError, match="no covariate"):
        H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part + tank")
    with pytest.raises(ValueError, match="staying"):
        H.L.design_of(("part",), [("A",)], "part", np.ones((3, 3)) - np.eye(3))
    with pytest.raises(ValueError, match="not positive definite"):
        H.covariance(np.diag([1.0, 0.0]))


def test_information_with_an_entity_in_pieces(spark, monkeypatch):
    df, *_ = crossed_steps(spark)
    whole = H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part", max_iter=3, tol=0.0, strict=False)
    monkeypatch.setattr(H.sequences, "__defaults__", ("time", 50))
    cut = H.fit_transitions(df, ["fish"], "x", **FORMULA, formula="part", max_iter=3, tol=0.0, strict=False)
    assert cut.seqs.where("cut").count() > 24 and np.allclose(cut.trace, whole.trace, rtol=1e-10)
    stacks = [(m, H.stationary(m)) for m in (whole.tpm, H._normalise(whole.tpm + 0.05 * (whole.tpm > 0), whole.tpm))]
    for a, b in zip(H._rounds(cut.seqs, ["fish"], stacks, H.SHAPES), H._rounds(whole.seqs, ["fish"], stacks, H.SHAPES)):
        assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(a, b))
