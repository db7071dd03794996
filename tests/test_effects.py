"""Entity intercepts on the transitions: planted scatter, the modes' own condition, entities in pieces."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shoalspark.models import effects as E
from shoalspark.models import hmm as H

OPTIONS = {"strata_cols": ["part"], "formula": "part", "start": H.START_NEIGHBOURS, "zeros": [(1, 3), (3, 1)], "levels": {"part": ["Before", "After"]}}


def scattered_steps(spark, entities: int, steps: int, sd: float, seed: int = 4):
    """Series whose log odds of a move are -1.2, one 0.6 higher After, plus an intercept of the entity and move."""
    rng = np.random.default_rng(seed)
    rows, planted = [], {}
    for fish in range(entities):
        b = {m: float(rng.normal(0, sd)) for m in ((0, 1), (1, 0), (1, 2), (2, 1))}
        planted[fish] = b
        z = int(rng.integers(3))
        for t in range(1, steps + 1):
            part = "After" if t > steps // 2 else "Before"
            if t > 1:
                odds = np.array([1.0 if j == z else math.exp(-1.2 + 0.6 * (part == "After") + b[z, j]) if (z, j) in b else 0.0 for j in range(3)])
                z = int(rng.choice(3, p=odds / odds.sum()))
            rows.append((fish, part, float(rng.beta(*H.SHAPES[z])), t))
    return spark.createDataFrame(rows, "fish int, part string, x double, time int").repartition(4, "fish"), planted


@pytest.fixture(scope="module")
def fitted(spark):
    df, planted = scattered_steps(spark, 160, 120, 0.8)
    return E.fit_effects(df, ["fish"], "x", tol=1e-6, **OPTIONS), planted


def test_planted_scatter_is_found(fitted):
    fit, planted = fitted
    assert fit.converged
    sd = {(r["from"], r["to"]): r["sd"] for r in fit.deviations().collect()}
    assert len(sd) == 4 and all(0.55 < v < 1.05 for v in sd.values())
    for r in fit.coefficients().collect():
        assert r["estimate"] == pytest.approx(-1.2 if r["term"] == "(Intercept)" else 0.6, abs=0.3)
    rows = fit.effects().collect()
    assert len(rows) == 4 * len(planted)
    got = np.array([(r["effect"], planted[r["fish"]][int(r["from"][-1]) - 1, int(r["to"][-1]) - 1], r["se"]) for r in rows])
    assert np.corrcoef(got[:, 0], got[:, 1])[0, 1] > 0.7
    assert 0.8 < np.mean(np.abs(got[:, 0] - got[:, 1]) < 1.96 * got[:, 2]) <= 1.0
    # an iterated variance agrees with its own definition
    for (a, b), v in sd.items():
        mine = [(r["effect"], r["se"]) for r in rows if (r["from"], r["to"]) == (a, b)]
        assert np.mean([e * e + s * s for e, s in mine]) == pytest.approx(v * v, rel=0.03)


def test_modes_are_stationary_points(fitted):
    """The gradient of an entity's own penalised log-likelihood, by differences, vanishes at its intercepts."""
    fit, _ = fitted
    law = fit.law
    b = {r["key"]: np.array(r["b"]) for r in fit.modes_by_key.collect()}
    for r in fit.seqs.limit(3).collect():
        x, s, lens = H._pad([r["x"]], [r["s"]])

        def value(m):
            return float(E._expected(law, m[None], x, s, lens)[2][0] - 0.5 * (m * m * law.precision).sum())
        mode = b[r["__key"]]
        for e in np.eye(len(mode)) * 1e-4:
            assert (value(mode + e) - value(mode - e)) / 2e-4 == pytest.approx(0.0, abs=1e-3)


def test_matrices_by_entity(fitted):
    fit, planted = fitted
    rows = fit.transitions().collect()
    assert len(rows) == 2 * len(planted) and {r["part"] for r in rows} == {"Before", "After"}
    b = {r["key"]: np.array(r["b"]) for r in fit.modes_by_key.collect()}
    for r in rows[:10]:
        stack = fit.law.stack(b[f'{{"fish":{r["fish"]}}}'][None])[0]
        assert np.allclose(r["p"], stack[[lv[0] for lv in fit.strata.levels].index(r["part"])])
        assert r["p"][0][2] == 0 and r["p"][2][0] == 0


def test_entities_in_pieces(spark):
    """Cut in pieces, entities reach the same fit; some of them stay whole."""
    df, _ = scattered_steps(spark, 12, 90, 0.7, 9)
    df = df.where("fish > 4 or time <= 25")
    whole, cut = (E.fit_effects(df, ["fish"], "x", tol=1e-9, max_iter=6, strict=False, inner_tol=1e-9, piece_steps=p, **OPTIONS) for p in (1000, 30))
    assert cut.seqs.where("cut").count() == 7 * 3 and not whole.seqs.where("cut").count()
    # the same law: sums of both ways agree once the intercepts in pieces have settled
    table = cut.modes_by_key.where("se is not null").join(cut.seqs.where("cut").select("__key").distinct().withColumnRenamed("__key", "key"), "key").select("key", "b")
    for _ in range(8):
        told = E._pieced(cut.seqs.where("cut"), table, whole.law)
        table = told.select("key", "b")
    want = {r["key"]: r for r in whole.modes_by_key.collect()}
    got = {r["key"]: r for r in told.collect()}
    assert len(got) == 7
    for k, r in got.items():
        assert np.allclose(r["b"], want[k]["b"], atol=2e-4) and np.allclose(r["se"], want[k]["se"], atol=1e-3)


def test_one_step_is_the_penalised_newton_step(spark):
    df, _ = scattered_steps(spark, 6, 40, 0.7)
    strata = H.strata_of(df, ["part"])
    seqs = H.sequences(df, ["fish"], "x", strata)
    counts = {}
    for r in H.expected_counts(seqs, ["fish"], H.START, strata, "uniform").collect():
        counts[r["fish"]] = counts.get(r["fish"], 0) + np.array(r["c"]).reshape(3, 3)
    p = np.array(H.START)
    got = {(r["fish"], r["from"], r["to"]): r["effect"] for r in E.one_step(seqs, ["fish"], H.START, strata, 0.5).collect()}
    assert len(got) == 6 * 6
    for fish, c in counts.items():
        for i in range(3):
            js = [j for j in range(3) if j != i]
            n = c[i].sum()
            bend = n * (np.diag(p[i, js]) - np.outer(p[i, js], p[i, js])) + np.eye(2) / 0.25
            for j, v in zip(js, np.linalg.solve(bend, c[i, js] - n * p[i, js])):
                assert got[fish, f"state{i + 1}", f"state{j + 1}"] == pytest.approx(v, abs=1e-9)


def test_no_scatter_shrinks_and_errors_are_told(spark):
    df, _ = scattered_steps(spark, 40, 60, 0.0, 2)
    fit = E.fit_effects(df, ["fish"], "x", max_iter=12, strict=False, **OPTIONS)
    assert max(fit.law.sd) < 0.45
    with pytest.raises(RuntimeError, match="no convergence"):
        E.fit_effects(df, ["fish"], "x", max_iter=2, tol=0.0, **OPTIONS)
    with pytest.raises(RuntimeError, match="still move"):
        E.fit_effects(df, ["fish"], "x", inner=1, inner_tol=1e-12, **OPTIONS)
