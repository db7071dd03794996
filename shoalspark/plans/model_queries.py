"""Named queries for the regression, mixed and hidden Markov models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoalspark.functions import expr as X
from shoalspark.models import effects
from shoalspark.models import hmm as H
from shoalspark.models.gamma import gamma_glm as fit_gamma
from shoalspark.models.lmm import compare_models, lmm, lmm_candidates
from shoalspark.models.ols import ols
from shoalspark.models.sparse import sparse_ols
from shoalspark.operators import enrich as E
from shoalspark.operators import reshape as RS
from shoalspark.operators import summary as SM
from shoalspark.plans.catalog import FISH, cue_minute, cue_part, frames, query, speed_minute_table
from shoalspark.sources.tables import TREATMENTS, load
from shoalspark.staging import small_side, stage

LEVELS = {"part": list(E.PARTS), "treatment": list(TREATMENTS), "fishSide": ["nocue", "cue"]}

# fixed values: the candidate fixed parts of the studies
SPEED_CANDIDATES = [
    "m1 ~ part*treatment*minute_centered",
    "m1 ~ part*treatment + minute_centered",
    "m1 ~ part + treatment*minute_centered",
    "m1 ~ part*minute_centered + treatment",
    "m1 ~ part + minute_centered + treatment",
]
ONE_TREATMENT_CANDIDATES = ["m1 ~ part*minute_centered", "m1 ~ part + minute_centered"]
CUE_CANDIDATES = [
    "time ~ part*fishSide*minute_centered",
    "time ~ part*fishSide + minute_centered",
    "time ~ part + fishSide*minute_centered",
    "time ~ part*minute_centered + fishSide",
    "time ~ part + minute_centered + fishSide",
]
PLAIN_CUE_CANDIDATES = ["time ~ part*fishSide", "time ~ part + fishSide"]


# --- tables the models are fitted to; each is aggregated once and staged


def share_rows(spark, sf_dir):
    """Cue share per fish and minute with the minute within its period."""
    df = E.with_part_from_minute(cue_minute(spark, sf_dir))
    df = E.with_key(df, FISH, "fish_id")
    return stage(df.select("fish_id", "treatment", "part", "minute", "minute_relative", "sum", "ratioside"))


def speed_rows(spark, sf_dir):
    df = E.with_key(speed_minute_table(spark, sf_dir), FISH, "fish_id")
    df = stage(df.select("fish_id", "treatment", "part", "minute", "m1"))
    return RS.center(df, "minute", ["part"])


def compartment_rows(spark, sf_dir):
    df = E.with_key(RS.compartment_long(cue_minute(spark, sf_dir)), FISH, "fish_id")
    df = stage(df.select("fish_id", "treatment", "part", "minute", "time", F.col("compartment").alias("fishSide")))
    return RS.center(df, "minute", ["part"])


def part_compartments(spark, sf_dir):
    """Seconds per fish, period and compartment."""
    df = RS.compartment_long(cue_part(spark, sf_dir), [*FISH, "part"])
    return E.with_key(df, FISH, "fish_id").select("fish_id", "treatment", "part", "time", F.col("compartment").alias("fishSide"))


def share_fit(spark, sf_dir):
    df = share_rows(spark, sf_dir)
    return df, lmm(df, "ratioside ~ minute_relative*part", "fish_id", levels=LEVELS)


def speed_fits(spark, sf_dir, candidates=tuple(SPEED_CANDIDATES)):
    df = speed_rows(spark, sf_dir)
    return df, lmm_candidates(df, list(candidates), "fish_id", levels=LEVELS)


# --- least squares


@query
def ols_part(spark, sf_dir):
    return ols(cue_minute(spark, sf_dir), "sum ~ part", levels=LEVELS).coef()


def by_day(spark, sf_dir, formula):
    """A factor of some 2500 levels, as many at any scale."""
    return sparse_ols(load(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), formula)


@query
def ols_day_levels(spark, sf_dir):
    """Every day's mean quantity against the first day's, with standard errors."""
    return by_day(spark, sf_dir, "l_quantity ~ day").coef().select("term", "estimate", "se", "df")


@query
def ols_day_anova(spark, sf_dir):
    return by_day(spark, sf_dir, "l_discount ~ day").anova().select("term", "df", "sum_sq", "f")


@query
def ols_part_anova(spark, sf_dir):
    return ols(cue_minute(spark, sf_dir), "sum ~ part", levels=LEVELS).anova()


@query
def ols_part_stats(spark, sf_dir):
    return ols(cue_minute(spark, sf_dir), "sum ~ part", levels=LEVELS).fit_stats()


# --- mixed models: the share study is balanced, so SQL has closed forms for it


@query
def lmm_fit(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].coef().select("term", "estimate", "se")


@query
def lmm_coef_tests(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].coef()


@query
def lmm_variance(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].variance().select("n", "var_group", "var_resid", "criterion", "aic", "singular")


@query
def lmm_anova(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].anova()


@query
def lmm_r2(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].r2()


@query
def lmm_effects(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].effects().select("fish_id", "effect")


@query
def lmm_residuals(spark, sf_dir):
    df, fit = share_fit(spark, sf_dir)
    return fit.residuals(df).select("fish_id", "minute", "fitted", "resid")


@query
def lmm_residual_histogram(spark, sf_dir):
    df, fit = share_fit(spark, sf_dir)
    return fit.residual_histogram(df, 30)


@query
def lmm_residual_qq(spark, sf_dir):
    df, fit = share_fit(spark, sf_dir)
    return fit.qq(df)


@query
def lmm_emmeans(spark, sf_dir):
    return share_fit(spark, sf_dir)[1].emmeans(["part"]).select("part", "emmean", "se", "df")


@query
def lmm_contrasts(spark, sf_dir):
    fit = share_fit(spark, sf_dir)[1]
    return fit.contrasts(["part"], "part", reverse=True).drop("p_tukey")


def share_by_treatment(spark, sf_dir):
    return lmm(share_rows(spark, sf_dir), "ratioside ~ part*treatment", "fish_id", levels=LEVELS)


@query
def lmm_share_anova(spark, sf_dir):
    """F tests of a within-fish factor, a between-fish factor of three levels and their interaction."""
    return share_by_treatment(spark, sf_dir).anova()


@query
def lmm_share_contrasts(spark, sf_dir):
    """All pairs of three treatments."""
    return share_by_treatment(spark, sf_dir).contrasts(["treatment"], "treatment").drop("p_tukey")


@query
def lmm_predict(spark, sf_dir):
    fit = share_fit(spark, sf_dir)[1]
    grid = fit.grid({"minute_relative": range(1, 11), "part": LEVELS["part"]})
    return fit.predict(grid)


@query
def lmm_speed_part(spark, sf_dir):
    """Speed by period with fish of unequal size: coefficients and variance parts in one row."""
    fit = lmm(speed_rows(spark, sf_dir), "m1 ~ part", "fish_id", levels=LEVELS)
    (b0, b1), (se0, se1) = fit.beta, np.sqrt(np.diag(fit.vcov))
    cols = {"b0": b0, "se0": se0, "b1": b1, "se1": se1}
    return fit.variance().select("n", "var_group", "var_resid", "criterion",
                                 *[F.lit(float(v)).alias(c) for c, v in cols.items()])


@query
def lmm_speed_compare(spark, sf_dir):
    return compare_models(speed_fits(spark, sf_dir)[1])


@query
def lmm_speed_one_treatment(spark, sf_dir):
    df = speed_rows(spark, sf_dir).where(F.col("treatment") == "C8AHL")
    return compare_models(lmm_candidates(df, ONE_TREATMENT_CANDIDATES, "fish_id", levels=LEVELS))


@query
def lmm_speed_reference_level(spark, sf_dir):
    """Speed over minutes by treatment with the control as reference level."""
    df = speed_rows(spark, sf_dir).where(F.col("treatment").isin("C8AHL", "C8DMS0"))
    return lmm(df, "m1 ~ minute*treatment", "fish_id", levels={"treatment": ["C8DMS0", "C8AHL"]}).coef()


@query
def lmm_speed_anova(spark, sf_dir):
    return speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])[1][0].anova()


@query
def lmm_speed_vif(spark, sf_dir):
    return speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])[1][0].vif()


@query
def lmm_speed_emmeans(spark, sf_dir):
    """Means and SE bars of the full model at chosen centred minutes."""
    fit = speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])[1][0]
    em = fit.emmeans(["part", "treatment", "minute_centered"], at={"minute_centered": [-4.5, 0.0, 4.5]})
    return SM.with_bands(em, "emmean", ["se"])


@query
def lmm_speed_contrasts(spark, sf_dir):
    fit = speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])[1][0]
    return fit.contrasts(["part", "treatment"], "treatment")


@query
def lmm_speed_predict(spark, sf_dir):
    """Prediction ribbon of the full model on the session clock."""
    df, (fit,) = speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])
    grid = fit.grid({"minute_centered": [-4.5 + i for i in range(10)], "treatment": LEVELS["treatment"],
                     "part": LEVELS["part"]})
    means = small_side(df.groupBy("part").agg(F.avg("minute").alias("mean_minute")))
    return RS.real_minute(fit.predict(grid).join(means, "part", "left"), ceil=True)


@query
def lmm_speed_checks(spark, sf_dir):
    df, fits = speed_fits(spark, sf_dir, SPEED_CANDIDATES[:1])
    return fits[0].checks(df)


@query
def lmm_cue_compare(spark, sf_dir):
    df = compartment_rows(spark, sf_dir)
    return compare_models(lmm_candidates(df, CUE_CANDIDATES, "fish_id", levels=LEVELS))


@query
def lmm_cue_plain(spark, sf_dir):
    df = stage(part_compartments(spark, sf_dir))
    return compare_models(lmm_candidates(df, PLAIN_CUE_CANDIDATES, "fish_id", levels=LEVELS))


@query
def cue_percent_prediction(spark, sf_dir):
    """Predicted seconds per compartment with limits, as percent of a period under display labels."""
    df = stage(part_compartments(spark, sf_dir))
    fit = lmm(df, PLAIN_CUE_CANDIDATES[0], "fish_id", levels=LEVELS)
    out = fit.predict(fit.grid({"part": LEVELS["part"], "fishSide": LEVELS["fishSide"]}))
    for c in ("predicted", "conf_low", "conf_high"):
        out = E.with_percent(out, c, 600.0, c)
    return E.recode(out, "fishSide", {"cue": "menthe", "nocue": "edm"}).select(
        "part", "fishSide", "predicted", "conf_low", "conf_high")


@query
def lmm_lineitem(spark, sf_dir):
    """The same model form on the largest table: supplier as entity."""
    df = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    return lmm(df, "l_quantity ~ l_returnflag*l_linestatus*l_discount", "l_suppkey",
               levels={"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}).coef()


@query
def gamma_glm(spark, sf_dir):
    """Seconds per fish, period and compartment; the offset keeps a compartment never visited in the model."""
    return fit_gamma(part_compartments(spark, sf_dir), "time ~ part + fishSide", levels=LEVELS, offset=0.5)


# --- hidden Markov model


def one_hertz(spark, sf_dir, na_rm=True):
    return H.series(frames(spark, sf_dir), FISH, {"n_cuex": "cue_x", "n_y": "olf_y"}, by=["part"], na_rm=na_rm)


def packed(spark, sf_dir):
    df = one_hertz(spark, sf_dir)
    strata = H.Strata(("part",), (("After",), ("Before",)))
    return H.sequences(df, FISH, "n_cuex", strata), strata


def hmm_fit(spark, sf_dir):
    """Transitions by part and treatment without the direct 1-3 and 3-1 moves."""
    return H.fit_transitions(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part", "treatment"], H.START_NEIGHBOURS,
                             zeros=[(1, 3), (3, 1)], max_iter=300, tol=1e-7)


def hard_matrices(spark, sf_dir):
    """Transition matrix per fish and part from the nearest state of each second, one added to each count."""
    df = H.emission(one_hertz(spark, sf_dir), "n_cuex").withColumn("to", H.nearest_state())
    steps = df.withColumn("from", F.lag("to").over(Window.partitionBy(*FISH).orderBy("time"))).where("from is not null")
    counts = steps.groupBy(*FISH, "part").agg(F.array(*[
        F.count_if((F.col("from") == i) & (F.col("to") == j)).cast("double") + 1
        for i in (1, 2, 3) for j in (1, 2, 3)]).alias("c"))
    return H.normalise_counts(counts).select(*FISH, "part", "p")


@query
def hmm_series(spark, sf_dir):
    return one_hertz(spark, sf_dir)


@query
def hmm_series_strict(spark, sf_dir):
    return one_hertz(spark, sf_dir, na_rm=False)


@query
def hmm_emission(spark, sf_dir):
    return H.emission(one_hertz(spark, sf_dir), "n_cuex").drop("n_y", "secs")


@query
def hmm_loglik(spark, sf_dir):
    seqs, strata = packed(spark, sf_dir)
    return H.loglik(seqs, FISH, H.START, strata, "uniform")


@query
def hmm_viterbi(spark, sf_dir):
    seqs, strata = packed(spark, sf_dir)
    return H.viterbi(seqs, FISH, H.START, strata, "uniform").select(*FISH, "time", "state")


@query
def hmm_em_step(spark, sf_dir):
    """One round of the fit from the starting matrix: expected counts per part, then normalised."""
    seqs, strata = packed(spark, sf_dir)
    counts = H.expected_counts(seqs, FISH, H.START, strata, "uniform")
    total = counts.groupBy("s").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(9)]).alias("c"))
    part = F.array(*[F.lit(lv[0]) for lv in strata.levels])[F.col("s")]
    return H.tpm_long(H.normalise_counts(total).withColumn("part", part), ["part"])


@query
def hmm_em_three(spark, sf_dir):
    """Three updates of the matrices by part and treatment without the direct moves, from a fixed start law."""
    fit = H.fit_transitions(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part", "treatment"], H.START_NEIGHBOURS,
                            zeros=[(1, 3), (3, 1)], max_iter=4, tol=0.0, initial="uniform", strict=False)
    return H.tpm_long(fit.transitions(), ["part", "treatment"])


def additive_fit(spark, sf_dir, **options):
    """Log odds of the moves additive in part and treatment, without the direct moves."""
    return H.fit_transitions(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part", "treatment"], H.START_NEIGHBOURS, zeros=[(1, 3), (3, 1)],
                             formula="part + treatment", levels={"part": ["Before", "After"]}, **options)


@query
def hmm_additive_step(spark, sf_dir):
    """One Newton step of the additive log odds from the starting matrix, from a fixed start law."""
    fit = additive_fit(spark, sf_dir, max_iter=2, tol=0.0, initial="uniform", strict=False, newton=1)
    return H.tpm_long(fit.transitions(), ["part", "treatment"])


@query
def hmm_additive_transitions(spark, sf_dir):
    return H.tpm_long(additive_fit(spark, sf_dir, max_iter=300, tol=1e-7).transitions(), ["part", "treatment"])


@query
def hmm_additive_coefficients(spark, sf_dir):
    """Coefficients of the additive log odds with standard errors from the observed information."""
    fit = additive_fit(spark, sf_dir, max_iter=300, tol=1e-7)
    return H.coefficient_table(fit, H.information(fit))


@query
def hmm_law_state_interval(spark, sf_dir):
    """Interval of each state's probability from 1000 normal draws of the coefficients."""
    fit = additive_fit(spark, sf_dir, max_iter=300, tol=1e-7)
    return H.state_interval(H.with_stationary(stage(H.law_draws(fit, H.information(fit)))), ["part", "treatment"])


@query
def hmm_entity_given(spark, sf_dir):
    """Matrices per fish under given ones, pooled as strongly as the counts suggest."""
    fit = H.fit_transitions(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part", "treatment"], H.START_NEIGHBOURS,
                            zeros=[(1, 3), (3, 1)], max_iter=1, initial="uniform", strict=False)
    return H.tpm_long(H.shrink_by_entity(stage(fit.counts()), fit), [*FISH, "part"])


@query
def hmm_transitions(spark, sf_dir):
    return H.tpm_long(hmm_fit(spark, sf_dir).transitions(), ["part", "treatment"])


@query
def hmm_transitions_by_part(spark, sf_dir):
    fit = H.fit_transitions(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part"], max_iter=300, tol=1e-7)
    return H.tpm_long(fit.transitions(), ["part"])


@query
def hmm_fit_trace(spark, sf_dir):
    return hmm_fit(spark, sf_dir).summary()


@query
def hmm_entity_transitions(spark, sf_dir):
    fit = hmm_fit(spark, sf_dir)
    return H.tpm_long(H.shrink_by_entity(fit.counts(), fit), [*FISH, "part"])


@query
def hmm_decoded_share(spark, sf_dir):
    """Seconds decoded in each state, by part and treatment, under the fitted matrices."""
    fit = hmm_fit(spark, sf_dir)
    path = H.viterbi(fit.seqs, fit.entity, fit.tpm, fit.strata)
    seconds = path.groupBy("s", "state").agg(F.count("*").alias("seconds"))
    labels = {c: F.array(*[F.lit(lv[i]) for lv in fit.strata.levels])[F.col("s")] for i, c in enumerate(fit.strata.cols)}
    return seconds.select(labels["part"].alias("part"), labels["treatment"].alias("treatment"), "state", "seconds")


@query
def hmm_pseudo_residuals(spark, sf_dir):
    fit = hmm_fit(spark, sf_dir)
    return H.pseudo_residuals(fit.seqs, fit.entity, fit.tpm, fit.strata)


@query
def hmm_forecast_residuals(spark, sf_dir):
    """Pseudo-residuals under the starting matrix."""
    seqs, strata = packed(spark, sf_dir)
    return H.pseudo_residuals(seqs, FISH, H.START, strata, "uniform")


@query
def hmm_conditional_residuals(spark, sf_dir):
    """Pseudo-residuals given all other seconds of a fish, under the starting matrix."""
    seqs, strata = packed(spark, sf_dir)
    return H.pseudo_residuals(seqs, FISH, H.START, strata, "uniform", kind="conditional")


def effect_fit(spark, sf_dir, **options):
    """Log odds of the moves by part, plus normal intercepts of the fish, without the direct moves."""
    return effects.fit_effects(one_hertz(spark, sf_dir), FISH, "n_cuex", ["part"], "part", H.START_NEIGHBOURS, zeros=[(1, 3), (3, 1)],
                         levels={"part": ["Before", "After"]}, max_iter=300, tol=1e-6, **options)


@query
def hmm_effect_step(spark, sf_dir):
    """Intercepts of every fish after one penalised Newton step from the starting matrix."""
    seqs, strata = packed(spark, sf_dir)
    return effects.one_step(seqs, FISH, H.START, strata, 0.5)


@query
def hmm_effect_deviations(spark, sf_dir):
    """How far fish scatter in the log odds of each move."""
    return effect_fit(spark, sf_dir).deviations()


@query
def hmm_effect_transitions(spark, sf_dir):
    """Matrix of every fish and part under a fit with fish intercepts."""
    return H.tpm_long(effect_fit(spark, sf_dir).transitions(), [*FISH, "part"])


@query
def hmm_stationary(spark, sf_dir):
    return H.with_stationary(hard_matrices(spark, sf_dir)).drop("p")


@query
def hmm_tpm_long(spark, sf_dir):
    return H.tpm_long(hard_matrices(spark, sf_dir), [*FISH, "part"])


@query
def hmm_state_interval(spark, sf_dir):
    """Interval of each state's probability with every fish as one draw."""
    laws = stage(H.with_stationary(hard_matrices(spark, sf_dir)).drop("p"))
    return H.state_interval(laws, ["part", "treatment"])


@query
def hmm_transition_interval(spark, sf_dir):
    out = H.transition_interval(stage(hard_matrices(spark, sf_dir)), ["part", "treatment"])
    return out.withColumn("step", F.concat_ws("->", "from", "to"))


def fitted_draws(spark, sf_dir):
    fit = hmm_fit(spark, sf_dir)
    counts = stage(fit.counts())
    return fit, counts, stage(H.draws(counts, fit, reps=1000))


@query
def hmm_draw_state_interval(spark, sf_dir):
    """Marginal interval per part and treatment from 1000 resampled fits, averaged over fish."""
    fit, counts, d = fitted_draws(spark, sf_dir)
    return H.state_interval(stage(H.marginal_draws(counts, d, fit)), ["part", "treatment"])


@query
def hmm_draw_transition_interval(spark, sf_dir):
    fit, counts, d = fitted_draws(spark, sf_dir)
    return H.transition_interval(stage(H.marginal_draws(counts, d, fit)), ["part", "treatment"])


@query
def hmm_entity_state_interval(spark, sf_dir):
    fit, counts, d = fitted_draws(spark, sf_dir)
    return H.entity_state_interval(counts, d, fit)


@query
def hmm_state_parameters(spark, sf_dir):
    """Beta shapes per nearest state by moments, written as named log coefficients and read back."""
    df = H.emission(one_hertz(spark, sf_dir), "n_cuex").withColumn("state", H.nearest_state())
    m, v = F.col("m"), F.col("v")
    per = df.groupBy("state").agg(F.avg("n_cuex").alias("m"), F.var_samp("n_cuex").alias("v"))
    shape1, shape2 = X.prec_to_shape(m, m * (1 - m) / v - 1)
    name = F.concat(F.lit("n_cuex."), F.col("variable"), F.lit(".state"), F.col("state"), F.lit(".(Intercept)"))
    coef = per.select("state", F.ln(shape1).alias("shape1"), F.ln(shape2).alias("shape2")) \
        .unpivot(["state"], ["shape1", "shape2"], "variable", "estimate") \
        .select(name.alias("name"), "estimate")
    return H.state_parameters(coef)


@query
def hmm_density(spark, sf_dir):
    return SM.density_vs_states(one_hertz(spark, sf_dir), "n_cuex", H.SHAPES, 50)
