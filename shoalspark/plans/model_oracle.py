"""SQL twins of the model queries."""

from __future__ import annotations

from shoalspark.plans.oracle import CUE_MINUTE, CUE_PART, FRAMES, SPEED, quantile_ctes, t_tail, twin

# --- least squares of seconds in the cue on the part
OLS = CUE_MINUTE + """, two AS (
  SELECT count(*) FILTER (part = 'Before') AS n1, count(*) FILTER (part = 'After') AS n2,
    avg(sum) FILTER (part = 'Before') AS m1, avg(sum) FILTER (part = 'After') AS m2,
    var_pop(sum) FILTER (part = 'Before') * count(*) FILTER (part = 'Before')
      + var_pop(sum) FILTER (part = 'After') * count(*) FILTER (part = 'After') AS rss,
    var_pop(sum) * count(*) AS tss, count(*) AS n FROM cue_minute
), fit AS (
  SELECT *, rss / (n - 2) AS s2, (tss - rss) / (rss / (n - 2)) AS f FROM two
), coefs AS (
  SELECT '(Intercept)' AS term, m1 AS estimate, sqrt(s2 / n1) AS se, CAST(n - 2 AS INTEGER) AS df FROM fit
  UNION ALL
  SELECT 'partAfter', m2 - m1, sqrt(s2 / n1 + s2 / n2), CAST(n - 2 AS INTEGER) FROM fit
)"""
twin("ols_part", OLS, f"SELECT *, {t_tail('t', 'df')} AS p FROM (SELECT *, estimate / se AS t FROM coefs) AS c",
     "estimate se t p")


def by_day(y: str) -> str:
    return f"""work AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, {y} AS y FROM lineitem WHERE l_shipdate IS NOT NULL AND {y} IS NOT NULL
), days AS (SELECT day, avg(y) AS m, count(*) AS n, sum(y) AS total FROM work GROUP BY day
), spread AS (SELECT sum((y - m) * (y - m)) AS rss, count(*) - count(DISTINCT day) AS df, count(DISTINCT day) - 1 AS k FROM work JOIN days USING (day)
), base AS (SELECT m AS m0, n AS n0 FROM days ORDER BY day LIMIT 1)"""


twin("ols_day_levels", by_day("l_quantity"),
     """SELECT CASE WHEN day = (SELECT min(day) FROM days) THEN '(Intercept)' ELSE 'day' || day END AS term,
       CASE WHEN day = (SELECT min(day) FROM days) THEN m0 ELSE m - m0 END AS estimate,
       sqrt(rss / df * (1e0 / n0 + CASE WHEN day = (SELECT min(day) FROM days) THEN 0 ELSE 1e0 / n END)) AS se, CAST(df AS INTEGER) AS df
     FROM days, spread, base""", "estimate se")
twin("ols_day_anova", by_day("l_discount") + """, between AS (
  SELECT sum(n * (m - g) * (m - g)) AS ss FROM days, (SELECT avg(y) AS g FROM work) AS w
)""", """SELECT 'day' AS term, CAST(k AS INTEGER) AS df, ss AS sum_sq, ss / k / (rss / df) AS f FROM between, spread
     UNION ALL SELECT 'Residuals', CAST(df AS INTEGER), rss, NULL FROM spread""", "sum_sq f")
twin("ols_part_anova", OLS,
     f"""SELECT 'part' AS term, CAST(1 AS INTEGER) AS df, tss - rss AS sum_sq, f, {t_tail('sqrt(f)', '(n - 2)')} AS p FROM fit
     UNION ALL SELECT 'Residuals', CAST(n - 2 AS INTEGER), rss, NULL, NULL FROM fit""", "sum_sq f p")
twin("ols_part_stats", OLS,
     """SELECT n, sqrt(s2) AS sigma, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / (n - 2) AS r2_adjusted,
       (tss - rss) / (n - 1) / ((tss - rss) / (n - 1) + s2) AS r2_marginal FROM fit""",
     "sigma r2 r2_adjusted r2_marginal")

# --- share ~ minute_relative * part + (1 | fish). Every fish has the same 20 rows, so the fixed part is
# least squares per part and the variance parts follow from the within and between mean squares.
LMM = CUE_MINUTE + """, rel AS (
  SELECT fish || '_' || treatment AS fish_id, part, minute, ratioside AS y,
    CASE WHEN minute > 10 THEN minute - 10 ELSE minute END AS m FROM cue_minute
), lines AS (
  SELECT part, regr_slope(y, m) AS slope, regr_intercept(y, m) AS icept FROM rel GROUP BY part
), fixed AS (
  SELECT r.*, icept + slope * m AS fix, y - (icept + slope * m) AS e FROM rel AS r JOIN lines USING (part)
), fish_mean AS (
  SELECT fish_id, avg(e) AS eb FROM fixed GROUP BY fish_id
), ms AS (
  SELECT (SELECT count(*) FROM fish_mean) AS g,
    (SELECT 20 * sum(eb * eb) FROM fish_mean) AS ssb,
    (SELECT sum((e - eb) * (e - eb)) FROM fixed JOIN fish_mean USING (fish_id)) AS ssw
), ratio AS (
  SELECT *, greatest(0e0, (ssb / (g - 1) / (ssw / (20 * g - g - 3)) - 1) / 20) AS theta FROM ms
), vars AS (
  SELECT *, (ssw + ssb / (1 + 20 * theta)) / (20 * g - 4) AS s2,
    theta * (ssw + ssb / (1 + 20 * theta)) / (20 * g - 4) AS sb FROM ratio
), est AS (
  SELECT v.*, b.icept AS b0, b.slope AS b1, a.icept - b.icept AS b2, a.slope - b.slope AS b3,
    sqrt(sb / g + s2 / g * (1 / 10e0 + 5.5e0 * 5.5e0 / 82.5e0)) AS se0, sqrt(s2 / (82.5e0 * g)) AS se1,
    sqrt(2 * s2 / g * (1 / 10e0 + 5.5e0 * 5.5e0 / 82.5e0)) AS se2, sqrt(2 * s2 / (82.5e0 * g)) AS se3
  FROM vars AS v, lines AS b, lines AS a WHERE b.part = 'Before' AND a.part = 'After'
)"""
twin("lmm_fit", LMM,
     """SELECT '(Intercept)' AS term, b0 AS estimate, se0 AS se FROM est
     UNION ALL SELECT 'minute_relative', b1, se1 FROM est UNION ALL SELECT 'partAfter', b2, se2 FROM est
     UNION ALL SELECT 'minute_relative:partAfter', b3, se3 FROM est""", "estimate se")
CRIT = ("(20 * g - 4) * (1 + ln(2 * pi() * s2)) + g * ln(1 + 20 * theta) + 4 * ln(g) + 2 * ln(825e0)"
        " - ln(1 + 20 * theta)")
twin("lmm_variance", LMM,
     f"""SELECT CAST(20 * g AS BIGINT) AS n, sb AS var_group, s2 AS var_resid, {CRIT} AS criterion, {CRIT} + 12 AS aic,
       sqrt(theta) < 1e-4 AS singular FROM vars""", "var_group var_resid criterion aic")
# Satterthwaite: within-fish contrasts have the within df, the intercept mixes both mean squares
DF_W = "(CASE WHEN sqrt(theta) < 1e-4 THEN 20 * g - 4 ELSE 20 * g - g - 3 END)"
K0 = "(1 / 10e0 + 5.5e0 * 5.5e0 / 82.5e0)"
DF_0 = (f"(CASE WHEN sqrt(theta) < 1e-4 THEN 20 * g - 4 ELSE pow(se0, 4) / (pow((s2 + 20 * sb) / (20 * g), 2) / (g - 1) "
        f"+ pow(s2 * ({K0} / g - 1 / (20e0 * g)), 2) / (19 * g - 3)) END)")
twin("lmm_coef_tests", LMM + f""", four AS (
  SELECT '(Intercept)' AS term, b0 AS estimate, se0 AS se, {DF_0} AS df FROM est
  UNION ALL SELECT 'minute_relative', b1, se1, {DF_W} FROM est UNION ALL SELECT 'partAfter', b2, se2, {DF_W} FROM est
  UNION ALL SELECT 'minute_relative:partAfter', b3, se3, {DF_W} FROM est
)""", f"SELECT term, estimate, se, CAST(df AS DOUBLE) AS df, t, {t_tail('t', 'df')} AS p FROM (SELECT *, estimate / se AS t FROM four) AS f",
     "estimate se df t p")
twin("lmm_anova", LMM + f""", three AS (
  SELECT 'part' AS term, pow(b2 / se2, 2) AS f, {DF_W} AS df FROM est
  UNION ALL SELECT 'minute_relative', pow(b1 + b3 / 2, 2) / (s2 / (165e0 * g)), {DF_W} FROM est
  UNION ALL SELECT 'minute_relative:part', pow(b3 / se3, 2), {DF_W} FROM est
)""", f"SELECT term, CAST(1 AS INTEGER) AS df1, CAST(df AS DOUBLE) AS df2, f, {t_tail('sqrt(f)', 'df')} AS p FROM three", "df2 f p")
twin("lmm_r2", LMM,
     """SELECT v / (v + sb + s2) AS r2_marginal, (v + sb) / (v + sb + s2) AS r2_conditional
     FROM vars, (SELECT var_samp(fix) AS v FROM fixed) AS f""", "r2_marginal r2_conditional")
twin("lmm_effects", LMM,
     "SELECT fish_id, 20 * theta / (1 + 20 * theta) * eb AS effect FROM fish_mean, vars", "effect")
RESID = LMM + """, resids AS (
  SELECT fish_id, minute, fix + 20 * theta / (1 + 20 * theta) * eb AS fitted,
    y - fix - 20 * theta / (1 + 20 * theta) * eb AS resid
  FROM fixed JOIN fish_mean USING (fish_id), vars
)"""
twin("lmm_residuals", RESID, "SELECT * FROM resids", "fitted resid")
twin("lmm_residual_histogram", RESID + """, ends AS (
  SELECT min(resid) AS lo, (max(resid) - min(resid)) / 30 AS w FROM resids
)""", """SELECT bin, lo + (bin - 1) * w AS low, lo + bin * w AS high, count(*) AS count FROM (
  SELECT CAST(least(30, greatest(1, ceil((resid - lo) / w - 1e-7))) AS INTEGER) AS bin, lo, w FROM resids, ends) AS b
GROUP BY ALL""", "low high")
DF_MEAN = ("(CASE WHEN sqrt(theta) < 1e-4 THEN 20 * g - 4 ELSE pow(sb / g + s2 / (10 * g), 2) / (pow((s2 + 20 * sb) / (20 * g), 2)"
           " / (g - 1) + pow(s2 / (20 * g), 2) / (19 * g - 3)) END)")
twin("lmm_emmeans", LMM,
     f"""SELECT part, icept + 5.5e0 * slope AS emmean, sqrt(sb / g + s2 / (10 * g)) AS se, CAST({DF_MEAN} AS DOUBLE) AS df
     FROM lines, vars""", "emmean se df")
twin("lmm_contrasts", LMM,
     f"""SELECT *, p AS p_bonferroni, p AS p_holm FROM (SELECT * REPLACE (CAST(df AS DOUBLE) AS df), {t_tail('t', 'df')} AS p FROM (
       SELECT 'After - Before' AS contrast, b2 + 5.5e0 * b3 AS estimate, sqrt(s2 / (5 * g)) AS se,
         (b2 + 5.5e0 * b3) / sqrt(s2 / (5 * g)) AS t, {DF_W} AS df FROM est) AS e) AS f""",
     "estimate se df t p p_bonferroni p_holm")
# share ~ part * treatment + (1 | fish): treatments differ between fish, periods within
TREAT = CUE_MINUTE + """, rel AS (
  SELECT fish || '_' || treatment AS fish_id, treatment, part, ratioside AS y FROM cue_minute
), cellm AS (
  SELECT treatment, part, avg(y) AS mu, count(*) / 10e0 AS k FROM rel GROUP BY ALL
), e AS (
  SELECT fish_id, y - mu AS e FROM rel JOIN cellm USING (treatment, part)
), fm AS (
  SELECT fish_id, avg(e) AS eb FROM e GROUP BY fish_id
), ms AS (
  SELECT (SELECT count(*) FROM fm) AS g, (SELECT 20 * sum(eb * eb) FROM fm) AS ssb,
    (SELECT sum((e - eb) * (e - eb)) FROM e JOIN fm USING (fish_id)) AS ssw
), vr AS (
  SELECT *, CASE WHEN ssb / (g - 3) > ssw / (19 * g - 3) THEN ssw / (19 * g - 3) ELSE (ssw + ssb) / (20 * g - 6) END AS s2,
    CASE WHEN ssb / (g - 3) > ssw / (19 * g - 3) THEN ssb / (g - 3) ELSE (ssw + ssb) / (20 * g - 6) END AS lb,
    CASE WHEN ssb / (g - 3) > ssw / (19 * g - 3) THEN g - 3 ELSE 20 * g - 6 END AS dfb,
    CASE WHEN ssb / (g - 3) > ssw / (19 * g - 3) THEN 19 * g - 3 ELSE 20 * g - 6 END AS dfw FROM ms
), tm AS (
  SELECT treatment, avg(mu) AS m, max(mu) FILTER (part = 'After') - max(mu) FILTER (part = 'Before') AS d, max(k) AS k
  FROM cellm GROUP BY treatment
)"""
twin("lmm_share_anova", TREAT, f"""SELECT 'part' AS term, CAST(1 AS INTEGER) AS df1, CAST(dfw AS DOUBLE) AS df2, f, {t_tail('sqrt(f)', 'dfw')} AS p
  FROM (SELECT dfw, (SELECT pow(avg(d), 2) / sum(s2 / (45 * k)) FROM tm) AS f FROM vr) AS a
UNION ALL SELECT term, CAST(2 AS INTEGER), CAST(df AS DOUBLE), f, pow(1 + 2 * f / df, -df / 2e0) FROM (
  SELECT 'treatment' AS term, dfb AS df, (SELECT 10 * (sum(k * m * m) - pow(sum(k * m), 2) / sum(k)) FROM tm) / lb AS f FROM vr
  UNION ALL SELECT 'part:treatment', dfw, (SELECT 2.5e0 * (sum(k * d * d) - pow(sum(k * d), 2) / sum(k)) FROM tm) / s2 FROM vr) AS b""",
     "df2 f p")
twin("lmm_share_contrasts", TREAT + f""", pairs AS (
  SELECT x.treatment || ' - ' || y.treatment AS contrast, x.m - y.m AS estimate, sqrt(lb / 20 * (1 / x.k + 1 / y.k)) AS se, dfb AS df
  FROM tm AS x JOIN tm AS y ON x.treatment < y.treatment, vr
), tested AS (
  SELECT contrast, estimate, se, CAST(df AS DOUBLE) AS df, estimate / se AS t, {t_tail('(estimate / se)', 'df')} AS p FROM pairs
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY p) AS r FROM tested
)""", """SELECT contrast, estimate, se, df, t, p, least(1e0, 3 * p) AS p_bonferroni,
  max(least(1e0, (4 - r) * p)) OVER (ORDER BY r) AS p_holm FROM ordered""", "estimate se df t p p_bonferroni p_holm")
twin("lmm_predict", LMM,
     """SELECT *, predicted - 1.959963984540054e0 * se AS conf_low, predicted + 1.959963984540054e0 * se AS conf_high
     FROM (SELECT CAST(i AS DOUBLE) AS minute_relative, part, icept + slope * i AS predicted,
         sqrt(sb / g + s2 / g * (1 / 10e0 + pow(i - 5.5e0, 2) / 82.5e0)) AS se
       FROM lines, vars, range(1, 11) AS r(i)) AS q""", "predicted se conf_low conf_high")

twin("lmm_residual_qq", RESID + """, qq_rows AS (
  SELECT resid AS sample, row_number() OVER (ORDER BY resid) AS rank, count(*) OVER () AS n FROM resids
)""" + quantile_ctes("qq_z", "qq_rows", "((rank - 0.5e0) / n)"),
     "SELECT rank, z AS theoretical, sample FROM qq_z", "theoretical sample")

# --- speed ~ part + (1 | fish) with unequal fish: the slope of the profiled REML criterion in theta is written
# out for two coefficients and its root found by bisection on log theta


def group_sum(term: str, th: str) -> str:
    """Sum over fish of w times a product; w is theta / (1 + theta n)."""
    return f"(SELECT sum({th} / (1 + {th} * n) * {term}) FROM ent)"


def slope_sum(term: str, th: str) -> str:
    return f"(SELECT sum({term} / pow(1 + {th} * n, 2)) FROM ent)"


def profile(source: str, th: str) -> str:
    """Rows of ``source`` with the 2 x 2 system, coefficients, rss and slope at ``th``."""
    return f"""SELECT *, -(dq - 2 * b0 * d1 - 2 * b1 * d2 + b0 * b0 * d11 + 2 * b0 * b1 * d12 + b1 * b1 * d22) AS drss FROM (
      SELECT *, q - c1 * b0 - c2 * b1 AS rss FROM (
        SELECT *, (a22 * c1 - a12 * c2) / det AS b0, (a11 * c2 - a12 * c1) / det AS b1 FROM (
          SELECT *, a11 * a22 - a12 * a12 AS det FROM (
            SELECT *, {th} AS th, tot.n - {group_sum('n * n', th)} AS a11, tot.a - {group_sum('n * a', th)} AS a12,
              tot.a - {group_sum('a * a', th)} AS a22, tot.t - {group_sum('n * t', th)} AS c1,
              tot.ta - {group_sum('a * t', th)} AS c2, tot.yy - {group_sum('t * t', th)} AS q,
              {slope_sum('n * n', th)} AS d11, {slope_sum('n * a', th)} AS d12, {slope_sum('a * a', th)} AS d22,
              {slope_sum('n * t', th)} AS d1, {slope_sum('a * t', th)} AS d2, {slope_sum('t * t', th)} AS dq,
              (SELECT sum(n / (1 + {th} * n)) FROM ent) AS dlog, (SELECT sum(ln(1 + {th} * n)) FROM ent) AS logdet
            FROM {source}, tot) AS p1) AS p2) AS p3) AS p4"""


SLOPE = "((n - 2) * drss / rss + dlog - (a22 * d11 - 2 * a12 * d12 + a11 * d22) / det)"
twin("lmm_speed_part", SPEED.replace("clock AS", "RECURSIVE clock AS", 1) + f""", ent AS MATERIALIZED (
  SELECT fish, treatment, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (part = 'After') AS DOUBLE) AS a, sum(m1) AS t,
    coalesce(sum(m1) FILTER (part = 'After'), 0) AS ta, sum(m1 * m1) AS yy FROM speed_min WHERE m1 IS NOT NULL GROUP BY ALL
), tot AS MATERIALIZED (
  SELECT sum(n) AS n, sum(a) AS a, sum(t) AS t, sum(ta) AS ta, sum(yy) AS yy FROM ent
), halves AS (
  SELECT 0 AS k, ln(1e-8) AS lo, ln(1e8) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN s >= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN s >= 0 THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT k, lo, hi, {SLOPE} AS s FROM ({profile('(SELECT * FROM halves WHERE k < 60)', 'exp((lo + hi) / 2)')}) AS h) AS g
), root AS (
  SELECT CASE WHEN hi < ln(1.1e-8) THEN 0e0 ELSE exp(hi) END AS r FROM halves WHERE k = 60
)""", f"""SELECT CAST(n AS BIGINT) AS n, th * rss / (n - 2) AS var_group, rss / (n - 2) AS var_resid,
  (n - 2) * (1 + ln(2 * pi() * rss / (n - 2))) + logdet + ln(det) AS criterion, b0, sqrt(rss / (n - 2) * a22 / det) AS se0,
  b1, sqrt(rss / (n - 2) * a11 / det) AS se1 FROM ({profile('root', 'r')}) AS f""",
     "var_group var_resid criterion b0 se0 b1 se1")

# --- seconds per compartment: four cells per fish, so both candidates have closed forms
COMP = CUE_PART + """, comp AS (
  SELECT fish || '_' || treatment AS fish_id, part, 'cue' AS side, sum AS y FROM cue_part
  UNION ALL SELECT fish || '_' || treatment, part, 'nocue', total_sum - sum FROM cue_part
)"""
CUE_PLAIN = COMP + """, fitted AS (
  SELECT fish_id, y - avg(y) OVER (PARTITION BY part, side) AS e4,
    y - avg(y) OVER (PARTITION BY part) - avg(y) OVER (PARTITION BY side) + avg(y) OVER () AS e3 FROM comp
), squares AS (
  SELECT 'time ~ part*fishSide' AS model, 4 AS p, ln(1e0) AS logdet, fish_id, avg(e4) AS b, sum(e4 * e4) AS ss
  FROM fitted GROUP BY fish_id
  UNION ALL SELECT 'time ~ part + fishSide', 3, ln(4e0), fish_id, avg(e3), sum(e3 * e3) FROM fitted GROUP BY fish_id
), parts AS (
  SELECT model, p, logdet, count(*) AS g, 4 * sum(b * b) AS ssb, sum(ss) - 4 * sum(b * b) AS ssw FROM squares GROUP BY ALL
), ratios AS (
  SELECT *, greatest(0e0, (ssb / (g - 1) / (ssw / (3 * g - p + 1)) - 1) / 4) AS theta FROM parts
), aics AS (
  SELECT model, (4 * g - p) * (1 + ln(2 * pi() * (ssw + ssb / (1 + 4 * theta)) / (4 * g - p))) + g * ln(1 + 4 * theta)
    + p * ln(g) + logdet - ln(1 + 4 * theta) + 2 * (p + 2) AS aic,
    p, g, theta, (ssw + ssb / (1 + 4 * theta)) / (4 * g - p) AS s2 FROM ratios
)"""
twin("cue_percent_prediction", CUE_PLAIN + """, cell_means AS (
  SELECT part, side, avg(y) AS mu FROM comp GROUP BY part, side
), cell_se AS (
  SELECT sqrt(s2 * theta / g + s2 / g) AS se FROM aics WHERE p = 4
)""", """SELECT part, CASE side WHEN 'cue' THEN 'menthe' ELSE 'edm' END AS "fishSide", 100 * mu / 600 AS predicted,
  100 * (mu - 1.959963984540054e0 * se) / 600 AS conf_low, 100 * (mu + 1.959963984540054e0 * se) / 600 AS conf_high
FROM cell_means, cell_se""", "predicted conf_low conf_high")
twin("lmm_cue_plain", CUE_PLAIN, "SELECT model, aic, aic = min(aic) OVER () AS best FROM aics", "aic")
# an additive gamma model with log link on four equal cells: working responses are fitted by row and column means
twin("gamma_glm", COMP.replace("clock AS", "RECURSIVE clock AS", 1) + """, cells AS (
  SELECT avg(y + 0.5e0) FILTER (part = 'Before' AND side = 'nocue') AS m00, avg(y + 0.5e0) FILTER (part = 'After' AND side = 'nocue') AS m10,
    avg(y + 0.5e0) FILTER (part = 'Before' AND side = 'cue') AS m01, avg(y + 0.5e0) FILTER (part = 'After' AND side = 'cue') AS m11,
    count(*) AS n FROM comp
), steps AS (
  SELECT 0 AS it, ln((m00 + m10 + m01 + m11) / 4) AS a, 0e0 AS b, 0e0 AS c FROM cells
  UNION ALL
  SELECT it + 1, (3 * z00 + z10 + z01 - z11) / 4, (z10 + z11 - z00 - z01) / 2, (z01 + z11 - z00 - z10) / 2 FROM (
    SELECT it, a + m00 / exp(a) - 1 AS z00, a + b + m10 / exp(a + b) - 1 AS z10, a + c + m01 / exp(a + c) - 1 AS z01,
      a + b + c + m11 / exp(a + b + c) - 1 AS z11 FROM steps, cells WHERE it < 60) AS z
), last AS (SELECT a, b, c FROM steps WHERE it = 60
), disp AS (
  SELECT sum(pow((y + 0.5e0) / exp(a + CASE part WHEN 'After' THEN b ELSE 0 END + CASE side WHEN 'cue' THEN c ELSE 0 END) - 1, 2))
    / (count(*) - 3) AS phi, count(*) AS n FROM comp, last
), gcoef AS (
  SELECT '(Intercept)' AS term, a AS estimate, sqrt(3 * phi / n) AS se, n FROM last, disp
  UNION ALL SELECT 'partAfter', b, sqrt(4 * phi / n), n FROM last, disp
  UNION ALL SELECT 'fishSidecue', c, sqrt(4 * phi / n), n FROM last, disp
)""", f"SELECT term, estimate, se, t, {t_tail('t', '(n - 3)')} AS p, n FROM (SELECT *, estimate / se AS t FROM gcoef) AS g",
     "estimate se t p")

# --- hidden Markov model
SER = FRAMES + """, ser AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY fish, treatment ORDER BY secs) AS INTEGER) AS time FROM (
    SELECT fish, treatment, part, bucket AS secs, avg(cue_x) AS n_cuex, avg(olf_y) AS n_y FROM lagged GROUP BY ALL) AS a
  WHERE n_cuex IS NOT NULL AND n_y IS NOT NULL
)"""


def log_density(x: str, a: int, b: int) -> str:
    return f"(({a} - 1) * ln({x}) + ({b} - 1) * ln(1 - {x}) - (lgamma({a}) + lgamma({b}) - lgamma({a + b})))"


SHAPES = [(3, 10), (200, 200), (10, 3)]
EMIT = SER + """, emit AS MATERIALIZED (
  SELECT fish, treatment, part, n_cuex, time, """ + ", ".join(
    f"{log_density('n_cuex', a, b)} AS log_b{i}" for i, (a, b) in enumerate(SHAPES, 1)) + """ FROM ser
)"""
twin("hmm_series", SER, "SELECT * FROM ser", "n_cuex n_y")
twin("hmm_series_strict", FRAMES + """, ser AS (
  SELECT * FROM (
    SELECT fish, treatment, part, bucket AS secs, CASE WHEN count(cue_x) = count(*) THEN avg(cue_x) END AS n_cuex,
      CASE WHEN count(olf_y) = count(*) THEN avg(olf_y) END AS n_y FROM lagged GROUP BY ALL) AS a
  WHERE n_cuex IS NOT NULL AND n_y IS NOT NULL
)""", "SELECT *, CAST(row_number() OVER (PARTITION BY fish, treatment ORDER BY secs) AS INTEGER) AS time FROM ser",
     "n_cuex n_y")
twin("hmm_emission", EMIT, "SELECT * FROM emit", "n_cuex log_b1 log_b2 log_b3")


def step(scores: list[str], to: int) -> str:
    """Best score into state ``to`` from three scores."""
    return "greatest(" + ", ".join(f"{s} + ln({0.8 if i == to else 0.1}e0)" for i, s in enumerate(scores, 1)) + ")"


def source(scores: list[str], to: int) -> str:
    """The path that gives it; the lowest state wins a tie."""
    c = [f"{s} + ln({0.8 if i == to else 0.1}e0)" for i, s in enumerate(scores, 1)]
    return (f"CASE WHEN {c[0]} >= {c[1]} AND {c[0]} >= {c[2]} THEN v.p1 "
            f"WHEN {c[1]} >= {c[2]} THEN v.p2 ELSE v.p3 END")


V = ["v.s1", "v.s2", "v.s3"]
VITERBI = EMIT.replace("clock AS", "RECURSIVE clock AS", 1) + f""", vit AS (
  SELECT fish, treatment, time, log_b1 + ln(1 / 3e0) AS s1, log_b2 + ln(1 / 3e0) AS s2, log_b3 + ln(1 / 3e0) AS s3,
    [1] AS p1, [2] AS p2, [3] AS p3 FROM emit WHERE time = 1
  UNION ALL
  SELECT e.fish, e.treatment, e.time, {step(V, 1)} + e.log_b1, {step(V, 2)} + e.log_b2, {step(V, 3)} + e.log_b3,
    list_append({source(V, 1)}, 1), list_append({source(V, 2)}, 2), list_append({source(V, 3)}, 3)
  FROM vit AS v JOIN emit AS e ON e.fish = v.fish AND e.treatment = v.treatment AND e.time = v.time + 1
), ends AS (
  SELECT fish, treatment, CASE WHEN s1 >= s2 AND s1 >= s3 THEN p1 WHEN s2 >= s3 THEN p2 ELSE p3 END AS path
  FROM vit JOIN (SELECT fish, treatment, max(time) AS time FROM emit GROUP BY ALL) AS m USING (fish, treatment, time)
)"""
twin("hmm_viterbi", VITERBI,
     """SELECT fish, treatment, CAST(i AS BIGINT) AS time, CAST(path[i] AS INTEGER) AS state FROM (
       SELECT fish, treatment, path, unnest(range(1, len(path) + 1)) AS i FROM ends) AS u""")


def flow(a: list[str], to: int) -> str:
    return "(" + " + ".join(f"{0.8 if i == to else 0.1}e0 * {s}" for i, s in enumerate(a, 1)) + ")"


A = ["f.a1", "f.a2", "f.a3"]
FORWARD = EMIT.replace("clock AS", "RECURSIVE clock AS", 1) + f""", dens AS MATERIALIZED (
  SELECT *, greatest(log_b1, log_b2, log_b3) AS top, exp(log_b1 - greatest(log_b1, log_b2, log_b3)) AS d1,
    exp(log_b2 - greatest(log_b1, log_b2, log_b3)) AS d2, exp(log_b3 - greatest(log_b1, log_b2, log_b3)) AS d3 FROM emit
), fwd AS (
  SELECT fish, treatment, time, d1 / (d1 + d2 + d3) AS a1, d2 / (d1 + d2 + d3) AS a2, d3 / (d1 + d2 + d3) AS a3,
    ln((d1 + d2 + d3) / 3) + top AS ll FROM dens WHERE time = 1
  UNION ALL
  SELECT fish, treatment, time, j1 / (j1 + j2 + j3), j2 / (j1 + j2 + j3), j3 / (j1 + j2 + j3), ll + ln(j1 + j2 + j3) + top
  FROM (SELECT d.fish, d.treatment, d.time, f.ll, d.top, {flow(A, 1)} * d.d1 AS j1, {flow(A, 2)} * d.d2 AS j2,
      {flow(A, 3)} * d.d3 AS j3
    FROM fwd AS f JOIN dens AS d ON d.fish = f.fish AND d.treatment = f.treatment AND d.time = f.time + 1) AS s
)"""
twin("hmm_loglik", FORWARD,
     """SELECT fish, treatment, CAST(time AS BIGINT) AS steps, ll AS loglik FROM fwd
     JOIN (SELECT fish, treatment, max(time) AS time FROM emit GROUP BY ALL) AS m USING (fish, treatment, time)""",
     "loglik")


def beta_cdf(a: int, b: int) -> str:
    """Distribution function for whole-number shapes, as a binomial tail."""
    m = a + b - 1
    return (f"(SELECT sum(exp(lgamma({m + 1}) - lgamma(j + 1) - lgamma({m + 1} - j) + j * ln(n_cuex) + ({m} - j) * ln(1 - n_cuex))) "
            f"FROM range({a}, {m + 1}) AS r(j))")


LAW = [f"CASE WHEN d.time = 1 THEN 1 / 3e0 ELSE {flow(A, j)} END" for j in (1, 2, 3)]
twin("hmm_forecast_residuals", FORWARD + f""", cdf AS (
  SELECT d.fish, d.treatment, CAST(d.time AS BIGINT) AS time, n_cuex, {LAW[0]} AS g1, {LAW[1]} AS g2, {LAW[2]} AS g3
  FROM dens AS d LEFT JOIN fwd AS f ON f.fish = d.fish AND f.treatment = d.treatment AND f.time = d.time - 1
), level AS (
  SELECT fish, treatment, time, g1 * {beta_cdf(3, 10)} + g2 * {beta_cdf(200, 200)} + g3 * {beta_cdf(10, 3)} AS u FROM cdf
)""" + quantile_ctes("fr", "level", "u"), "SELECT fish, treatment, time, z AS residual FROM fr", "residual")
H = ["d.d1 * w.w1", "d.d2 * w.w2", "d.d3 * w.w3"]
XI = ", ".join(f"f.a{i} * {0.8 if i == j else 0.1}e0 * d.d{j} * w.w{j} AS x{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
TOTAL = " + ".join(f"x{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
LONG = " UNION ALL ".join(f"SELECT part, 'state{i}' AS \"from\", 'state{j}' AS \"to\", sum(x{i}{j} / ({TOTAL})) AS c FROM xi GROUP BY part"
                          for i in (1, 2, 3) for j in (1, 2, 3))
BACKWARD = FORWARD + f""", bwd AS (
  SELECT fish, treatment, time, 1e0 AS w1, 1e0 AS w2, 1e0 AS w3 FROM dens
  JOIN (SELECT fish, treatment, max(time) AS time FROM emit GROUP BY ALL) AS m USING (fish, treatment, time)
  UNION ALL
  SELECT fish, treatment, time, h1 / (h1 + h2 + h3), h2 / (h1 + h2 + h3), h3 / (h1 + h2 + h3)
  FROM (SELECT w.fish, w.treatment, w.time - 1 AS time, {flow(H, 1)} AS h1, {flow(H, 2)} AS h2, {flow(H, 3)} AS h3
    FROM bwd AS w JOIN dens AS d ON d.fish = w.fish AND d.treatment = w.treatment AND d.time = w.time
    WHERE w.time > 1) AS s
)"""
twin("hmm_em_step", BACKWARD + f""", xi AS (
  SELECT d.part, {XI} FROM dens AS d
  JOIN fwd AS f ON f.fish = d.fish AND f.treatment = d.treatment AND f.time = d.time - 1
  JOIN bwd AS w ON w.fish = d.fish AND w.treatment = d.treatment AND w.time = d.time
), counts AS ({LONG})""",
     'SELECT part, "from", "to", c / sum(c) OVER (PARTITION BY part, "from") AS freq FROM counts', "freq")
OTHERS = "(" + " + ".join(f"g{j} * w{j}" for j in (1, 2, 3)) + ")"
twin("hmm_conditional_residuals", BACKWARD + f""", cdf AS (
  SELECT d.fish, d.treatment, CAST(d.time AS BIGINT) AS time, n_cuex, {LAW[0]} AS g1, {LAW[1]} AS g2, {LAW[2]} AS g3, w.w1, w.w2, w.w3
  FROM dens AS d LEFT JOIN fwd AS f ON f.fish = d.fish AND f.treatment = d.treatment AND f.time = d.time - 1
  JOIN bwd AS w ON w.fish = d.fish AND w.treatment = d.treatment AND w.time = d.time
), level AS (
  SELECT fish, treatment, time, (g1 * w1 * {beta_cdf(3, 10)} + g2 * w2 * {beta_cdf(200, 200)} + g3 * w3 * {beta_cdf(10, 3)}) / {OTHERS} AS u FROM cdf
)""" + quantile_ctes("cr", "level", "u"), "SELECT fish, treatment, time, z AS residual FROM cr", "residual")


def effect_rows(i: int) -> str:
    """The two moves out of state ``i``: their 2 x 2 system, curvature plus 1 / 0.5^2, solved by Cramer's rule."""
    j, k = [v for v in (1, 2, 3) if v != i]
    n = f"(c{i}1 + c{i}2 + c{i}3)"
    a, off = f"({n} * 0.09e0 + 4e0)", f"({n} * -0.01e0)"
    r = {v: f"(c{i}{v} - 0.1e0 * {n})" for v in (j, k)}
    det = f"({a} * {a} - {off} * {off})"
    return " UNION ALL ".join(
        f"SELECT fish, treatment, 'state{i}' AS \"from\", 'state{v}' AS \"to\", ({a} * {r[v]} - {off} * {r[w]}) / {det} AS effect FROM sums"
        for v, w in ((j, k), (k, j)))


PAIRS = " + ".join(f"x{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
twin("hmm_effect_step", BACKWARD + f""", xi AS (
  SELECT d.fish, d.treatment, {XI} FROM dens AS d
  JOIN fwd AS f ON f.fish = d.fish AND f.treatment = d.treatment AND f.time = d.time - 1
  JOIN bwd AS w ON w.fish = d.fish AND w.treatment = d.treatment AND w.time = d.time
), found AS (
  SELECT fish, treatment, {", ".join(f"sum(x{i}{j} / ({PAIRS})) AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))} FROM xi GROUP BY fish, treatment
), sums AS (
  SELECT fish, treatment, {", ".join(f"coalesce(c{i}{j}, 0) AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))}
  FROM (SELECT DISTINCT fish, treatment FROM dens) AS e LEFT JOIN found USING (fish, treatment)
)""", " UNION ALL ".join(effect_rows(i) for i in (1, 2, 3)), "effect")



# --- rounds of the fit with a matrix per part and treatment, from the neighbours' start without the direct moves
IJ = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
NEIGHBOURS = [[0.8, 0.2, 0.0], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]]
MAT0 = "mat0 AS MATERIALIZED (SELECT part, treatment, " + ", ".join(
    f"{NEIGHBOURS[i - 1][j - 1]}e0 AS p{i}{j}" for i, j in IJ) + " FROM dens GROUP BY part, treatment)"


def e_step(k: int, by: str) -> str:
    """Forward, backward and expected counts ``c11 .. c33`` per ``by`` under ``mat{k}``, with a uniform start law."""
    ahead = [" + ".join(f"f.a{i} * m.p{i}{j}" for i in (1, 2, 3)) for j in (1, 2, 3)]
    back = [" + ".join(f"m.p{i}{j} * d.d{j} * w.w{j}" for j in (1, 2, 3)) for i in (1, 2, 3)]
    total = " + ".join(f"x{i}{j}" for i, j in IJ)
    here = f"JOIN mat{k} AS m ON m.part = d.part AND m.treatment = d.treatment"
    return f"""fwd{k} AS (
  SELECT fish, treatment, time, d1 / (d1 + d2 + d3) AS a1, d2 / (d1 + d2 + d3) AS a2, d3 / (d1 + d2 + d3) AS a3 FROM dens WHERE time = 1
  UNION ALL
  SELECT fish, treatment, time, j1 / (j1 + j2 + j3), j2 / (j1 + j2 + j3), j3 / (j1 + j2 + j3) FROM (
    SELECT d.fish, d.treatment, d.time, ({ahead[0]}) * d.d1 AS j1, ({ahead[1]}) * d.d2 AS j2, ({ahead[2]}) * d.d3 AS j3
    FROM fwd{k} AS f JOIN dens AS d ON d.fish = f.fish AND d.treatment = f.treatment AND d.time = f.time + 1 {here}) AS s
), bwd{k} AS (
  SELECT fish, treatment, max(time) AS time, 1e0 AS w1, 1e0 AS w2, 1e0 AS w3 FROM dens GROUP BY fish, treatment
  UNION ALL
  SELECT fish, treatment, time, h1 / (h1 + h2 + h3), h2 / (h1 + h2 + h3), h3 / (h1 + h2 + h3) FROM (
    SELECT w.fish, w.treatment, w.time - 1 AS time, {back[0]} AS h1, {back[1]} AS h2, {back[2]} AS h3
    FROM bwd{k} AS w JOIN dens AS d ON d.fish = w.fish AND d.treatment = w.treatment AND d.time = w.time {here} WHERE w.time > 1) AS s
), xi{k} AS (
  SELECT d.fish, d.part, d.treatment, {", ".join(f"f.a{i} * m.p{i}{j} * d.d{j} * w.w{j} AS x{i}{j}" for i, j in IJ)} FROM dens AS d
  JOIN fwd{k} AS f ON f.fish = d.fish AND f.treatment = d.treatment AND f.time = d.time - 1
  JOIN bwd{k} AS w ON w.fish = d.fish AND w.treatment = d.treatment AND w.time = d.time {here}
), cnt{k} AS MATERIALIZED (
  SELECT {by}, {", ".join(f"sum(x{i}{j} / ({total})) AS c{i}{j}" for i, j in IJ)} FROM xi{k} GROUP BY {by}
)"""


def m_step(k: int) -> str:
    new = ", ".join(f"CASE WHEN c{i}1 + c{i}2 + c{i}3 > 0 THEN c{i}{j} / (c{i}1 + c{i}2 + c{i}3) ELSE p{i}{j} END AS p{i}{j}" for i, j in IJ)
    return f"mat{k + 1} AS MATERIALIZED (SELECT part, treatment, {new} FROM mat{k} JOIN cnt{k} USING (part, treatment))"


def long_matrix(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, 'state{i}' AS \"from\", 'state{j}' AS \"to\", p{i}{j} AS freq FROM {source}" for i, j in IJ)


DENS = FORWARD[:FORWARD.index(", fwd AS (")]
twin("hmm_em_three", ", ".join([DENS, MAT0, *[t for k in range(3) for t in (e_step(k, "part, treatment"), m_step(k))]]),
     long_matrix("mat3", "part, treatment"), "freq")
# one Newton step from equal matrices: a least-squares fit of c_j / (n p_j) - c_i / (n p_i) with weights n, by part and treatment
# additively; with two parts the part's effect is the weighted mean of the differences inside the treatments
MOVES = [(i, j) for i, j in IJ if i != j and NEIGHBOURS[i - 1][j - 1] > 0]
ADDITIVE = " UNION ALL ".join(
    f"SELECT part, treatment, {i} AS i, {j} AS j, c{i}1 + c{i}2 + c{i}3 AS n, ln({NEIGHBOURS[i - 1][j - 1]} / {NEIGHBOURS[i - 1][i - 1]}e0) AS old, "
    f"(c{i}{j} / {NEIGHBOURS[i - 1][j - 1]}e0 - c{i}{i} / {NEIGHBOURS[i - 1][i - 1]}e0) / (c{i}1 + c{i}2 + c{i}3) AS y FROM cnt0" for i, j in MOVES)
twin("hmm_additive_step", ", ".join([DENS, MAT0, e_step(0, "part, treatment")]) + f""", work AS ({ADDITIVE}
), sides AS (
  SELECT treatment, i, j, sum(n) AS n, sum(n * y) AS ny, coalesce(sum(n) FILTER (part = 'After'), 0) AS na,
    coalesce(sum(n) FILTER (part = 'Before'), 0) AS nb, sum(y) FILTER (part = 'After') - sum(y) FILTER (part = 'Before') AS gap
  FROM work GROUP BY treatment, i, j
), effect AS (
  SELECT i, j, sum(na * nb / n * gap) / sum(na * nb / n) AS b FROM sides GROUP BY i, j
), odds AS (
  SELECT w.part, w.treatment, w.i, w.j, exp(w.old + (s.ny - s.na * b) / s.n + CASE WHEN w.part = 'After' THEN b ELSE 0 END) AS o
  FROM work AS w JOIN sides AS s ON s.treatment = w.treatment AND s.i = w.i AND s.j = w.j JOIN effect AS e ON e.i = w.i AND e.j = w.j
), wide AS (
  SELECT part, treatment, {", ".join(f"coalesce(sum(o) FILTER (i = {i} AND j = {j}), 0) AS o{i}{j}" if i != j else f"1e0 AS o{i}{j}" for i, j in IJ)}
  FROM odds GROUP BY part, treatment
), mat1 AS (
  SELECT part, treatment, {", ".join(f"o{i}{j} / (o{i}1 + o{i}2 + o{i}3) AS p{i}{j}" for i, j in IJ)} FROM wide
)""", long_matrix("mat1", "part, treatment"), "freq")
N = [f"(c{i}1 + c{i}2 + c{i}3)" for i in (1, 2, 3)]
SPREAD = [f"p{i}{j} * (1 - p{i}{j})" for i, j in IJ]
twin("hmm_entity_given", ", ".join([DENS, MAT0, e_step(0, "fish, part, treatment")]) + f""", joined AS (
  SELECT * FROM cnt0 JOIN mat0 USING (part, treatment)
), moments AS (
  SELECT sum({' + '.join(f'pow(c{i}{j} - {N[i - 1]} * p{i}{j}, 2)' for i, j in IJ)}) AS gap,
    sum({' + '.join(f'{s} * {N[i - 1]}' for s, (i, j) in zip(SPREAD, IJ))}) AS base,
    sum({' + '.join(f'{s} * ({N[i - 1]} * {N[i - 1]} - {N[i - 1]})' for s, (i, j) in zip(SPREAD, IJ))}) AS extra FROM joined
), pool AS (
  SELECT CASE WHEN extra > 0 AND gap > base THEN least(1e4, greatest(0e0, extra / (gap - base) - 1)) ELSE 1e4 END AS a FROM moments
), shrunk AS (
  SELECT fish, treatment, part, {", ".join(f"(c{i}{j} + a * p{i}{j}) / ({N[i - 1]} + a) AS p{i}{j}" for i, j in IJ)} FROM joined, pool
)""", long_matrix("shrunk", "fish, treatment, part"), "freq")

HARD = EMIT + """, hard AS (
  SELECT fish, treatment, part, time, n_cuex,
    CASE WHEN log_b1 >= log_b2 AND log_b1 >= log_b3 THEN 1 WHEN log_b2 >= log_b3 THEN 2 ELSE 3 END AS st FROM emit
), moves AS (
  SELECT *, lag(st) OVER (PARTITION BY fish, treatment ORDER BY time) AS old FROM hard
), counted AS (
  SELECT fish, treatment, part, """ + ", ".join(
    f"count(*) FILTER (old = {i} AND st = {j}) + 1e0 AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """
  FROM moves WHERE old IS NOT NULL GROUP BY ALL
), mats AS (
  SELECT fish, treatment, part, """ + ", ".join(
    f"c{i}{j} / (c{i}1 + c{i}2 + c{i}3) AS p{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """ FROM counted
), trees AS (
  SELECT *, p21 * p31 + p23 * p31 + p32 * p21 AS w1, p12 * p32 + p13 * p32 + p31 * p12 AS w2,
    p13 * p23 + p12 * p23 + p21 * p13 AS w3 FROM mats
), laws AS (
  SELECT fish, treatment, part, w1 / (w1 + w2 + w3) AS state1, w2 / (w1 + w2 + w3) AS state2,
    w3 / (w1 + w2 + w3) AS state3 FROM trees
), mat_long AS (
  """ + " UNION ALL ".join(
    f"SELECT fish, treatment, part, 'state{i}' AS \"from\", 'state{j}' AS \"to\", p{i}{j} AS freq FROM mats"
    for i in (1, 2, 3) for j in (1, 2, 3)) + """
)"""
twin("hmm_stationary", HARD, "SELECT * FROM laws", "state1 state2 state3")
twin("hmm_tpm_long", HARD, "SELECT * FROM mat_long", "freq")
QI = ("quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.025) AS lower, quantile_cont({0}, 0.975) AS upper")
twin("hmm_state_interval", HARD,
     f"""SELECT part, treatment, state, {QI.format('prob')} FROM (
       SELECT part, treatment, 'state1' AS state, state1 AS prob FROM laws
       UNION ALL SELECT part, treatment, 'state2', state2 FROM laws
       UNION ALL SELECT part, treatment, 'state3', state3 FROM laws) AS u GROUP BY ALL""", "median lower upper")
twin("hmm_transition_interval", HARD,
     f"""SELECT part, treatment, "from", "to", {QI.format('freq')},
       ("from" = 'state1' AND "to" = 'state3') OR ("from" = 'state3' AND "to" = 'state1') AS of_interest,
       "from" || '->' || "to" AS step FROM mat_long GROUP BY part, treatment, "from", "to" """, "median lower upper")
twin("hmm_state_parameters", HARD,
     """SELECT 'state' || st AS state, m * phi AS shape1, (1 - m) * phi AS shape2, m AS mean, phi AS prec FROM (
       SELECT st, m, m * (1 - m) / v - 1 AS phi FROM (
         SELECT st, avg(n_cuex) AS m, var_samp(n_cuex) AS v FROM hard GROUP BY st) AS a) AS b""",
     "shape1 shape2 mean prec")
twin("hmm_density", SER,
     "SELECT bin, x, count * 50e0 / sum(count) OVER () AS observed, " + ", ".join(
         f"exp({log_density('x', a, b)}) AS state{i}" for i, (a, b) in enumerate(SHAPES, 1)) + """ FROM (
       SELECT bin, (bin - 0.5e0) / 50 AS x, count(*) AS count FROM (
         SELECT CAST(greatest(1, ceil(n_cuex * 50 - 1e-7)) AS INTEGER) AS bin FROM ser) AS b GROUP BY bin) AS c""",
     "x observed state1 state2 state3")
