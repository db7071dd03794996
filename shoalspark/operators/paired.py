"""Before/after and between-group tests as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.functions.pvalues import normal_quantile, normal_upper, signed_rank_p, t_p_value, z_p_value
from shoalspark.operators.ranks import average_rank, expanded, same_keys, value_ranks
from shoalspark.staging import small_side, stage

#: the published range of the p-value; W itself has no upper bound
SHAPIRO_PUBLISHED = 5000


def paired_t(pairs: DataFrame, keys: Sequence[str] = (), diff: str = "diff") -> DataFrame:
    """Paired t-test on the differences; pairs with a missing side drop out."""
    d = F.col(diff)
    agg = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
                                   F.stddev_samp(d).alias("__sd"))
    t = F.try_divide(F.col("mean_diff"), F.try_divide(F.col("__sd"), F.sqrt("n")))
    out = agg.select(*keys, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p", t_p_value("t", F.col("df").cast("double")))


def welch_t(df: DataFrame, group: str, levels: tuple[str, str], value: str = "diff",
            keys: Sequence[str] = ()) -> DataFrame:
    """Welch's two-sample t-test of ``value`` between two levels of ``group``."""
    def side(level):
        v = F.when(F.col(group) == level, F.col(value))
        return F.count(v), F.avg(v), F.var_samp(v)

    (n1, m1, v1), (n2, m2, v2) = side(levels[0]), side(levels[1])
    agg = df.groupBy(*keys).agg(
        n1.alias("n1"), n2.alias("n2"), m1.alias("mean1"), m2.alias("mean2"),
        F.try_divide(v1, n1).alias("__a"), F.try_divide(v2, n2).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b))
    free = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    out = agg.select(*keys, "n1", "n2", "mean1", "mean2", t.alias("t"), free.alias("df"))
    return out.withColumn("p", t_p_value("t", "df"))


def signed_rank(pairs: DataFrame, keys: Sequence[str] = (), diff: str = "diff", buckets: int | None = None) -> DataFrame:
    """Paired Wilcoxon test: V, z and two-sided p.

    Zero differences are dropped. Equal sizes are merged before ranking and the ranks are counted
    in value ranges, so one key may hold any number of pairs. Exact p below 50 pairs without ties
    or zeros, else the normal approximation with tie and continuity correction.
    """
    size = pairs.select(*keys, F.abs(diff).alias("size"), F.col(diff).alias("__d"))
    zero = size.groupBy(*keys).agg(F.count_if(F.col("__d") == 0).alias("zeros"))
    nonzero = size.where(F.col("__d") != 0)
    ranks = value_ranks(nonzero, keys, "size", buckets, sums={"plus": F.count_if(F.col("__d") > 0)})
    n = F.col("n").cast("double")
    agg = ranks.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("plus") * average_rank()).alias("v"),
        F.sum(n * n * n - n).alias("ties"))
    if keys:
        joined = zero.alias("z").join(agg.alias("a"), same_keys("z", "a", keys), "left")
    else:
        # two one-row tables
        joined = agg.alias("a").withColumn("zeros", zero.select("zeros").scalar())
    out = joined.select(*[F.col(f"z.{k}") for k in keys], F.coalesce("a.n", F.lit(0)).alias("n"),
                        "zeros", "v", F.coalesce("ties", F.lit(0.0)).alias("ties"))
    m = F.col("n").cast("double")
    gap = F.col("v") - m * (m + 1) / 4
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    out = out.withColumn("z", F.try_divide(gap - F.signum(gap) * 0.5, sd))
    exact = (F.col("n") < 50) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    out = out.withColumn("exact", exact)
    p = F.when(F.col("exact"), signed_rank_p(F.when(F.col("exact"), F.col("v")), m)).otherwise(z_p_value("z"))
    return out.select(*keys, "n", "v", "z", "exact", F.when(F.col("n") > 0, p).alias("p"))


# fixed values: Royston's (1995) polynomial coefficients of the Shapiro-Wilk test
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -0.0006714)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)


def _poly(coef, x):
    out = F.lit(0.0)
    for c in reversed(coef):
        out = out * x + F.lit(float(c))
    return out


def shapiro(df: DataFrame, keys: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """Shapiro-Wilk W and p (Royston's approximation) for three or more values that are not all equal.

    Every size is computed the same way: equal values are merged and ranked in value ranges, and the normal
    scores of each run are added up, so no task holds a group. ``extrapolated`` tells that n is beyond the
    range the p-value was published for.
    """
    if not keys:
        return shapiro(df.withColumn("__all", F.lit(0)), ["__all"], value).drop("__all")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    sizes = stage(df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("__lo"),
                                        F.max(value).alias("__hi"), F.avg(value).alias("__mean")))
    usable = small_side(sizes.where((F.col("n") >= 3) & (F.col("__lo") < F.col("__hi"))).select(*keys, "__mean"))
    points = expanded(value_ranks(rows, keys, "x"), keys, "x")
    n = F.col("total").cast("double")
    inner = points.alias("r").join(usable.alias("s"), same_keys("r", "s", keys)) \
        .select(*[f"r.{k}" for k in keys], (F.col("r.x") - F.col("s.__mean")).alias("x"), F.col("r.total").alias("n"),
                F.col("r.__i").alias("i"), normal_quantile((F.col("r.__i") - 0.375) / (n + 0.25)).alias("m"))
    n = F.col("n").cast("double")
    x, m, i = F.col("x"), F.col("m"), F.col("i")
    sums = inner.groupBy(*keys, "n").agg(
        F.sum(m * m).alias("mm"), F.sum(m * x).alias("mx"), F.sum(x * x).alias("xx"),
        *[F.max(F.when(i == F.lit(k), x)).alias(f"lo{k}") for k in (1, 2)],
        *[F.max(F.when(i == F.col("n") + 1 - k, x)).alias(f"hi{k}") for k in (1, 2)],
        *[F.max(F.when(i == F.col("n") + 1 - k, m)).alias(f"m{k}") for k in (1, 2)])
    # weights: the two extremes by polynomial in 1/sqrt(n), the rest proportional to m
    u = 1 / F.sqrt(n)
    mm, m1, m2 = F.col("mm"), F.col("m1"), F.col("m2")
    a1 = F.when(F.col("n") == 3, F.lit(0.5 ** 0.5)).otherwise(_poly(_C1, u) + m1 / F.sqrt(mm))
    a2 = _poly(_C2, u) + m2 / F.sqrt(mm)
    fac5 = (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)
    fac6 = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    edge1 = F.col("hi1") - F.col("lo1")
    edge2 = F.col("hi2") - F.col("lo2")
    mid1 = F.col("mx") - m1 * edge1
    mid2 = mid1 - m2 * edge2
    b = F.when(F.col("n") == 3, a1 * edge1) \
        .when(F.col("n") <= 5, a1 * edge1 + mid1 / F.sqrt(F.abs(fac5))) \
        .otherwise(a1 * edge1 + a2 * edge2 + mid2 / F.sqrt(fac6))
    w = F.least(F.lit(1.0), b * b / F.col("xx"))
    stat = sums.withColumn("w", w)
    y, ln_n = F.ln(1 - F.col("w")), F.ln(n)
    small = -F.ln(_poly(_G, n) - y)
    z = F.when(F.col("n") <= 11, (small - _poly(_C3, n)) / F.exp(_poly(_C4, n))) \
        .otherwise((y - _poly(_C5, ln_n)) / F.exp(_poly(_C6, ln_n)))
    six_over_pi = 6 / np.pi
    p3 = F.greatest(F.lit(0.0), six_over_pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))
    beyond = (F.col("n") <= 11) & (y >= _poly(_G, n))
    stat = stat.withColumn("__z", F.when(F.col("n") > 3, z))
    p = F.when(F.col("n") == 3, p3).when(beyond, F.lit(1e-99)).otherwise(normal_upper("__z"))
    stat = stat.select(*keys, "w", p.alias("p"))
    return sizes.alias("s").join(stat.alias("t"), same_keys("s", "t", keys), "left") \
        .select(*[f"s.{k}" for k in keys], "s.n", "t.w", "t.p", (F.col("s.n") > SHAPIRO_PUBLISHED).alias("extrapolated"))


def gated_test(pairs: DataFrame, keys: Sequence[str], diff: str = "diff", alpha: float = 0.05) -> DataFrame:
    """Paired t where the differences look normal, else signed rank, chosen per key by the same rule at every size."""
    sw = shapiro(pairs, keys, diff).select(*keys, F.col("p").alias("shapiro_p"))
    tt = paired_t(pairs, keys, diff).select(*keys, "n", F.col("p").alias("t_p"))
    sr = signed_rank(pairs, keys, diff).select(*keys, F.col("p").alias("rank_p"))
    joined = tt.alias("t").join(sw.alias("w"), same_keys("t", "w", keys), "left") \
        .join(sr.alias("r"), same_keys("t", "r", keys), "left")
    normal = F.coalesce(F.col("shapiro_p") > alpha, F.lit(False))
    return joined.select(*[f"t.{k}" for k in keys], "t.n", "shapiro_p",
                         F.when(normal, "paired t").otherwise("signed rank").alias("test"),
                         F.when(normal, F.col("t_p")).otherwise(F.col("rank_p")).alias("test_p"))
