"""Grouped summaries, intervals, shape description and chart bins."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalspark.functions.expr import beta_log_density, col
from shoalspark.operators.ranks import group_quantiles


def stats(value: str | Column, prefix: str = "") -> list[Column]:
    """avg, sd, n (non-null) and se of one measure."""
    v = col(value)
    sd, n = F.stddev_samp(v), F.count(v)
    return [
        F.avg(v).alias(f"{prefix}avg"), sd.alias(f"{prefix}sd"), n.alias(f"{prefix}n"),
        F.try_divide(sd, F.sqrt(n)).alias(f"{prefix}se"),
    ]


def summarise(df: DataFrame, keys: Sequence[str], value: str | Column, prefix: str = "") -> DataFrame:
    """The workhorse ``avg, sd, n, se`` by any key list (also none)."""
    return df.groupBy(*keys).agg(*stats(value, prefix))


def with_bands(df: DataFrame, avg: str = "avg", widths: Sequence[str] = ("sd", "se")) -> DataFrame:
    """Lower and upper ends of mean ± sd and mean ± se."""
    ends = {}
    for w in widths:
        ends[f"{w}_low"] = F.col(avg) - F.col(w)
        ends[f"{w}_high"] = F.col(avg) + F.col(w)
    return df.withColumns(ends)


def median_qi(df: DataFrame, keys: Sequence[str], value: str, width: float = 0.95) -> DataFrame:
    """Median and central interval by key, with linear interpolation between order statistics."""
    probs = [0.5, (1 - width) / 2, 1 - (1 - width) / 2]
    q = group_quantiles(df, keys, value, probs)
    return q.select(*keys, F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("lower"),
                    F.col("quantiles")[2].alias("upper"))


def moment_columns(value: str | Column, unbiased: bool = True) -> list[Column]:
    """n, mean, sd, skewness and kurtosis (normal = 3), small-sample corrected on request."""
    v = col(value)
    n = F.count(v).cast("double")
    skew, kurt = F.skewness(v), F.kurtosis(v)
    if unbiased:
        skew = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
        excess = ((n + 1) * kurt + 6) * (n - 1)
        kurt = F.when(n > 3, F.try_divide(excess, (n - 2) * (n - 3)) + 3)
    else:
        kurt = kurt + 3
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
            skew.alias("skewness"), kurt.alias("kurtosis")]


def moments(df: DataFrame, value: str, keys: Sequence[str] = (), unbiased: bool = True) -> DataFrame:
    """Shape description: range, median and the first four moments."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"),
                                 *moment_columns(v, unbiased))
    med = group_quantiles(df, keys, value, [0.5])
    if not keys:
        # two one-row tables
        return base.withColumn("median", med.select(F.col("quantiles")[0]).scalar())
    med = med.select(*keys, F.col("quantiles")[0].alias("median"))
    on = [base[k].eqNullSafe(med[k]) for k in keys]
    return base.join(med, on, "left").select(base["*"], med["median"])


def bootstrap(df: DataFrame, value: str, reps: int = 1000, seed: int = 1,
              cluster: Sequence[str] = (), ids: Sequence[str] = (), unbiased: bool = True) -> DataFrame:
    """Moments of ``reps`` Poisson bootstrap resamples.

    Each task multiplies a weight matrix with the power sums of its rows and emits ``reps`` short
    rows, so nothing is exploded before the shuffle. Weights come from a hash of ``ids``
    (or of ``cluster``, whose rows are pre-aggregated and drawn together), never from task state:
    a retried task repeats them.
    """
    center = df.select(F.avg(value)).scalar()
    x = F.col(value) - center
    id_cols = list(cluster) or list(ids)
    if not id_cols:
        raise ValueError("name the columns that identify a row, or a cluster")
    powers = [F.lit(1.0), x, x * x, x * x * x, x * x * x * x]
    rows = df.where(F.col(value).isNotNull())
    if cluster:
        rows = rows.groupBy(*cluster).agg(*[F.sum(p).alias(f"p{i}") for i, p in enumerate(powers)])
        rows = rows.select(F.xxhash64(*cluster).alias("h"), *[f"p{i}" for i in range(5)])
    else:
        rows = rows.select(F.xxhash64(*ids).alias("h"), *[p.alias(f"p{i}") for i, p in enumerate(powers)])

    def partial(batches):
        total = np.zeros((reps, 5))
        for pdf in batches:
            data = pdf[[f"p{i}" for i in range(5)]].to_numpy(dtype=float)
            for lo in range(0, len(pdf), 4096):
                w = poisson_weights(pdf["h"].to_numpy()[lo:lo + 4096], reps, seed)
                total += w.T @ data[lo:lo + 4096]
        yield pd.DataFrame({"rep": np.arange(1, reps + 1), **{f"p{i}": total[:, i] for i in range(5)}})

    schema = "rep int, " + ", ".join(f"p{i} double" for i in range(5))
    sums = rows.mapInPandas(partial, schema).groupBy("rep").agg(
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(5)])
    n = F.col("p0")
    d, m2, m3, m4 = (F.try_divide(F.col(f"p{i}"), n) for i in range(1, 5))
    sums = sums.select("rep", n.alias("n"), d.alias("d"), (m2 - d * d).alias("v2"),
                       (m3 - 3 * d * m2 + 2 * d * d * d).alias("v3"),
                       (m4 - 4 * d * m3 + 6 * d * d * m2 - 3 * d * d * d * d).alias("v4"))
    n, v2 = F.col("n"), F.col("v2")
    skew = F.try_divide(F.col("v3"), F.pow(v2, 1.5))
    kurt = F.try_divide(F.col("v4"), v2 * v2)
    if unbiased:
        skew = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
        kurt = F.when(n > 3, F.try_divide(((n + 1) * (kurt - 3) + 6) * (n - 1), (n - 2) * (n - 3)) + 3)
    return sums.select("rep", "n", (F.col("d") + center).alias("mean"),
                       F.sqrt(F.try_divide(v2 * n, n - 1)).alias("sd"),
                       skew.alias("skewness"), kurt.alias("kurtosis"))


def poisson_weights(hashes: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (len(hashes), reps) from 64-bit hashes; the same hash gives the same row."""
    draw = np.arange(1, reps + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
    with np.errstate(over="ignore"):
        # fixed values: the mixing constants of the public splitmix64 finaliser
        z = hashes.astype(np.int64).view(np.uint64)[:, None] + draw[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    u = (z >> np.uint64(11)).astype(float) / float(1 << 53)
    law = np.cumsum(np.exp(-1.0) / np.array([np.exp(lgamma(k + 1)) for k in range(20)]))
    return np.searchsorted(law, u.ravel(), side="right").reshape(u.shape).astype(float)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None,
              keys: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins over [low, high]; bounds default to the observed range.

    Bins are closed on the right and the first one on both sides; a value within 1e-7 bin widths
    of an edge counts as lying on it. Empty bins are absent; a value outside is an error.
    """
    v = F.col(value)
    if low is None or high is None:
        seen = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
        lo = F.lit(float(low)) if low is not None else seen.select("low").scalar()
        hi = F.lit(float(high)) if high is not None else seen.select("high").scalar()
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    width = (hi - lo) / bins
    fuzz = 1e-7
    index = F.coalesce(F.ceil(F.try_divide(v - lo, width) - fuzz), F.lit(1))
    outside = F.raise_error(F.concat(F.lit("value outside the bins: "), v.cast("string"))).cast("bigint")
    index = F.when((v < lo - fuzz * width) | (v > hi + fuzz * width), outside).otherwise(index)
    binned = df.where(v.isNotNull()) \
        .select(*keys, F.least(F.greatest(index, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    return counts.select(*keys, "bin", (lo + (F.col("bin") - 1) * width).alias("low"),
                         (lo + F.col("bin") * width).alias("high"), "count")


def position_series(df: DataFrame, entity: Sequence[str], time: str = "secs",
                    values: Sequence[str] = ("cue_x",)) -> DataFrame:
    """Ordered position-over-time rows of all entities in one table."""
    return df.select(*entity, time, *values).orderBy(*entity, time)


def state_density(spark: SparkSession, shapes: Sequence[tuple[float, float]], points: int = 100) -> DataFrame:
    """Fitted state densities on an even grid strictly inside (0, 1)."""
    x = (F.col("id") + 0.5) / points
    grid = spark.range(points).select(x.alias("x"))
    states = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("state"), F.exp(beta_log_density("x", a, b)).alias("density"))
        for i, (a, b) in enumerate(shapes)]))
    return grid.select("x", states.alias("s")).select("x", "s.state", "s.density")


def density_vs_states(df: DataFrame, value: str, shapes: Sequence[tuple[float, float]],
                      bins: int = 50) -> DataFrame:
    """Observed density in each bin of (0, 1) next to every state's density at the bin centre."""
    # at most ``bins`` rows
    n = F.sum("count").over(Window.partitionBy(F.lit(1)))
    hist = histogram(df, value, bins, 0.0, 1.0)
    hist = hist.select("bin", ((F.col("low") + F.col("high")) / 2).alias("x"),
                       (F.col("count") * bins / n).alias("observed"))
    return hist.select("*", *[F.exp(beta_log_density("x", a, b)).alias(f"state{i + 1}")
                              for i, (a, b) in enumerate(shapes)])
