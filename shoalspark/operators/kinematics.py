"""Speed and distance summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.operators.ranks import narrow_quantiles
from shoalspark.operators.summary import stats, summarise

SECOND_KEYS = ("fish", "treatment", "part", "minute", "second")
MINUTE_KEYS = ("fish", "treatment", "part", "minute")


def speed_per_second(df: DataFrame, keys: Sequence[str] = SECOND_KEYS, value: str = "speed_mm_per_sec",
                     approx: bool = False) -> DataFrame:
    """Median speed of every second as ``speedsec``; exact unless ``approx`` asks for the sketch.

    One entity's second holds as many rows as the camera takes frames, so the built-in percentile fits.
    """
    if approx:
        return df.groupBy(*keys).agg(F.percentile_approx(value, 0.5).alias("speedsec"))
    q = narrow_quantiles(df, keys, value, [0.5])
    return q.select(*keys, F.col("quantiles")[0].alias("speedsec"))


def speed_per_minute(per_second: DataFrame, keys: Sequence[str] = MINUTE_KEYS) -> DataFrame:
    """``m1, sd, n, se`` of the per-second medians."""
    return per_second.groupBy(*keys).agg(*[
        c.alias("m1") if i == 0 else c for i, c in enumerate(stats("speedsec"))])


def speed_across(per_minute: DataFrame, keys: Sequence[str] = ("part", "treatment", "minute")) -> DataFrame:
    return summarise(per_minute, keys, "m1")


def distance_per_minute(df: DataFrame, keys: Sequence[str] = MINUTE_KEYS, value: str = "distance_mm") -> DataFrame:
    """Distance swum; a minute without any tracked frame counts as 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("sumdist"))


def distance_across(per_minute: DataFrame, keys: Sequence[str] = ("minute", "part")) -> DataFrame:
    return summarise(per_minute, keys, "sumdist")
