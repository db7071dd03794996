"""Filters and data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions.expr import number
from shoalspark.operators.ranks import same_keys


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop named entities. As in SQL, a null name is dropped too."""
    return df.where(~F.col(col).isin(list(values)))


def keep(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def in_range(df: DataFrame, col: str, low: float, high: float, open_low: bool = False) -> DataFrame:
    """Rows of one display segment: ``low <= col <= high`` or ``low < col <= high``."""
    c = F.col(col)
    return df.where((c > low if open_low else c >= low) & (c <= high))


def split_untracked(df: DataFrame, col: str = "zone_side") -> tuple[DataFrame, DataFrame]:
    """(tracked rows, rows without a position)."""
    return df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())


# fixed values: the control cohort has replicates below 21, the other one is taken whole
COHORT: Mapping[str, float | None] = {"C8DMS0": 21.0, "C8AHL": None}


def valid_cohort(df: DataFrame, rules: Mapping[str, float | None] = COHORT,
                 fish: str = "fish", treatment: str = "treatment") -> DataFrame:
    """Rows of the declared treatments whose replicate number is below the treatment's bound."""
    def rule(name: str, below: float | None) -> Column:
        here = F.col(treatment) == name
        return here if below is None else here & (number(fish) < below)

    return df.where(reduce(Column.__or__, [rule(k, v) for k, v in rules.items()]))


def duplicates(df: DataFrame, key: Sequence[str] = ("fish", "treatment", "frame")) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    An aggregate combined before the shuffle, so a key with very many copies is no hot spot.
    """
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def duplicate_rows(df: DataFrame, key: Sequence[str] = ("fish", "treatment", "frame")) -> DataFrame:
    """The full rows behind ``duplicates``; null parts of a key are equal to each other, as there."""
    again = duplicates(df, key).drop("rows")
    return df.alias("l").join(again.alias("r"), same_keys("l", "r", key), "left_semi")


def unknown_levels(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Values outside the declared levels and their row counts."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(levels)))
            .groupBy(col).agg(F.count("*").alias("rows")))
