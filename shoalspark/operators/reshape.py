"""Wide/long reshaping, pairing, lookups and covariate grids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.functions import expr as X
from shoalspark.operators.enrich import PARTS
from shoalspark.staging import small_side


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table written out in the program."""
    return spark.createDataFrame(list(rows), schema)


def compartment_long(df: DataFrame, keys: Sequence[str] = ("fish", "treatment", "minute", "part")) -> DataFrame:
    """Seconds in the cue and outside it as two rows per cell, with the share of each."""
    wide = df.select(*keys, "total_sum", F.col("sum").alias("cue"),
                     (F.col("total_sum") - F.col("sum")).alias("nocue"))
    long = wide.unpivot([*keys, "total_sum"], ["cue", "nocue"], "compartment", "time")
    share = F.when(F.col("time") == 0, F.lit(0.0)).otherwise(100 * F.try_divide(F.col("time"), F.col("total_sum")))
    return long.withColumn("ratioside", share)


def pair(df: DataFrame, entity: Sequence[str], value: str, part: str = "part", minus: str = "After") -> DataFrame:
    """One row per entity with ``Before``, ``After`` and ``diff`` = the other part minus ``minus``.

    Two values of one entity and part are an error: none of them is the value of the pair.
    """
    own = {p: F.when(F.col(part) == p, F.col(value)) for p in PARTS}
    both = df.groupBy(*entity).agg(*[f(c).alias(f"__{f.__name__}_{p}") for p, c in own.items() for f in (F.count, F.max)])
    twice = F.raise_error(F.concat(F.lit("several values of one part for "), F.to_json(F.struct(*entity)))).cast(dict(df.dtypes)[value])
    wide = both.select(*entity, *[F.when(F.col(f"__count_{p}") > 1, twice).otherwise(F.col(f"__max_{p}")).alias(p) for p in PARTS])
    other = PARTS[0] if minus == PARTS[1] else PARTS[1]
    return wide.withColumn("diff", F.col(other) - F.col(minus))


# fixed values: the output labels of the study
def change_summary(pairs: DataFrame, keys: Sequence[str], up: str = "augmentation", down: str = "baisse") -> DataFrame:
    """Mean difference per key and the direction it goes."""
    out = pairs.groupBy(*keys).agg(F.avg("diff").alias("mean_diff"))
    label = F.when(F.col("mean_diff") > 0, up).when(F.col("mean_diff").isNotNull(), down)
    return out.withColumn("direction", label)


def paired_text(pairs: DataFrame, diff_label: str = "Baisse") -> DataFrame:
    """Mean ± sd of Before, After and their difference as three text columns."""
    cols = {"before_text": ("Before", "Before"), "after_text": ("After", "After"),
            "diff_text": (diff_label, "diff")}
    return pairs.agg(*[X.mean_sd_text(label, F.avg(c), F.stddev_samp(c)).alias(name)
                       for name, (label, c) in cols.items()])


def center(df: DataFrame, col: str, by: Sequence[str], name: str | None = None, mean: str | None = None) -> DataFrame:
    """``col`` minus its group mean, which is kept as column ``mean`` if that is named.

    The means are a combined aggregate joined back, broadcast when they are few: groups may be as
    large as half the table, so neither a window nor a shuffle join should gather them.
    """
    means = small_side(df.groupBy(*by).agg(F.avg(col).alias("__mean")))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    kept = [F.col("r.__mean").alias(mean)] if mean else []
    return df.alias("l").join(means.alias("r"), on, "left") \
        .select("l.*", (F.col(f"l.{col}") - F.col("r.__mean")).alias(name or f"{col}_centered"), *kept)


def add_lookup(df: DataFrame, lookup: Mapping[str, float], on: str, name: str) -> DataFrame:
    """Left join to a small table written out in the program; a missing key gives null."""
    spark = df.sparkSession
    table = literal_table(spark, list(lookup.items()), f"{on} string, {name} double")
    return df.join(F.broadcast(table), on, "left")


def real_minute(df: DataFrame, minute: str = "minute_centered", mean: str = "mean_minute",
                ceil: bool = False, name: str = "minute") -> DataFrame:
    """Minute on the session clock from the centred one.

    Rounding up first drops float noise, which could lift a whole minute to the next.
    """
    m = F.col(minute) + F.col(mean)
    return df.withColumn(name, F.ceil(F.round(m, 9)) if ceil else m)


def tidy_param_names(df: DataFrame, col: str = "name", names: Sequence[str] = ("variable", "state"),
                     observation: str = "n_cuex") -> DataFrame:
    """``observation.shape1.state1.(Intercept)`` to its parts, blanks removed."""
    around = "|".join([re.escape(f"{observation}."), re.escape(".(Intercept)")])
    text = F.regexp_replace(F.regexp_replace(F.col(col), around, ""), " ", "")
    parts = F.split(text, r"\.")
    rest = [c for c in df.columns if c != col]
    return df.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], *rest)


def params_wide(df: DataFrame, id_col: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Parameter names to columns."""
    return df.groupBy(id_col).pivot(name, list(names)).agg(F.first(value))


def states_long(df: DataFrame, keys: Sequence[str], prefix: str = "state", name: str = "state",
                value: str = "prob") -> DataFrame:
    """All columns whose name contains ``prefix`` to rows."""
    cols = [c for c in df.columns if prefix in c and c not in keys]
    return df.select(*keys, *cols).unpivot(list(keys), cols, name, value)


def explode_list(df: DataFrame, col: str, index: str = "draw") -> DataFrame:
    """One row per list element with its 1-based position."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(col).alias("__p", col)).select(
        *rest, (F.col("__p") + 1).alias(index), col)


def matrix_long(df: DataFrame, col: str, keys: Sequence[str], label: str = "state", value: str = "freq") -> DataFrame:
    """An array-of-rows column to (from, to, value)."""
    rows = df.select(*keys, F.posexplode(col).alias("__i", "__row"))
    cells = rows.select(*keys, "__i", F.posexplode("__row").alias("__j", value))
    return cells.select(*keys, F.concat(F.lit(label), F.col("__i") + 1).alias("from"),
                        F.concat(F.lit(label), F.col("__j") + 1).alias("to"), value)


def flag_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]] = (("state1", "state3"), ("state3", "state1")),
               name: str = "of_interest") -> DataFrame:
    hit = reduce(lambda a, b: a | b, [(F.col("from") == a) & (F.col("to") == b) for a, b in pairs])
    return df.withColumn(name, hit)


def cov_grid(df: DataFrame, fixed: Mapping[str, Sequence[str]], entity: Sequence[str] = ()) -> DataFrame:
    """Observed entities times declared factor levels, numbered within the entity by ``cov_id``.

    The levels are literals exploded per entity row, so the entity table is never paired with itself.
    """
    spark = df.sparkSession
    grid = df.select(*entity).distinct() if entity else spark.range(1).select()
    cov = F.lit(0)
    for name, values in fixed.items():
        literal = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
        grid = grid.withColumn(f"__{name}", F.explode(literal))
        cov = cov * len(values) + F.col(f"__{name}.i")
    return grid.select(*entity, *[F.col(f"__{n}.v").alias(n) for n in fixed], (cov + 1).alias("cov_id"))


def attach_grid(draws: DataFrame, grid: DataFrame, on: Sequence[str] = ("cov_id",)) -> DataFrame:
    """Covariate columns for draws numbered by ``cov_id``."""
    return draws.join(grid, list(on), "left")


def marginal_mean(draws: DataFrame, keys: Sequence[str], value: str = "prob", draw: str = "draw") -> DataFrame:
    """Mean over entities within each draw."""
    return draws.groupBy(*keys, draw).agg(F.avg(value).alias(value))
