"""Time spent per zone, zero-filled cells and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.operators.enrich import ENTITY, PARTS, TRIAL_SECONDS
from shoalspark.staging import small_side, stage


def time_in_zone(df: DataFrame, keys: Sequence[str], zone: str, entity: Sequence[str] = ENTITY,
                 frame: str = "frame", trial_s: float = TRIAL_SECONDS,
                 untracked: str = "drop") -> DataFrame:
    """Seconds per (keys, zone) as ``sum``; ``keys`` must contain the entity.

    A frame stands for ``trial_s / last frame`` seconds, the same for all frames of an entity, so
    the frames are only counted, combined before the one shuffle; the last frame is then taken
    over the entity's few cells. ``untracked="count"`` keeps the null zone as a zone of its own.
    """
    missing = [c for c in entity if c not in keys]
    if missing:
        raise ValueError(f"keys must contain the entity columns {missing}")
    cells = df.groupBy(*keys, zone).agg(F.count_if(F.col(frame) != 0).alias("__frames"),
                                        F.max(frame).alias("__top"))
    top = F.max("__top").over(Window.partitionBy(*entity))
    cells = cells.withColumn("sum", F.coalesce(
        F.try_divide(F.col("__frames") * F.lit(float(trial_s)), top), F.lit(0.0)))
    if untracked == "drop":
        cells = cells.where(F.col(zone).isNotNull())
    elif untracked != "count":
        raise ValueError("untracked is 'drop' or 'count'")
    return cells.drop("__frames", "__top")


def zero_fill(df: DataFrame, entity: Sequence[str], levels: Mapping[str, Sequence | None],
              measure: str = "sum", fill: float = 0.0, carry: Sequence[str] = (), block: int = 2048) -> DataFrame:
    """Every combination of an observed ``entity`` and the ``levels``; missing measures become ``fill``.

    ``entity`` lists columns whose observed combinations form one axis. A level list of None means
    the values observed anywhere in ``df`` (null included); a value outside a declared list is an
    error. Observed levels lie in blocks of about ``block`` by a hash of their text. An entity's cells are packed in one map per
    combination of blocks and looked up while the blocks' levels are exploded, so neither an axis nor an entity's cells
    are ever in one row. ``carry`` columns are kept where the cell exists and null elsewhere.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    label = {name: F.coalesce(F.col(name).cast("string"), F.lit("\u0000")) for name in levels}
    observed = [name for name, values in levels.items() if values is None]
    if observed:
        df = stage(df.select(*dict.fromkeys([*entity, *levels, measure, *carry])))
    tables, blocks, part = {}, {}, {}
    for name in observed:
        seen = stage(df.select(F.col(name).alias("v"), label[name].alias("l")).distinct())
        blocks[name] = max(1, -(-seen.count() // block))
        part[name] = lambda text, name=name: F.pmod(F.xxhash64(text), F.lit(blocks[name])).cast("int")
        tables[name] = small_side(seen.groupBy(part[name](F.col("l")).alias(f"__in_{name}"))
                                  .agg(F.sort_array(F.collect_list(F.struct("l", "v"))).alias(f"__levels_{name}")), 64)

    def declared(name: str) -> Column:
        known = F.array(*[F.coalesce(F.lit(v).cast(types[name]).cast("string"), F.lit("\u0000")) for v in levels[name]])
        wrong = F.raise_error(F.concat(F.lit(f"undeclared level of {name}: "), label[name])).cast("string")
        return F.when(F.array_contains(known, label[name]), label[name]).otherwise(wrong)

    inside = [f"__in_{name}" for name in observed]
    place = F.concat_ws("\u0001", *[label[name] if name in part else declared(name) for name in levels]) if levels else F.lit("")
    cells = df.select(*entity, *[part[name](label[name]).alias(f"__in_{name}") for name in observed],
                      F.struct(place.alias("k"), F.struct(measure, *carry).alias("v")).alias("__cell"))
    if any(n > 1 for n in blocks.values()):
        # an entity meets every block, also those without a cell of its own
        bare = df.select(*entity).distinct()
        for name in observed:
            bare = bare.withColumn(f"__in_{name}", F.explode(F.sequence(F.lit(0), F.lit(blocks[name] - 1))))
        cells = cells.unionByName(bare.withColumn("__cell", F.lit(None).cast(cells.schema["__cell"].dataType)))
    grid = cells.groupBy(*entity, *inside).agg(F.map_from_entries(F.collect_list("__cell")).alias("__cells"))
    for name in levels:
        if name in part:
            grid = grid.join(tables[name], f"__in_{name}").withColumn("__level", F.explode(f"__levels_{name}")).drop(f"__levels_{name}") \
                .withColumns({name: F.col("__level.v"), f"__label_{name}": F.col("__level.l")}).drop("__level")
        else:
            grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast(types[name]) for v in levels[name]]))) \
                .withColumn(f"__label_{name}", label[name])
    place = F.concat_ws("\u0001", *[f"__label_{name}" for name in levels]) if levels else F.lit("")
    grid = grid.withColumn("__hit", F.try_element_at("__cells", place))
    return grid.select(*entity, *levels, F.coalesce(F.col(f"__hit.{measure}"), F.lit(fill)).alias(measure),
                       *[F.col(f"__hit.{c}").alias(c) for c in carry])


def zone_share(cells: DataFrame, within: Sequence[str], zone: str, keep: str | None = None) -> DataFrame:
    """``total_sum`` over the zones of each ``within`` group and the share ``ratioside`` in percent.

    ``cells`` is aggregated already: a group holds one row per zone.
    """
    total = F.sum("sum").over(Window.partitionBy(*within))
    share = F.when(F.col("sum") == 0, F.lit(0.0)).otherwise(100 * F.try_divide(F.col("sum"), F.col("total_sum")))
    out = cells.withColumn("total_sum", total).withColumn("ratioside", share)
    return out if keep is None else out.where(F.col(zone) == keep)


def attraction_share(df: DataFrame, keys: Sequence[str], value: str = "ratioside", cut: float = 50.0) -> DataFrame:
    """Percent of rows above ``cut`` (attracted) and not above it (repulsed)."""
    n = F.count(value)
    up = F.count_if(F.col(value) > cut)
    return df.groupBy(*keys).agg(F.try_divide(100.0 * up, n).alias("attracted_pct"),
                                 F.try_divide(100.0 * (n - up), n).alias("repulsed_pct"))


def before_after_ratio(df: DataFrame, keys: Sequence[str], value: str = "ratioside", part: str = "part") -> DataFrame:
    """Before over After per key as ``slope``; null when a part is missing or After is zero."""
    before, after = (F.max(F.when(F.col(part) == p, F.col(value))) for p in PARTS)
    return df.groupBy(*keys).agg(F.try_divide(before, after).alias("slope"))
