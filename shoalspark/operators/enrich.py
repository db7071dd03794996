"""Row-wise derivations from raw frames, and the per-entity frame time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import expr as X
from shoalspark.staging import small_side

CHANGE_AT = 600.0
LAST_BEFORE = 10
TRIAL_SECONDS = 1200.0
PARTS = ("Before", "After")
ENTITY = ("fish", "treatment")


def parse_session_time(df: DataFrame, time: str = "time") -> DataFrame:
    """``MM:SS.cc`` cut by position into ``secs``, ``second`` of the minute and 1-based ``minute``."""
    def part(pos):
        return F.substring(time, pos, 2).try_cast("int")

    mm, ss, cc = part(1), part(4), part(7)
    return df.withColumns({
        "second": ss,
        "secs": 60 * mm + ss + cc * F.lit(0.01),
        "minute": mm + 1,
    })


def with_zone(df: DataFrame, x: str = "olf_x", cue_side: str = "cue_side", cut: float = 0.5) -> DataFrame:
    """Cue-relative coordinate, side of the arena and cue zone."""
    return df.withColumn("cue_x", X.mirrored(x, cue_side)).withColumns({
        "zone_side": X.two_way(x, cut, "Left", "Right"),
        "zone_cue": X.two_way("cue_x", cut, "control", "cue"),
    })


def with_part(df: DataFrame, secs: str = "secs", change_at: float = CHANGE_AT) -> DataFrame:
    """``part`` (Before/After) and its ordinal."""
    part = X.two_way(secs, change_at, *PARTS)
    return df.withColumns({"part": part, "part_ord": X.level_index(part, PARTS)})


def with_part_from_minute(df: DataFrame, minute: str = "minute",
                          last_before: int = LAST_BEFORE) -> DataFrame:
    """``part`` from the minute number; also the 0/1 period and the minute within its period."""
    m = F.col(minute)
    return df.withColumns({
        "part": F.when(m.between(1, last_before), PARTS[0]).when(m.isNotNull(), PARTS[1]),
        "part_ord": (m > last_before).cast("int"),
        "minute_relative": F.when(m <= last_before, m).when(m > last_before, m - last_before),
    })


def with_bucket(df: DataFrame, secs: str = "secs", width: float = 1.0, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, X.second_bucket(secs, width))


def with_key(df: DataFrame, cols: Sequence[str], name: str, sep: str = "_") -> DataFrame:
    return df.withColumn(name, X.key(*cols, sep=sep))


def recode(df: DataFrame, col: str, mapping: Mapping[str, str], name: str | None = None) -> DataFrame:
    return df.withColumn(name or col, X.recode(col, mapping))


def with_levels(df: DataFrame, col: str, levels: Sequence[str], ref: str | None = None) -> DataFrame:
    """Ordinal and 0/1 dummy columns of a categorical column; ``ref`` moves one level to the front.

    A value outside ``levels`` gets null ordinals and dummies.
    """
    order = [ref, *[v for v in levels if v != ref]] if ref is not None else list(levels)
    index = X.level_index(col, order)
    dummies = {f"{col}_{v}": (index == i).cast("int") for i, v in enumerate(order) if i > 0}
    return df.withColumns({f"{col}_ord": index, **dummies})


def with_percent(df: DataFrame, col: str, total: float = 60.0, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_pct", X.percent_of(col, total))


def with_flag(df: DataFrame, col: str, threshold: float, name: str = "flag") -> DataFrame:
    """0/1 flag of ``col > threshold``, null where the value is null."""
    return df.withColumn(name, (F.col(col) > threshold).cast("int"))


def enrich(df: DataFrame, cut: float = 0.5, change_at: float = CHANGE_AT) -> DataFrame:
    """Raw frames to enriched frames: one narrow projection, no shuffle."""
    df = parse_session_time(df).withColumnRenamed("fish_replicate", "fish")
    return with_part(with_zone(df, cut=cut), change_at=change_at)


def with_time_lag(df: DataFrame, entity: Sequence[str] = ENTITY, frame: str = "frame",
                  trial_s: float = TRIAL_SECONDS) -> DataFrame:
    """Seconds each frame stands for: trial length over the entity's last frame, null at frame 0.

    The last frame per entity is a map-side combined maximum joined back, so no window ever holds
    an entity's frames. Occupancy does not need this column, see ``time_in_zone``.
    """
    top = small_side(df.groupBy(*entity).agg(F.max(frame).alias("max_frame")), 1_000_000)
    l, r = df.alias("l"), top.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in entity]
    lag = F.when(F.col(frame) != 0, F.try_divide(F.lit(float(trial_s)), F.col("max_frame")))
    return l.join(r, on, "left").select("l.*", "r.max_frame").withColumn("timelag", lag)
