"""Named queries over the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalspark.functions import expr as X
from shoalspark.operators import enrich as E
from shoalspark.operators import kinematics as K
from shoalspark.operators import occupancy as O
from shoalspark.operators import paired as P
from shoalspark.operators import quality as Q
from shoalspark.operators import ranks as R
from shoalspark.operators import reshape as RS
from shoalspark.operators import summary as SM
from shoalspark.shipping import ship_package
from shoalspark.sources.io import read_frames, read_table, with_file_metadata, write_table
from shoalspark.sources.tables import events_as_frames
from shoalspark.staging import run_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MINUTES = list(range(1, 21))
CUE_ZONES = ["control", "cue"]
SIDES = ["Left", "Right"]
FISH = ["fish", "treatment"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, nudged so that a decimal tie rounds the same way on any engine."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = (F.round(c * F.lit(1 + 1e-11), 6) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return rounded(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.enrich(events_as_frames(spark, sf_dir))


# --- shared intermediate tables -----------------------------------------------------------


def cue_part(spark, sf_dir):
    """Share of time in the cue per fish and 10-minute part, missing cells filled with 0."""
    cells = O.time_in_zone(frames(spark, sf_dir), [*FISH, "cue_side", "part"], "zone_cue")
    cells = O.zero_fill(cells, [*FISH, "cue_side"], {"part": list(E.PARTS), "zone_cue": CUE_ZONES})
    return O.zone_share(cells, [*FISH, "cue_side", "part"], "zone_cue", keep="cue")


def zone_minute(spark, sf_dir, zone, levels):
    cells = O.time_in_zone(frames(spark, sf_dir), [*FISH, "minute", "part"], zone)
    cells = O.zero_fill(cells, FISH, {"minute": MINUTES, zone: levels})
    cells = E.with_part_from_minute(cells).drop("part_ord", "minute_relative")
    return O.zone_share(cells, [*FISH, "minute", "part"], zone)


def cue_minute(spark, sf_dir):
    return zone_minute(spark, sf_dir, "zone_cue", CUE_ZONES).where(F.col("zone_cue") == "cue")


def cue_pairs(spark, sf_dir, minus="After"):
    return RS.pair(cue_part(spark, sf_dir), FISH, "ratioside", minus=minus)


def speed_minute_table(spark, sf_dir):
    return K.speed_per_minute(K.speed_per_second(frames(spark, sf_dir)))


def speed_pairs(spark, sf_dir):
    per_part = speed_minute_table(spark, sf_dir).groupBy(*FISH, "part").agg(F.avg("m1").alias("mean_speed"))
    return RS.pair(per_part, FISH, "mean_speed", minus="Before")


# --- enrichment and quality ---------------------------------------------------------------


@query
def cue_share_by_part(spark, sf_dir):
    return SM.summarise(cue_part(spark, sf_dir), ["part", "treatment"], "ratioside")


@query
def frames_enriched(spark, sf_dir):
    df = E.with_time_lag(E.with_bucket(frames(spark, sf_dir)))
    df = E.with_key(df, FISH, "fish_id")
    return df.select("fish", "treatment", "fish_id", "frame", "secs", "second", "minute", "bucket", "cue_x",
                     "olf_y", "zone_side", "zone_cue", "part", "part_ord", "max_frame", "timelag")


@query
def time_lag_summary(spark, sf_dir):
    df = E.with_time_lag(frames(spark, sf_dir))
    return df.groupBy(*FISH).agg(F.max("max_frame").alias("max_frame"), F.count("timelag").alias("lagged"),
                                 F.sum("timelag").alias("seconds"))


@query
def file_metadata(spark, sf_dir):
    """Metadata from file-name text: four-part names (every seventh fish) give nulls."""
    raw = events_as_frames(spark, sf_dir)
    n = F.col("fish_replicate").cast("bigint")
    name = F.concat_ws("_", F.lit("zebra"), F.lit("e1"), "treatment",
                       F.when(n % 7 != 0, F.col("cue_side")), "fish_replicate")
    df = raw.select("frame", F.concat(name, F.lit("_poseData.csv")).alias("source_file"))
    meta = with_file_metadata(df)
    return meta.groupBy("species", "experiment", "treatment", "cue_side", "fish_replicate") \
        .agg(F.count("*").alias("rows"))


@query
def untracked_rows(spark, sf_dir):
    _, removed = Q.split_untracked(frames(spark, sf_dir))
    return removed.groupBy(*FISH, "part").agg(F.count("*").alias("rows"))


@query
def untracked_frames(spark, sf_dir):
    _, removed = Q.split_untracked(frames(spark, sf_dir))
    return removed.select(*FISH, "frame", "secs", "minute", "part")


@query
def duplicate_frames(spark, sf_dir):
    return Q.duplicates(frames(spark, sf_dir))


@query
def duplicate_frame_rows(spark, sf_dir):
    return Q.duplicate_rows(frames(spark, sf_dir)).select(*FISH, "frame", "secs", "cue_x")


@query
def cohort_rows(spark, sf_dir):
    df = Q.exclude(frames(spark, sf_dir), "fish", ["13"])
    return Q.valid_cohort(df).groupBy(*FISH).agg(F.count("*").alias("rows"), F.min("frame").alias("first_frame"),
                                                 F.max("frame").alias("last_frame"))


@query
def complete_rows(spark, sf_dir):
    """Rows without any missing value, by treatment and display segment."""
    df = frames(spark, sf_dir).select("treatment", "minute", "cue_x", "olf_y", "speed_mm_per_sec").dropna("any")
    early = Q.in_range(df, "minute", 0, 10).withColumn("segment", F.lit("first"))
    late = Q.in_range(df, "minute", 10, 20, open_low=True).withColumn("segment", F.lit("second"))
    return early.unionByName(late).groupBy("treatment", "segment").agg(
        F.count("*").alias("rows"), F.avg("speed_mm_per_sec").alias("speed"))


@query
def treatment_levels(spark, sf_dir):
    """Distinct labels with ordinal, dummies for another reference level, and a display name."""
    df = frames(spark, sf_dir).select("treatment", "part").distinct()
    df = E.with_levels(df, "treatment", ["C8AHL", "C8DMS0", "menthe"], ref="C8DMS0")
    df = E.recode(df, "part", {"Before": "Avant", "After": "Après"}, "partie")
    df = E.recode(df, "treatment", {"menthe": "mint"}, "display")
    return E.with_key(df, ["part", "treatment"], "interaction", sep=".")


@query
def part_position_summary(spark, sf_dir):
    df = E.with_bucket(Q.exclude(frames(spark, sf_dir), "fish", ["13"]))
    return SM.summarise(df, ["part", "treatment", "bucket"], "cue_x")


@query
def position_series(spark, sf_dir):
    return SM.position_series(frames(spark, sf_dir), FISH, "secs", ["cue_x", "part"])


# --- occupancy ----------------------------------------------------------------------------


@query
def side_share_minute(spark, sf_dir):
    return zone_minute(spark, sf_dir, "zone_side", SIDES).where(F.col("zone_side") == "Right")


@query
def cue_share_minute(spark, sf_dir):
    return cue_minute(spark, sf_dir)


@query
def cue_share_minute_summary(spark, sf_dir):
    return SM.with_bands(SM.summarise(cue_minute(spark, sf_dir), ["part", "treatment", "minute"], "ratioside"))


@query
def cue_share_crossed(spark, sf_dir):
    """Zero-fill that crosses every fish with every treatment, then the cohort rule."""
    # staged, as the observed levels are read from it next to the cells
    cells = stage(O.time_in_zone(frames(spark, sf_dir), [*FISH, "minute", "part"], "zone_cue"))
    cells = O.zero_fill(cells, ["fish"], {"minute": None, "zone_cue": None, "treatment": None})
    cells = Q.valid_cohort(E.with_part_from_minute(cells).drop("part_ord", "minute_relative"))
    shares = O.zone_share(cells, [*FISH, "minute", "part"], "zone_cue", keep="cue")
    return SM.summarise(shares, ["part", "minute", "treatment"], "ratioside")


@query
def cue_share_untracked(spark, sf_dir):
    """Shares in which lost frames count as a third zone."""
    cells = O.time_in_zone(frames(spark, sf_dir), [*FISH, "part"], "zone_cue", untracked="count")
    cells = O.zero_fill(cells, FISH, {"zone_cue": [*CUE_ZONES, None], "part": list(E.PARTS)})
    return O.zone_share(cells, [*FISH, "part"], "zone_cue")


@query
def side_share_part(spark, sf_dir):
    cells = O.time_in_zone(frames(spark, sf_dir), [*FISH, "part"], "zone_side")
    return O.zone_share(cells, [*FISH, "part"], "zone_side", keep="Right")


@query
def cue_share_part(spark, sf_dir):
    return cue_part(spark, sf_dir)


@query
def attraction_share(spark, sf_dir):
    return O.attraction_share(cue_part(spark, sf_dir), ["treatment", "part"])


@query
def attraction_flags(spark, sf_dir):
    df = E.with_flag(cue_part(spark, sf_dir), "ratioside", 50.0, "attracted")
    return df.select(*FISH, "part", "attracted", (1 - F.col("attracted")).alias("repulsed"))


@query
def before_after_ratio(spark, sf_dir):
    df = Q.exclude(cue_part(spark, sf_dir), "fish", ["13"])
    return O.before_after_ratio(df, [*FISH, "cue_side"])


# --- kinematics ---------------------------------------------------------------------------


@query
def speed_per_second(spark, sf_dir):
    return K.speed_per_second(frames(spark, sf_dir))


@query
def speed_fish_minute(spark, sf_dir):
    return E.with_key(speed_minute_table(spark, sf_dir), FISH, "fish_id")


@query
def speed_minute(spark, sf_dir):
    return SM.with_bands(K.speed_across(speed_minute_table(spark, sf_dir)))


@query
def distance_fish_minute(spark, sf_dir):
    return K.distance_per_minute(frames(spark, sf_dir))


@query
def distance_minute(spark, sf_dir):
    return K.distance_across(K.distance_per_minute(frames(spark, sf_dir)))


@query
def speed_change(spark, sf_dir):
    return RS.change_summary(speed_pairs(spark, sf_dir), ["treatment"])


# --- reshaping ----------------------------------------------------------------------------


@query
def compartment_long(spark, sf_dir):
    return RS.compartment_long(cue_minute(spark, sf_dir))


@query
def percent_of_minute(spark, sf_dir):
    """Seconds per compartment as percent of a minute, display labels recoded."""
    df = E.with_percent(RS.compartment_long(cue_minute(spark, sf_dir)), "time", 60.0, "time_pct")
    df = E.recode(df, "compartment", {"cue": "C8AHL", "nocue": "DMSO"}, "label")
    return SM.summarise(df, ["treatment", "label", "part"], "time_pct")


@query
def paired_cue_share(spark, sf_dir):
    return cue_pairs(spark, sf_dir)


@query
def paired_summary_text(spark, sf_dir):
    return RS.paired_text(cue_pairs(spark, sf_dir))


@query
def centered_minute(spark, sf_dir):
    df = speed_minute_table(spark, sf_dir).select(*FISH, "part", "minute", "m1")
    return RS.center(df, "minute", ["part"])


@query
def real_minute_lookup(spark, sf_dir):
    """Steps around the part mean of the data, put back on the session clock."""
    df = speed_minute_table(spark, sf_dir).select(*FISH, "part", "minute", "m1")
    df = RS.center(df, "minute", ["part"], mean="mean_minute").drop("minute")
    return RS.real_minute(df, ceil=True).groupBy("part", "treatment", "minute").agg(
        F.count("*").alias("rows"), F.avg("minute_centered").alias("minute_centered"))


@query
def minute_relative(spark, sf_dir):
    df = E.with_part_from_minute(cue_minute(spark, sf_dir))
    return SM.summarise(df, ["part_ord", "minute_relative"], "ratioside")


@query
def covariate_grid(spark, sf_dir):
    return RS.cov_grid(frames(spark, sf_dir), {"part": list(E.PARTS)}, FISH)


@query
def speed_table_handoff(spark, sf_dir):
    """Speed per fish and minute written as one CSV per study, read back and stacked."""
    table = stage(speed_minute_table(spark, sf_dir))
    folder = f"{run_folder(spark)}/handoff-{uuid.uuid4().hex}"
    for name, rows in {"cue": table.where("treatment <> 'menthe'"), "mint": table.where("treatment = 'menthe'")}.items():
        write_table(rows, f"{folder}/{name}", "csv")
    back = [read_table(spark, f"{folder}/{name}", table.schema) for name in ("cue", "mint")]
    return E.with_key(back[0].unionByName(back[1]), FISH, "fish_id")


@query
def cohort_folders(spark, sf_dir):
    """Raw frames of two cohorts as folders of CSV files, one without a speed column, read back as one table."""
    raw = events_as_frames(spark, sf_dir)
    folder = f"{run_folder(spark)}/folders-{uuid.uuid4().hex}"
    write_table(raw.where("treatment <> 'menthe'"), f"{folder}/cue", "csv")
    write_table(raw.where("treatment = 'menthe'").drop("speed_mm_per_sec"), f"{folder}/mint", "csv")
    df = E.enrich(read_frames(spark, [f"{folder}/cue", f"{folder}/mint"]))
    return df.groupBy("treatment", "part").agg(
        F.count("*").alias("rows"), F.count("cue_x").alias("tracked"), F.count("speed_mm_per_sec").alias("with_speed"),
        F.avg("cue_x").alias("cue_x"))


@query
def columnar_table(spark, sf_dir):
    """A result table through a columnar file instead of CSV."""
    table = stage(speed_minute_table(spark, sf_dir))
    path = f"{run_folder(spark)}/columnar-{uuid.uuid4().hex}"
    write_table(table, path, "orc")
    return read_table(spark, path, fmt="orc")


@query
def kept_fish(spark, sf_dir):
    """Named entities and treatments only."""
    df = Q.keep(Q.keep(frames(spark, sf_dir), "treatment", ["C8AHL", "menthe"]), "fish", ["1", "3", "4", "13"])
    return df.groupBy(*FISH).agg(F.count("*").alias("rows"), F.count("cue_x").alias("tracked"))


@query
def marginal_share_interval(spark, sf_dir):
    """Each fish-part's minute shares as numbered draws, joined to the covariate grid, averaged over
    fish within a draw and summarised over draws."""
    df = E.with_part_from_minute(stage(cue_minute(spark, sf_dir)))
    cells = df.groupBy(*FISH, "part").agg(F.array_sort(F.collect_list(F.struct("minute_relative", "ratioside"))).alias("q"))
    lists = RS.explode_list(cells.select(*FISH, "part", F.col("q.ratioside").alias("prob")), "prob")
    grid = RS.cov_grid(df, {"part": list(E.PARTS)}, FISH)
    numbered = lists.withColumn("cov_id", X.level_index("part", E.PARTS) + 1).drop("part")
    joined = RS.attach_grid(numbered, grid, [*FISH, "cov_id"])
    per_draw = stage(RS.marginal_mean(joined, ["part", "treatment"]))
    return SM.median_qi(per_draw, ["part", "treatment"], "prob")


# --- tests --------------------------------------------------------------------------------


@query
def paired_t(spark, sf_dir):
    return P.paired_t(cue_pairs(spark, sf_dir), ["treatment"])


@query
def paired_t_speed(spark, sf_dir):
    return P.paired_t(speed_pairs(spark, sf_dir))


@query
def welch_t(spark, sf_dir):
    return P.welch_t(cue_pairs(spark, sf_dir), "treatment", ("C8AHL", "C8DMS0"))


@query
def signed_rank(spark, sf_dir):
    return P.signed_rank(stage(cue_pairs(spark, sf_dir)), ["treatment"])


@query
def signed_rank_speed(spark, sf_dir):
    return P.signed_rank(stage(speed_pairs(spark, sf_dir)))


@query
def shapiro(spark, sf_dir):
    return P.shapiro(stage(speed_pairs(spark, sf_dir)), ["treatment"])


@query
def shapiro_minute_share(spark, sf_dir):
    """Normality of a whole column."""
    return P.shapiro(stage(cue_minute(spark, sf_dir).select("ratioside")), value="ratioside")


@query
def gated_test(spark, sf_dir):
    return P.gated_test(stage(speed_pairs(spark, sf_dir)), ["treatment"])


# --- distributions ------------------------------------------------------------------------


@query
def median_interval(spark, sf_dir):
    return SM.median_qi(frames(spark, sf_dir), ["part", "treatment"], "cue_x")


@query
def shape_moments(spark, sf_dir):
    return SM.moments(stage(cue_minute(spark, sf_dir)), "sum", ["treatment"])


@query
def bootstrap_moments(spark, sf_dir):
    df = stage(cue_minute(spark, sf_dir))
    return SM.bootstrap(df, "sum", reps=1000, ids=[*FISH, "minute"])


@query
def bootstrap_moments_by_fish(spark, sf_dir):
    df = stage(cue_minute(spark, sf_dir))
    return SM.bootstrap(df, "sum", reps=1000, cluster=FISH)


@query
def histogram(spark, sf_dir):
    return SM.histogram(cue_minute(spark, sf_dir), "ratioside", 20, 0.0, 100.0, ["part"])


@query
def qq_points(spark, sf_dir):
    pairs = stage(speed_pairs(spark, sf_dir).select("diff", "treatment"))
    return R.qq_points(pairs, "diff", ["treatment"])
