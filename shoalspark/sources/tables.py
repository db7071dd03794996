"""The sample tables seen as tracking frames. Every column is a row-wise expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: labels of the three treatments, and 30 days mapped on 1200 s in hundredths
TREATMENTS = ("C8AHL", "C8DMS0", "menthe")
MICROS_PER_CENTI = 21_600_000
FRAME_CENTIS = 50


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_as_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw frames: a user is a fish, 30 days are one 20-minute session.

    The frame number is the session clock at two frames a second, so it needs no window over a
    user's rows, and users with two events in one half second give true duplicate frames.
    """
    tracked = F.col("event_type") != "error"
    cs = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
                f" div {MICROS_PER_CENTI}L")
    raw = load(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", "props", cs.alias("cs"))

    def digits(expr: str):
        return F.lpad(F.expr(expr).cast("string"), 2, "0")

    group = F.col("user_id") % 3
    return raw.select(
        F.concat(digits("cs div 6000"), F.lit(":"), digits("(cs div 100) % 60"), F.lit("."),
                 digits("cs % 100")).alias("time"),
        F.expr(f"cs div {FRAME_CENTIS}").alias("frame"),
        F.when(tracked, (F.col("value") + 1) / (F.col("value") + 40)).alias("olf_x"),
        ((F.get_json_object("props", "$.k").try_cast("double") + 1) / 102).alias("olf_y"),
        F.when(tracked, F.col("value")).alias("speed_mm_per_sec"),
        F.when(tracked, F.col("value") / 10).alias("distance_mm"),
        F.when(F.expr("(user_id div 3) % 2 = 0"), "Right").otherwise("Left").alias("cue_side"),
        F.when(group == 0, TREATMENTS[0]).when(group == 1, TREATMENTS[1])
        .otherwise(TREATMENTS[2]).alias("treatment"),
        F.col("user_id").cast("string").alias("fish_replicate"),
    )
