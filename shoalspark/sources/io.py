"""Readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalspark.functions.expr import clean

FRAMES = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("frame", T.LongType()),
    T.StructField("olf_x", T.DoubleType()),
    T.StructField("olf_y", T.DoubleType()),
    T.StructField("speed_mm_per_sec", T.DoubleType()),
    T.StructField("distance_mm", T.DoubleType()),
    T.StructField("cue_side", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("fish_replicate", T.StringType()),
])

META_FIELDS = ("species", "experiment", "treatment", "cue_side", "fish_replicate")
FRAMES_WITHOUT_META = T.StructType([f for f in FRAMES.fields if f.name not in META_FIELDS])


def drop_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[clean(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv", null_value: str = "NA") -> DataFrame:
    """One table: CSV with a header row, or a columnar format exported from a workbook.

    CSV columns are matched to ``schema`` by header name; the files of one folder share a header.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return drop_nan((reader.schema(schema) if schema else reader).load(path))
    if schema is None:
        raise ValueError("a CSV source needs a declared schema")
    return drop_nan(_csv(spark, path, schema, null_value)).drop("source_file")


def _csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str) -> DataFrame:
    reader = (spark.read.option("header", True).option("nullValue", null_value)
              .option("pathGlobFilter", "*.csv").option("nanValue", "NaN"))
    header = reader.option("inferSchema", False).csv(path)
    have = header.columns
    types = {f.name: f.dataType for f in schema.fields}
    declared = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in have])
    data = reader.schema(declared).option("enforceSchema", False).csv(path)
    # the file name travels along so that metadata can be read from it
    return data.select(*[F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c)
                         for c in types], F.col("_metadata.file_name").alias("source_file"))


def read_frames(spark: SparkSession, paths: str | Sequence[str],
                schema: T.StructType = FRAMES, null_value: str = "NA") -> DataFrame:
    """All tracking CSVs of one or several folders; a column a folder lacks is null there."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [drop_nan(_csv(spark, p, schema, null_value)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_file_metadata(df: DataFrame, file_name: str = "source_file", suffix: str = "_poseData",
                       fields: Sequence[str] = META_FIELDS) -> DataFrame:
    """Metadata columns from the file name ``a_b_c_d_e<suffix>.csv``.

    A name without exactly ``len(fields)`` parts gives nulls; see ``bad_file_names``.
    """
    parts = _name_parts(file_name, suffix)
    good = F.size(parts) == len(fields)
    keep = [c for c in df.columns if c not in fields]
    return df.select(*keep, *[F.when(good, parts.getItem(i)).alias(f) for i, f in enumerate(fields)])


def _name_parts(file_name: str, suffix: str):
    stem = F.regexp_replace(F.col(file_name), r"\.csv$", "")
    return F.split(F.regexp_replace(stem, f"{suffix}$", ""), "_")


def bad_file_names(df: DataFrame, file_name: str = "source_file", suffix: str = "_poseData",
                   n_fields: int = len(META_FIELDS)) -> DataFrame:
    """Names that do not split into the expected parts, with the number of rows they carry."""
    wrong = F.size(_name_parts(file_name, suffix)) != n_fields
    return df.where(wrong).groupBy(file_name).agg(F.count("*").alias("rows"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] = ()) -> None:
    """Write a result table; CSV gets a header row."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
