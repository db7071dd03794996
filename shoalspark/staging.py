"""Reliable materialisation of aggregated tables that several jobs read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="shoalspark-")
        sc.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables; the file system deletes it when the JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_dir(spark)}/shoalspark-{app}"
    path, fs = _hadoop(spark, _FOLDERS[app])
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return _FOLDERS[app]


def release(spark: SparkSession) -> None:
    """Delete every staged table of this application now; frames that read them end with it."""
    folder = _FOLDERS.get(spark.sparkContext.applicationId)
    if folder:
        path, fs = _hadoop(spark, folder)
        fs.delete(path, True)


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet, with the writer's ``options``, and cut its lineage.

    Used where an algorithm passes over an aggregated table more than once, so that the frames
    are scanned one time only and a lost executor costs a re-read of the written table.
    """
    folder = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` staged, with a broadcast hint if it has at most ``max_rows`` rows.

    A larger table is returned without the hint and joins by shuffle.
    """
    staged = stage(df)
    return F.broadcast(staged) if staged.limit(max_rows + 1).count() <= max_rows else staged


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for steps whose cost is compute rather than bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
