"""Documents to training shards in five stages.

Each stage takes the rows its predecessor kept, and its decisions take effect: documents in no language go, one
document of each near-duplicate group stays, documents that leak benchmark items go, documents are repeated or
left out as the mix of sources takes them, and the rest is placed in shards. All stages but the last return the
columns of documents unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoalspark.llm import jaccard_join, language, mixing, sharding, templates
from shoalspark.shipping import ship_package
from shoalspark.staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language makes up a third or more; others have no language to speak of."""
    ship_package(spark)
    return language.in_a_language(docs)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group linked by five-word Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its numbers, names and units."""
    return templates.without_leaks(docs, templates.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each 0, 1 or 2 times, rounded so that every source keeps the words the mix takes of it."""
    ship_package(spark)
    return mixing.repeated_to_target(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.assign_shards(docs, 8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("jaccard_join", jaccard), ("decontamination", decontamination),
    ("mixing", mix), ("sharding", shard)]

#: hashes choose blocks and shards, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
