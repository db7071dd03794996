"""One query per operation, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.llm import collocations, conversations, jaccard_join, language, licences, line_dedup, mixing, near_vectors, phrases, quality, sharding, templates, url_cascade
from shoalspark.shipping import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixed values: the url list of the contract
URL_RULES = """VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)"""


@query
def op1_sharding(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op3_url_filters(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM {URL_RULES}")
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op4_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents")).drop("shares")


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op7_repeated_phrases(spark, sf_dir):
    kept = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_quality(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_decontamination(spark, sf_dir):
    return templates.by_document(templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op11_licence_scan(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


@query
def op12_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark, sf_dir):
    return conversations.summary(conversations.repair(table(spark, sf_dir, "conversations"), damage=True))
