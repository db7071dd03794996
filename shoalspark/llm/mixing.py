"""Mixing sources to target weights by divisor apportionment with odd divisors (Sainte-Lague).

The corpus is cut into blocks of equally many words: documents of a source are dealt to hash shards, laid end
to end in seeded order, and cut every ``block`` words. Integer block quotas go first to sources, then inside a
source to its shards, always to the highest quotient weight / (2 seats + 1). A shard then takes its quota by a
seeded permutation of its blocks, none more than twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.staging import stage

WORDS = r"[^\x20\x09-\x0D]+"
#: prime, so i -> i * STRIDE + b permutes the residues of every smaller modulus
STRIDE = 2_147_483_647


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words by source from (source, source_size): weights by rank, stopped at ``most`` times the size.

    The shared total is poured over all sources at one level per weight; a source whose cap lies below the
    level keeps its cap. The windows run over the table of sources.
    """
    every = Window.partitionBy(F.lit(1))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    ws = F.lit([float(w) for w in weights])
    t = sizes.withColumn("w", F.get(ws, (rank - 1) % len(weights))) \
        .withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = every.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(every) * float(share)
    spent = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (total - spent) / weight_left)
    free = F.col("level") <= F.col("ratio")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("ratio"))).over(every)
    level = F.coalesce(level, F.lit(0.0))
    return t.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def apportion(items: DataFrame, group: Sequence[str], weight: str, seats: str, cap: str, tie: Sequence[Column]) -> DataFrame:
    """``items`` with an integer ``quota`` each; quotas of a group add up to its ``seats`` unless caps bind.

    Seats every item surely gets, and could get at most, follow from two divisors around the mean one, so only
    a few quotients per item are ranked.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    n, w = F.count("*").over(g), F.sum(weight).over(g)

    def rounded(at: Column) -> Column:
        return F.when(w > 0, F.floor(F.greatest(at, F.lit(0.0)) * F.col(weight) / w + 0.5)).otherwise(0).cast("bigint")

    base = items.withColumn("__lo", F.least(rounded(F.col(seats) - n / 2.0), F.col(cap))) \
        .withColumn("__hi", F.least(rounded(F.col(seats) + n / 2.0 + 1), F.col(cap)))
    open_ = F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo") + 1, F.col("__hi"))) \
        .otherwise(F.array(F.lit(None).cast("bigint")))
    base = base.withColumn("__left", F.col(seats) - F.sum("__lo").over(g))
    seat = base.withColumn("__k", F.explode(open_))
    quotient = F.when(F.col("__k").isNotNull(), F.col(weight) / (2 * F.col("__k") - 1)).otherwise(-1.0)
    by_quotient = g.orderBy(quotient.desc(), *tie, "__k")
    seat = seat.withColumn("__won", (F.row_number().over(by_quotient) <= F.col("__left")) & F.col("__k").isNotNull())
    own = [c for c in items.columns]
    return seat.groupBy(*own, "__lo").agg(F.count_if("__won").alias("__extra")) \
        .select(*own, (F.col("__lo") + F.col("__extra")).alias("quota"))


def row_key(seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """doc_id, source, size in words and the seeded hash ``h``, equal for rows equal in id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.encode(text, "UTF-8"))).alias("h")]


def taken_words(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = 2048,
                max_block: int = 64) -> DataFrame:
    """The rows of ``mix`` with their hash ``h``, the source's ``key`` and the ``shard`` inside it."""
    rows = docs.select(*row_key(seed, id_col, text_col, source_col))
    rows = stage(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stage(source_targets(sizes, weights, share, most).join(
        sizes.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    total = targets.agg(F.sum("source_size").alias("words"), F.sum("target").alias("target")).first()
    words, wanted = total.words or 0, total.target or 0.0
    block = max(1, min(max_block, words // 100_000))

    # joins on the source use a non-null name, so that null is a source like any other
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    plan = F.broadcast(targets) if targets.limit(100_001).count() <= 100_000 else targets
    plan = plan.withColumn("key", named).drop("source").withColumn("shards", F.expr(f"1 + n div {shard_rows}L"))
    dealt = rows.withColumn("key", named).join(plan, "key") \
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("shards")))
    parts = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    parts = stage(parts.withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}L")))

    seats = round(wanted / block)
    by_source = parts.groupBy("key").agg(F.sum("blocks").alias("blocks")).join(plan.select("key", "target"), "key") \
        .withColumn("cap", F.col("blocks") * most).withColumn("seats", F.lit(seats).cast("bigint"))
    by_source = apportion(by_source, [], "target", "seats", "cap", [F.col("key")]).select("key", F.col("quota").alias("seats"))
    by_shard = parts.join(by_source, "key").withColumn("cap", F.col("blocks") * most)
    quotas = apportion(by_shard, ["key"], "words", "seats", "cap", [F.col("shard")]).select("key", "shard", "blocks", "quota")

    laid = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("begin", F.col("end") - F.col("size"))
    both = placed.join(quotas, ["key", "shard"])
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("blocks"))

    def overlap(acc: Column, i: Column) -> Column:
        picks = F.expr("quota div blocks") + F.when(
            F.pmod(i * F.lit(STRIDE).cast("bigint") + offset, F.col("blocks")) < F.col("quota") % F.col("blocks"), 1).otherwise(0)
        return acc + picks * (F.least(F.col("end"), (i + 1) * block) - F.greatest(F.col("begin"), i * block))

    cut = F.sequence(F.expr(f"begin div {block}L"), F.expr(f"(end - 1) div {block}L"))
    taken = F.when(F.col("size") > 0, F.aggregate(cut, F.lit(0).cast("bigint"), overlap)).otherwise(0).cast("bigint")
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "h", "key", "shard")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = 2048,
        max_block: int = 64) -> DataFrame:
    """How many words of every document the mix takes.

    Returns doc_id, source, size (words), source_size, target and taken for every row, null ids, null sources
    and repeated rows included; a null or empty text has size 0 and takes 0. Rows equal in id and text are
    interchangeable. An empty table gives no rows. Other columns are ignored. Reruns agree, as every choice is
    a hash of the seed and the row.
    """
    return taken_words(docs, weights, share, most, seed, id_col, text_col, source_col, shard_rows, max_block) \
        .select("doc_id", "source", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """Documents as the mix takes them: whole texts, each 0 to ``most`` times, the nearest number to its share.

    ``mixed`` has doc_id and taken; rows that share an id are told apart by size. Columns stay as they are.
    """
    copies = F.least(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"), F.lit(most))
    per = mixed.where((F.col("size") > 0) & (copies > 0)).groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")) \
        .agg(F.max(copies).alias("__copies"))
    size = F.regexp_count(F.coalesce(F.col(f"__row.{text_col}"), F.lit("")), F.lit(WORDS)).cast("bigint")
    rows = docs.select(F.struct("*").alias("__row")).withColumn("__n", size)
    joined = rows.join(per, F.col(f"__row.{id_col}").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")))
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def rounded_copies(batches):
    """Whole copies of every row, rows coming shard by shard: the words owed are carried from row to row.

    A row gets ``taken div size`` copies, and one more if the words owed so far reach its share ``u`` of its size; so
    a row is chosen about as often as its remaining words are part of its size, and the carry stays within the
    largest row. Large rows come first, so that small ones settle what is left.
    """
    at, owed = None, 0.0
    for pdf in batches:
        copies = []
        for shard, size, taken, u in zip(zip(pdf["none"], pdf["name"], pdf["shard"]), pdf["size"].tolist(), pdf["taken"].tolist(), pdf["u"].tolist()):
            if shard != at:
                at, owed = shard, 0.0
            n, rest = divmod(taken, size)
            if rest:
                owed += rest
                if owed >= u * size:
                    n, owed = n + 1, owed - size
            copies.append(n)
        yield pd.DataFrame({"id": pdf["id"], "none": pdf["none"], "name": pdf["name"], "h": pdf["h"], "size": pdf["size"], "copies": copies})


def repeated_to_target(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mixing) -> DataFrame:
    """Documents as the mix takes them: whole texts, 0 to ``most`` times, so that sources keep their taken words.

    ``mixing`` are parameters of ``mix``. Copies are rounded by shard, see ``rounded_copies``. Columns stay as they are; of
    rows equal in id, source and text any may be the one repeated. Null ids, null sources and repeated rows are rows
    like others; rows without words never stay. Reruns agree.
    """
    mixed = taken_words(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **mixing)
    u = (F.pmod(F.xxhash64(F.lit(seed + 3), "h"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    rows = mixed.where("size > 0").select(F.col("doc_id").alias("id"), "key.none", "key.name", "shard", "h", "size", "taken", u.alias("u"))
    rows = rows.repartition("none", "name", "shard") \
        .sortWithinPartitions("none", "name", "shard", F.length(F.bin("size")).desc(), "h", "id", "size", "taken")
    kind = rows.select("id", "none", "name", "h", "size").schema.add("copies", "long")
    per = rows.mapInPandas(rounded_copies, kind).groupBy("id", "none", "name", "h", "size") \
        .agg(F.count("*").alias("alike"), F.sum("copies").alias("copies")).where("copies > 0")
    per = stage(per.select(F.col("id").alias("__id"), F.when(~F.col("none"), F.col("name")).alias("__source"), F.col("h").alias("__h"),
                           F.col("size").alias("__size"), F.expr("copies div alike").alias("__each"), F.expr("copies % alike").alias("__more")))
    texts = docs.select(F.struct("*").alias("__row"), *row_key(seed, id_col, text_col, source_col))
    same = (F.col("h") == F.col("__h")) & (F.col("size") == F.col("__size")) & F.col("doc_id").eqNullSafe(F.col("__id")) \
        & F.col("source").eqNullSafe(F.col("__source"))
    even = texts.join(per.where("__more = 0"), same).select("__row", F.col("__each").alias("__n"))
    # rows alike that share a number of copies which does not divide: the first of them get one more
    nth = F.row_number().over(Window.partitionBy("__h", "__size", "__id", "__source").orderBy("__h"))
    odd = texts.join(per.where("__more > 0"), same).select("__row", (F.col("__each") + (nth <= F.col("__more")).cast("int")).alias("__n"))
    return even.unionByName(odd).where("__n > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).select("__row.*")
