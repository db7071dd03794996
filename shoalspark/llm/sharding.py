"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys are inserted in the order of a content hash. A key goes to the first shard clockwise of its ring
position that is not full yet; capacities add up to the number of rows (``slack=0``), so row counts end at
most one apart. That sequential law is evaluated in parallel: a shard is full from one moment of the insertion
order on, so the few moments at which shards fill up decide every placement, and each moment is found from
counts by (hash bucket, arc of the ring) and one look into a single bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalspark.staging import stage

ORDER = ["prio", "doc_id", "size", "crc", "copy"]


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; shards x vnodes rows."""
    v = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"),
                                            F.expr(f"id div {shards}").alias("v"))
    rows = v.select(F.xxhash64(F.lit("node"), "shard", "v").alias("p"), "shard").collect()
    return sorted((r.p, r.shard) for r in rows)


def clockwise(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each arc (the gap before a virtual node) its shards in clockwise order of first appearance."""
    n, out = len(points), []
    for a in range(n):
        seen: list[int] = []
        for i in range(n):
            s = points[(a + i) % n][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        out.append(seen)
    return out


def arc_of(position: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first virtual node at or after ``position``, by binary search in a literal array."""
    ring, n = F.lit([p for p, _ in points]), len(points)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    below = F.aggregate(F.lit(steps), F.lit(0), lambda acc, step: F.when(
        F.get(ring, acc + step - 1) < position, acc + step).otherwise(acc))
    return (below % n).cast("int")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, points: list[tuple[int, int]], n_rows: int) -> DataFrame:
    """One staged row per document with arc, insertion order and bucket.

    Equal rows are combined before the shuffle and get numbers, so that each has an order of its own and
    a row repeated very often is spread over all buckets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("crc")).groupBy("doc_id", "size", "crc").agg(F.count("*").alias("n"))
    slices = keys.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(4096).cast("bigint"))))
    copies = slices.withColumn("copy", F.explode(F.sequence("s", F.least(F.col("s") + 4096, F.col("n")) - 1)))
    prio = F.xxhash64(F.lit("order"), "doc_id", "size", "crc", "copy")
    buckets = min(1024, max(256, n_rows // 100_000))
    placed = copies.select("doc_id", "size", "crc", "copy", prio.alias("prio"),
                           arc_of(F.xxhash64(F.lit("key"), "doc_id"), points).alias("arc"))
    width = (1 << 64) // buckets + 1
    bucket = F.expr(f"cast(floor((cast(prio as decimal(20,0)) + 9223372036854775808BD) / {width}BD) as int)")
    return stage(placed.withColumn("bucket", bucket).sortWithinPartitions("bucket"))


def fill_moments(rows: DataFrame, order: list[list[int]], capacity: list[int]) -> tuple[list[tuple], list[list[int]]]:
    """The insertion moments at which shards become full, and the target of every arc between them.

    Collects counts by (bucket, arc), whose number depends on parameters only, and at most one row per
    shard for each moment.
    """
    spread: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("bucket", "arc").count().collect():
        spread.setdefault(r.bucket, {})[r.arc] = r["count"]
    shards, moments, tables = len(capacity), [], []
    load, full = [0] * shards, {s for s in range(shards) if capacity[s] == 0}
    waiting = sorted(spread)
    rest, after = None, None
    while True:
        target = [next((s for s in arc if s not in full), -1) for arc in order]
        tables.append(target)
        found = None
        while waiting:
            counts = spread[waiting[0]] if rest is None else rest
            gain = [0] * shards
            for arc, n in counts.items():
                gain[target[arc]] += n
            filling = {s: capacity[s] - load[s] for s in range(shards)
                       if s not in full and gain[s] and load[s] + gain[s] >= capacity[s]}
            if filling and len(full) < shards - 1:
                found = waiting[0]
                break
            load = [x + g for x, g in zip(load, gain)]
            waiting.pop(0)
            rest = after = None
        if found is None:
            return moments, tables
        inside = rows.where(F.col("bucket") == found)
        if after is not None:
            inside = inside.where(later(after))
        aimed = inside.withColumn("t", F.get(F.lit(target), "arc"))
        rank = F.row_number().over(Window.partitionBy("t").orderBy(*ORDER))
        wanted = F.coalesce(*[F.when(F.col("t") == s, F.lit(k)) for s, k in filling.items()])
        hits = aimed.withColumn("rank", rank).where(F.col("rank") == wanted).orderBy(*ORDER).collect()
        moment = tuple(hits[0][c] for c in ORDER)
        # rows up to the moment are placed by the old table
        left = rows.where((F.col("bucket") == found) & later(moment)).groupBy("arc").count().collect()
        new_rest = {r.arc: r["count"] for r in left}
        for arc, n in counts.items():
            load[target[arc]] += n - new_rest.get(arc, 0)
        full |= {s for s in range(shards) if load[s] >= capacity[s]}
        rest, after = new_rest, moment
        moments.append(moment)


def later(moment: tuple) -> Column:
    """Whether a row comes after ``moment`` in the insertion order."""
    kinds = ["bigint", "bigint", "bigint", "bigint", "bigint"]
    return F.struct(*ORDER) > F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(moment, kinds, ORDER)])


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                  vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Place every row of ``docs`` in one of ``shards`` shards.

    Returns doc_id, size (UTF-8 bytes plus 1, so 1 for a null text), text_crc32 (0 for null), shard and slot,
    the gapless number of the row in its shard. With ``slack`` 0 capacities are the row count divided evenly,
    otherwise each shard takes up to (1 + slack) times the mean. Null ids share one ring position and overflow
    clockwise like any hot key; repeated rows are separate rows with one ring position. Empty input gives no rows.
    Other columns are ignored.
    """
    spark, n = docs.sparkSession, docs.count()
    points = ring_points(spark, shards, vnodes)
    rows = keyed_rows(docs, id_col, text_col, points, n)
    if slack:
        capacity = [max(1, -(-int(n * (1 + slack)) // shards))] * shards
    else:
        capacity = [n // shards + (s < n % shards) for s in range(shards)]
    moments, tables = fill_moments(rows, clockwise(points, shards), capacity)
    passed = sum((later(m).cast("int") for m in moments), F.lit(0))
    flat = F.lit([s for t in tables for s in t])
    placed = rows.withColumn("shard", F.get(flat, passed * len(points) + F.col("arc")).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "shard").count().select(
        "bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(*ORDER))
    ranked = placed.withColumn("inner", inner)
    # at most buckets x shards rows, both parameters
    return ranked.join(F.broadcast(starts), ["bucket", "shard"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("inner") - 1).alias("slot"))
