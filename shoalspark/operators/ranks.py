"""Exact ranks and quantiles that never put a large group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.functions.pvalues import normal_quantile
from shoalspark.staging import small_side, stage


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe join condition between two aliases."""
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys],
                  F.lit(True))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None,
                sums: Mapping[str, Column] | None = None, weight: str | None = None,
                range_rows: int = 1_000_000) -> DataFrame:
    """One row per (keys, distinct value): ``n`` copies, ``before`` smaller rows, ``total`` rows.

    Copies (or ``weight``) are combined before the shuffle and the combined table is staged. Each key's values
    are then cut into value ranges at approximate quantiles, as many as keep the largest key at about
    ``range_rows`` values per range; ranks are counted inside a range and shifted by the size of the lower
    ranges. The cuts decide only where the work runs, the ranks are exact.
    """
    keys = list(keys)
    extra = [c.alias(name) for name, c in (sums or {}).items()]
    n = F.sum(weight) if weight else F.count("*")
    counts = stage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"), *extra))
    if buckets is None:
        per = counts.groupBy(*keys).agg(F.count("*").alias("__d")) if keys else counts.agg(F.count("*").alias("__d"))
        largest = per.agg(F.max("__d")).first()[0] or 0
        buckets = min(8192, max(8, -(-largest // range_rows)))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, max(10_000, 20 * buckets)).alias("__cuts"))
    placed = counts.alias("a").join(small_side(cuts).alias("b"), same_keys("a", "b", keys), "left") if keys else \
        counts.alias("a").withColumn("__cuts", stage(cuts).scalar())
    bucket = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    placed = placed.withColumn("__bucket", bucket).select("a.*", "__bucket") if keys else \
        placed.withColumn("__bucket", bucket).drop("__cuts")

    sizes = placed.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__size"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = per_key.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__bucket",
                           F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__offset"),
                           F.sum("__size").over(per_key).alias("total"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = local.alias("a").join(offsets.alias("b"), same_keys("a", "b", [*keys, "__bucket"]))
    return joined.select(*[f"a.{k}" for k in keys], f"a.{value}", "a.n",
                         (F.col("__local") + F.col("__offset")).alias("before"), "b.total",
                         *[f"a.{name}" for name in (sums or {})])


def average_rank() -> Column:
    """Average rank of a ``value_ranks`` row."""
    return F.col("before") + (F.col("n") + 1) / F.lit(2.0)


def narrow_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of groups that are small by construction, such as one entity's second."""
    rows = df.select(*keys, F.col(value).cast("double").alias(value))
    return rows.groupBy(*keys).agg(F.percentile(value, [float(p) for p in probs]).alias("quantiles"))


def _slot(v: Column, lo: Column, hi: Column, slots: int) -> Column:
    """Which of ``slots`` equal parts of [lo, hi] holds ``v``, from 1; infinite ends stand for very large ones."""
    v, lo, hi = (F.greatest(F.lit(-8e307), F.least(F.lit(8e307), c)) for c in (v, lo, hi))
    part = F.try_divide(v - lo, hi - lo)
    inside = F.least(F.lit(slots), F.floor(part * slots).cast("int") + 1)
    return F.when(part.isNull() | F.isnan(part), F.lit(1)).otherwise(inside)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], slots: int = 4096,
                    slot_values: int = 1_000_000) -> DataFrame:
    """Exact interpolated quantiles by key as the array ``quantiles`` (null for an empty group).

    Two passes over the rows, whatever the group sizes. The first takes each key's count with a mergeable
    sketch, which brackets every wanted order statistic. The second counts the rows below each bracket and the
    copies of each value inside it, both combined before the shuffle. A histogram of ``slots`` equal parts of a bracket names
    the parts that hold the wanted ranks; parts of more than ``slot_values`` distinct values are divided again, and only
    the values of the last parts are sorted.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    if not keys:
        keyed = rows.select(F.lit(0).alias("__all"), F.col("__v").alias(value))
        return group_quantiles(keyed, ["__all"], value, probs, slots, slot_values).drop("__all")
    probs = [float(p) for p in probs]
    accuracy = 10_000
    # the sketch is off by at most n / accuracy ranks, and both neighbours must lie inside
    slack = 4.0 / accuracy
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    k = len(probs)
    sketch = stage(rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", low + high, accuracy).alias("__q")))
    # a small group is bracketed whole: one rank may be more than the slack
    whole = F.col("__n") <= accuracy
    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.when(whole | F.lit(low[i] == 0.0), F.col("__min")).otherwise(F.col("__q")[i]).alias("lo"),
                 F.when(whole | F.lit(high[i] == 1.0), F.col("__max")).otherwise(F.col("__q")[k + i]).alias("hi"))
        for i in range(k)])
    bounds = small_side(sketch.select(*keys, "__n", brackets.alias("__b")))
    v, group = F.col("__v"), [*keys, "__i", "__before"]
    tagged = rows.alias("r").join(bounds.alias("s"), same_keys("r", "s", keys)).where(v.isNotNull()) \
        .select(*[f"r.{c}" for c in keys], "__n", v, F.explode(F.filter("__b", lambda b: v <= b["hi"])).alias("b"))
    within = v >= F.col("b.lo")
    tagged = tagged.select(*keys, "__n", F.col("b.i").alias("__i"), F.lit(0).cast("bigint").alias("__before"), F.when(within, v).alias("__v"),
                           F.when(within, _slot(v, F.col("b.lo"), F.col("b.hi"), slots)).otherwise(F.lit(0)).alias("__slot"))
    counted = stage(tagged.groupBy(*group, "__n", "__slot", "__v").agg(F.count("*").alias("__copies")))

    h = (F.col("__n") - 1) * F.array(*[F.lit(p) for p in probs])[F.col("__i")] + 1
    lo_rank, hi_rank = F.floor(h), F.least(F.floor(h) + 1, F.col("__n"))
    upto = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # at most slots + 1 rows
    most = None
    while True:
        sizes = counted.groupBy(*group, "__n", "__slot").agg(F.sum("__copies").alias("__size"), F.count("*").alias("__d"),
                                                             F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        placed = sizes.withColumn("__offset", F.col("__before") + F.coalesce(F.sum("__size").over(upto), F.lit(0)))
        wanted = lo_rank.between(F.col("__offset") + 1, F.col("__offset") + F.col("__size")) \
            | hi_rank.between(F.col("__offset") + 1, F.col("__offset") + F.col("__size"))
        chosen = stage(placed.where(wanted & (F.col("__slot") > 0)).select(*group, "__slot", "__offset", "__lo", "__hi", "__d"))
        before, most = most, chosen.agg(F.max("__d")).first()[0] or 0
        left = counted.alias("a").join(chosen.alias("b"), same_keys("a", "b", [*group, "__slot"])) \
            .select(*[f"a.{c}" for c in keys], "a.__i", "a.__n", "a.__v", "a.__copies", F.col("b.__offset").alias("__before"), "b.__lo", "b.__hi")
        if most <= slot_values or most == before:  # the same again: values beyond what a division can tell apart
            break
        counted = stage(left.withColumn("__slot", _slot(v, F.col("__lo"), F.col("__hi"), slots)).drop("__lo", "__hi"))

    running = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = left.withColumn("__last", F.col("__before") + F.sum("__copies").over(running))
    first = F.col("__last") - F.col("__copies") + 1
    per = ranked.groupBy(*keys, "__i", "__n").agg(F.max(F.when(lo_rank.between(first, F.col("__last")), v)).alias("lo"),
                                                  F.max(F.when(hi_rank.between(first, F.col("__last")), v)).alias("hi"))
    w = h - F.floor(h)
    q = F.when(w == 0, F.col("lo")).otherwise(F.col("lo") + w * (F.col("hi") - F.col("lo")))
    per = per.where(F.col("lo").isNotNull() & ((w == 0) | F.col("hi").isNotNull()))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", q.alias("q")))).alias("p"))
    found = packed.select(*keys, F.transform("p", lambda s: s["q"]).alias("quantiles"))
    lost = (F.col("__n") > 0) & (F.coalesce(F.size("quantiles"), F.lit(0)) != k)
    whole_answer = F.when(lost, F.raise_error("order statistic outside its bracket").cast("array<double>")).otherwise(F.col("quantiles"))
    return sketch.select(*keys, "__n").alias("k").join(found.alias("f"), same_keys("k", "f", keys), "left") \
        .select(*[f"k.{c}" for c in keys], whole_answer.alias("quantiles"))


def expanded(ranked: DataFrame, keys: Sequence[str], value: str, slice_rows: int = 65_536) -> DataFrame:
    """``value_ranks`` rows with one row per position ``__i``; long runs of a value are spread in slices."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(slice_rows).cast("bigint")))
    slices = ranked.withColumn("__s", start).repartition(*keys, value, "__s")
    stop = F.least(F.col("__s") + slice_rows, F.col("n")) - 1
    return slices.withColumn("__i", F.explode(F.sequence("__s", stop))) \
        .withColumn("__i", F.col("__i") + F.col("before") + 1)


def qq_points(df: DataFrame, value: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Sample against standard normal quantiles, one point per row.

    Plotting positions follow the usual ``(i - a) / (n + 1 - 2a)`` with a = 3/8 up to ten rows,
    else 1/2. Runs of equal values are expanded in slices, so a value with very many copies is
    spread over tasks.
    """
    points = expanded(value_ranks(df, keys, value, buckets), keys, value)
    a = F.when(F.col("total") <= 10, 0.375).otherwise(0.5)
    p = (F.col("__i") - a) / (F.col("total") + 1 - 2 * a)
    return points.select(*keys, F.col("__i").alias("rank"), normal_quantile(p).alias("theoretical"),
                         F.col(value).alias("sample"))
