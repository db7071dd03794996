"""Pair work in bounded blocks, and connected components.

Groups of any size are cut in chunks; a task sees two chunks at a time, so the largest task does not grow with
the group. Blocks give back counts and a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.staging import stage

CHUNK = 512


def blocked(rows: DataFrame, group: str, size: str, node: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with columns i, j, mine: each row goes to every pair of chunks (i <= j) of its group it belongs to.

    Rows of a block are adjacent in one partition. ``size`` is the number of rows of the group.
    """
    n = F.expr(f"cast((`{size}` + {chunk - 1}) div {chunk} as int)")
    mine = F.pmod(F.xxhash64(F.lit("chunk"), node), n).cast("int")
    dealt = rows.withColumn("__n", n).withColumn("mine", mine) \
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "__o")).withColumn("j", F.greatest("mine", "__o")).drop("__n", "__o")
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole runs of equal keys, from sorted batches."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        same = (k == k[-1]).all(axis=1)
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        rest = pdf.iloc[cut:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def pair_lists(pdf: pd.DataFrame, keys: list[str], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of every block: inside one chunk, or across two. At most about ``most`` at a time."""
    k = pdf[keys].to_numpy()
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(pdf)])
    one = (pdf["i"] == pdf["j"]).to_numpy()[starts]
    mine, i = pdf["mine"].to_numpy(), pdf["i"].to_numpy()
    for s in np.unique(sizes[one & (sizes > 1)]):
        a, b = np.triu_indices(s, 1)
        at = starts[one & (sizes == s)]
        step = max(1, most // len(a))
        for lo in range(0, len(at), step):
            base = at[lo:lo + step, None]
            yield (base + a).ravel(), (base + b).ravel()
    for start, size in zip(starts[~one], sizes[~one]):
        own = np.arange(start, start + size)
        left, right = own[mine[own] == i[own]], own[mine[own] != i[own]]
        for lo in range(0, len(left), max(1, most // max(1, len(right)))):
            part = left[lo:lo + max(1, most // max(1, len(right)))]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (smallest row number reachable from each row) after the links between ``a`` and ``b`` are added."""
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b): root is the smallest node reachable.

    Alternates the two star steps: neighbours are hung on the smallest one seen, first the larger, then the
    smaller ones. The smallest neighbour is a combined aggregate and the way back a join, which adaptive
    execution splits for a node with very many neighbours. Each round is staged; it ends when nothing moves.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current, before = stage(ends.distinct()), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # staged, so that the join has an exchange of its own on either side and a hot node can be split
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        small = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verified(members: DataFrame, payload: list[str], links: Callable[[pd.DataFrame, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links inside every group of ``members`` (group, node, weight, payload): (node, n_links, root) per block.

    ``links(rows, a, b)`` returns the pairs of row numbers that are linked. n_links adds the weights of linked
    rows; root is a node joined to this one by links of the block.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("__size"))
    rows = blocked(members.join(sizes, "group"), "group", "__size", "node") \
        .select("group", "i", "j", "mine", "node", "weight", *payload)
    keys = ["group", "i", "j"]

    def run(batches):
        for pdf in whole_groups(batches, keys):
            n = len(pdf)
            root = np.arange(n)
            weight, node = pdf["weight"].to_numpy(), pdf["node"].to_numpy()
            count = np.zeros(n, np.int64)
            for a, b in pair_lists(pdf, keys):
                a, b = links(pdf, a, b)
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                root = linked(root, a, b)
            hit = count > 0
            if hit.any():
                yield pd.DataFrame({"node": node[hit], "n_links": count[hit], "root": node[root[hit]]})
    return rows.mapInPandas(run, "node bigint, n_links bigint, root bigint")
