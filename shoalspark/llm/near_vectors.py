"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

A pair of unit vectors at the wanted cosine lies at distance d, so its projections on random directions differ by
a normal law of that width, and a query-centred window of 2d catches 95 of 100 of them; unrelated vectors are
caught about one time in three. The number of windows a pair shares over many projections separates the two:
the count a pair must reach is the binomial quantile that loses one linked pair in a million. Because one
sorted projection leaves a third of all pairs in its windows, pairs are not read off single sorted lists:
tables sort the vectors by several projections jointly (cells of width 4d), as many projections as it takes to
leave some fifty vectors in a cell, and as many tables as the wanted recall needs. Pairs that meet in a cell are
counted over all projections and verified in double precision. The vectors that linked pairs connect then
meet once more, all pairs among them, for the exact number of links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.pairs import blocked, components, linked, pair_lists, verified, whole_groups
from shoalspark.staging import stage

PROJECTIONS, PER_STEP = 64, 16


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_cell(ratio: float) -> float:
    """Chance that two values whose difference is normal with width 1 share a cell of width ``ratio``."""
    return 1 - 2 * normal_cdf(-ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def layout(n: int, cosine: float, miss: float, per_cell: int = 50) -> tuple[int, int, float]:
    """(projections of a table, tables, cell width): selectivity from the number of vectors, tables from the recall."""
    d = math.sqrt(2 - 2 * cosine)
    near, far = same_cell(4.0), same_cell(4.0 * d / math.sqrt(2))
    t = max(3, round(math.log(max(n, 2) / per_cell) / -math.log(far)))
    return t, math.ceil(math.log(miss) / math.log1p(-near ** t)), 4 * d


def least_collisions(miss: float) -> list[int]:
    """Collisions a pair needs after 16, 32, ... windows, so that a linked pair fails with chance ``miss`` at most."""
    p, out = 2 * normal_cdf(2.0) - 1, []
    for n in range(PER_STEP, PROJECTIONS + 1, PER_STEP):
        below, c = 0.0, 0
        while True:
            below += math.comb(n, c) * p ** c * (1 - p) ** (n - c)
            if below > miss:
                break
            c += 1
        out.append(c)
    return out


def directions(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def unit_rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column])


def cells(t: int, tables: int, width: float, seed: int):
    shift = np.random.default_rng(seed).uniform(0, width, t * tables)

    def run(batches):
        for pdf in batches:
            out_node, out_unit, out_keys = [], [], []
            for dims, own in pdf.groupby(pdf["vec"].str.len(), sort=False):
                x = np.stack(own["vec"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                bins = np.floor((x @ directions(dims, t * tables, seed) + shift) / width).astype(np.int64).astype(np.uint64)
                keys = np.zeros((len(x), tables), np.uint64)
                for k in range(t):
                    keys = (keys ^ bins.reshape(len(x), tables, t)[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                keys = (keys + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(dims)) * np.uint64(0x94D049BB133111EB)
                out_node.extend(own["node"])
                out_unit.extend(r.tobytes() for r in x)
                out_keys.extend(keys.astype(np.int64))
            yield pd.DataFrame({"node": out_node, "unit": out_unit, "keys": out_keys})
    return run


def colliding(proj: np.ndarray, a: np.ndarray, b: np.ndarray, window: float, least: list[int]):
    """Pairs that reach the least count of window collisions after every step."""
    count = np.zeros(len(a), np.int64)
    for step, need in enumerate(least):
        part = proj[:, step * PER_STEP:(step + 1) * PER_STEP]
        count += (np.abs(part[a] - part[b]) <= window).sum(axis=1)
        keep = count >= need
        a, b, count = a[keep], b[keep], count[keep]
    return a, b


def linker(cosine: float, miss: float, seed: int):
    window, least = 2 * math.sqrt(2 - 2 * cosine), least_collisions(miss)

    def links(unit: np.ndarray, proj: np.ndarray, a, b):
        a, b = colliding(proj, a, b, window, least)
        near = (unit[a] * unit[b]).sum(axis=1) >= cosine
        return a[near], b[near]

    def projected(unit: np.ndarray) -> np.ndarray:
        return unit @ directions(unit.shape[1], PROJECTIONS, seed + 1)
    return links, projected


def by_dims(pdf: pd.DataFrame):
    """Row numbers by vector length; vectors of different lengths never meet."""
    size = pdf["unit"].str.len().to_numpy()
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def cell_edges(cosine: float, miss: float, seed: int):
    keys = ["key", "i", "j"]
    links, projected = linker(cosine, miss, seed)

    def run(batches):
        for whole in whole_groups(batches, keys):
            for own in by_dims(whole):
                pdf = whole.iloc[own].reset_index(drop=True)
                unit = unit_rows(pdf["unit"])
                proj, root, node = projected(unit), np.arange(len(pdf)), pdf["node"].to_numpy()
                for a, b in pair_lists(pdf, keys):
                    root = linked(root, *links(unit, proj, a, b))
                moved = np.flatnonzero(root != np.arange(len(pdf)))
                if len(moved):
                    yield pd.DataFrame({"a": node[moved], "b": node[root[moved]]}).drop_duplicates()
    return run


def group_links(cosine: float, miss: float, seed: int):
    links, projected = linker(cosine, miss, seed)

    def run(pdf, a, b):
        rows = np.unique(np.concatenate([a, b]))  # a group has vectors of one length, but the list may hold several groups
        at = np.zeros(len(pdf), np.int64)
        out = []
        size = pdf["unit"].str.len().to_numpy()
        for s in np.unique(size[rows]):
            own = rows[size[rows] == s]
            unit = unit_rows(pdf["unit"].iloc[own])
            at[own] = np.arange(len(own))
            mine = size[a] == s
            x, y = links(unit, projected(unit), at[a[mine]], at[b[mine]])
            out.append(np.stack([own[x], own[y]]))
        return tuple(np.concatenate(out, axis=1)) if out else (a[:0], b[:0])
    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 miss: float = 1e-4, seed: int = 11) -> DataFrame:
    """Links of cosine >= ``cosine`` among all vectors, and the components they form.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (smallest id
    reachable over links, itself included) and kept (vec_id = component_id). ``miss`` is the share of linked
    pairs at the threshold that no table brings together; closer pairs are lost far less often. A vector that is
    null, empty, zero or holds a null or non-finite component links with nothing, nor do vectors of different
    lengths. Equal vectors are compared once and count as links of each other. A null id orders last and comes
    back null. An empty table gives no rows. Other columns are ignored.
    """
    last = (1 << 63) - 1
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    rows = table.select(F.coalesce(F.col(id_col), F.lit(last)).alias("id"), v.alias("vec"))
    rows = rows.withColumn("valid", F.coalesce(~bad & some, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("valid"), F.xxhash64("vec")))
    light = rows.select("id", "valid", "node")
    classes = stage(rows.where("valid").groupBy("node").agg(
        F.min("id").alias("low"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    t, tables, width = layout(classes.count(), cosine, miss)
    placed = stage(classes.select("node", "vec").mapInPandas(
        cells(t, tables, width, seed), "node bigint, unit binary, keys array<bigint>"))
    banded = placed.select("node", F.explode("keys").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    meeting = banded.join(crowded, "key").join(placed.select("node", "unit"), "node")
    dealt = blocked(meeting, "key", "size", "node").select("key", "i", "j", "mine", "node", "unit")
    near = components(dealt.mapInPandas(cell_edges(cosine, miss / 100, seed), "a bigint, b bigint"))

    members = near.withColumnRenamed("root", "group").join(classes.select("node", "weight"), "node") \
        .join(placed.select("node", "unit"), "node")
    found = verified(stage(members), ["unit"], group_links(cosine, miss / 100, seed))
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    lows = near.join(classes.select("node", "low"), "node")
    ids = lows.groupBy("root").agg(F.min("low").alias("component"))
    judged = near.join(ids, "root").join(links, "node", "left").select("node", "component", "links")
    per_class = classes.select("node", "low", "weight").join(judged, "node", "left")
    back = light.join(per_class, "node", "left")
    component = F.coalesce("component", "low", "id")

    def shown(c):
        return F.when(c != last, c)

    return back.select(shown(F.col("id")).alias("vec_id"),
                       F.when(F.col("valid"), F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
                       shown(component).alias("component_id"), (F.col("id") == component).alias("kept"))
