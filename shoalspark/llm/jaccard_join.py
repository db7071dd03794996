"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents of equal words form a class; one document of a class is compared. Signatures hold one byte of each of
120 MinHash values. Pairs that agree in one of 24 bands of five values are compared a few values at a time and
dropped as soon as the posterior probability that their similarity reaches the threshold falls below a
tolerance. Survivors only decide which classes meet again: inside the components they span, every pair is pruned
the same way and the rest is verified on the shingles themselves.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.pairs import blocked, components, linked, pair_lists, verified, whole_groups
from shoalspark.staging import small_side, stage

WIDTH = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
STEP = 20


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``width`` words; a shorter text is one run, a text without words has none."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)]))


def multipliers(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), \
        rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = mixed(h + w[i:i + n])
    return np.unique(h)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """One byte of the smallest value under each hash function."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[lo:lo + 2048, None] * a + b).min(axis=0))
    return (mixed(low) >> np.uint64(13)).astype(np.uint8).tobytes()


def signed_rows(batches):
    a, b = multipliers()
    for pdf in batches:
        out = []
        for doc, th, text in zip(pdf["doc"], pdf["th"], pdf["text"]):
            words = words_of(text)
            if words:
                digest = hashlib.md5(b" ".join(words)).digest()
                out.append((doc, th, digest, True, signature(shingle_hashes(words), a, b)))
            else:
                out.append((doc, th, hashlib.md5(b"\n%d" % doc).digest(), False, b""))
        yield pd.DataFrame(out, columns=["doc", "th", "digest", "any", "sig"])


@functools.cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values, the least matches at which P(similarity >= threshold) is at least ``tolerance``.

    A byte of two different MinHash values agrees in one of 256 cases, so matches come with probability
    s + (1 - s) / 256; the prior of s is uniform.
    """
    s = np.linspace(0, 1, 20_001)
    r = s + (1 - s) / 256
    least = np.zeros(HASHES + 1, np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                log = m * np.log(r) + np.where(n > m, (n - m) * np.log1p(-r), 0.0)
            density = np.exp(log - log.max())
            if density[s >= threshold].sum() >= tolerance * density.sum():
                least[n] = m
                break
    return least


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step drops."""
    same = np.zeros(len(a), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        same += (sig[a, n - STEP:n] == sig[b, n - STEP:n]).sum(axis=1)
        keep = same >= least[n]
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES)


def candidate_edges(threshold: float, tolerance: float):
    keys = ["key", "i", "j"]

    def run(batches):
        least = least_matches(threshold, tolerance)
        for pdf in whole_groups(batches, keys):
            sig, root = signatures(pdf["sig"]), np.arange(len(pdf))
            for a, b in pair_lists(pdf, keys):
                root = linked(root, *pruned(sig, a, b, least))
            moved = np.flatnonzero(root != np.arange(len(pdf)))
            if len(moved):
                node = pdf["node"].to_numpy()
                yield pd.DataFrame({"a": node[moved], "b": node[root[moved]]}).drop_duplicates()
    return run


def exact_links(threshold: float, tolerance: float, width: int):
    milli = round(threshold * 1000)

    def overlap(sets, a, b):
        """Sizes of the intersections of pairs of shingle sets."""
        rows = np.unique(np.concatenate([a, b]))
        if len(a) <= 4 * len(rows):
            return np.fromiter((len(sets[x] & sets[y]) for x, y in zip(a, b)), np.int64, len(a))
        # many pairs of few texts: products of incidence matrices, counted in slices of the shingles
        number: dict[tuple, int] = {}
        ids = [np.fromiter((number.setdefault(s, len(number)) for s in sets[r]), np.int64, len(sets[r])) for r in rows]
        uses = np.bincount(np.concatenate(ids), minlength=len(number))
        new = np.where(uses > 1, np.cumsum(uses > 1) - 1, -1)
        ids = [x[x >= 0] for x in (new[y] for y in ids)]
        total, out = int((uses > 1).sum()), np.zeros((len(rows), len(rows)), np.float32)
        for lo in range(0, total, 4096):
            part = np.zeros((len(rows), min(4096, total - lo)), np.float32)
            for r, x in enumerate(ids):
                part[r, x[(x >= lo) & (x < lo + 4096)] - lo] = 1
            out += part @ part.T
        at = {r: k for k, r in enumerate(rows)}
        ka, kb = np.array([at[x] for x in a]), np.array([at[x] for x in b])
        return out[ka, kb].astype(np.int64)

    def links(pdf, a, b):
        a, b = pruned(signatures(pdf["sig"]), a, b, least_matches(threshold, tolerance))
        if not len(a):
            return a, b
        both, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        group = pdf["group"].to_numpy()[a]
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            # sets of one block at a time, at most two chunks of texts
            sets = {r: shingles(words_of(pdf["text"].iat[r]), width) for r in np.unique(np.concatenate([a[part], b[part]]))}
            both[part] = overlap(sets, a[part], b[part])
            size = {r: len(x) for r, x in sets.items()}
            union[part] = [size[x] + size[y] for x, y in zip(a[part], b[part])]
        union -= both
        keep = both * 1000 >= milli * union
        return a[keep], b[keep]
    return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                   tolerance: float = 1e-5) -> DataFrame:
    """Classes and near-duplicate groups of ``docs`` by Jaccard similarity of five-word shingles.

    Returns one row per input row: doc_id, class_id (smallest id with the same words), n_links (other rows of
    similarity >= threshold, copies included), group_id (smallest id reachable over links), kept (whether
    this is the row of its group that stays) and text_hash. Words are runs of anything but ASCII space; a text of one to four
    words is one shingle; a null text or one without words links with nothing. A null id is a row like any
    other, orders last, and comes back null. Repeated rows are copies of each other and all marked
    alike; ``one_of_each`` keeps one of them. An empty table gives no rows. Other columns are ignored.
    """
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(last)).alias("doc"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    signed = stage(rows.mapInPandas(signed_rows, "doc bigint, th bigint, digest binary, any boolean, sig binary"))
    classes = stage(signed.groupBy("digest").agg(F.min(F.struct("doc", "th")).alias("low"), F.count("*").alias("weight"), F.first("any").alias("any"))
                    .select("digest", F.xxhash64("digest").alias("node"), F.col("low.doc").alias("doc"), F.col("low.th").alias("th"), "weight", "any"))
    reps = stage(classes.where("any").join(signed.select("digest", "doc", "th", "sig"), ["digest", "doc", "th"])
                 .dropDuplicates(["digest"]).select("node", "doc", "th", "weight", "sig"))

    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * ROWS, ROWS)) for b in range(BANDS)])
    banded = reps.select("node", F.explode(bands).alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    meeting = banded.join(crowded, "key").join(reps.select("node", "sig"), "node")
    dealt = blocked(meeting, "key", "size", "node").select("key", "i", "j", "mine", "node", "sig")
    edges = dealt.mapInPandas(candidate_edges(threshold, tolerance), "a bigint, b bigint")
    near = components(edges)

    members = stage(near.withColumnRenamed("root", "group").join(reps, "node"))
    # up to a million members are broadcast, so texts without a partner are not shuffled
    wanted = small_side(members.select("doc", "th"), 1_000_000)
    texts = rows.join(wanted, ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.first("text").alias("text"))
    found = stage(verified(members.join(texts, ["doc", "th"]), ["sig", "text"], exact_links(threshold, tolerance, WIDTH)))
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lows = groups.join(classes.select("node", F.struct("doc", "th").alias("low")), "node")
    judged = lows.groupBy("root").agg(F.min("low").alias("group")).join(groups, "root").join(links, "node").select("node", "group", "links")
    per_class = classes.select("digest", "node", F.struct("doc", "th").alias("low"), "weight").join(judged, "node", "left")
    back = signed.select("doc", "th", "digest").join(per_class, "digest").withColumn("group", F.coalesce("group", "low"))

    def shown(c):
        return F.when(c != last, c)

    return back.select(shown(F.col("doc")).alias("doc_id"), shown(F.col("low.doc")).alias("class_id"),
                       (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), shown(F.col("group.doc")).alias("group_id"),
                       (F.struct("doc", "th") == F.col("group")).alias("kept"), F.col("th").alias("text_hash"))


def one_of_each(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judged`` does not keep; of rows equal in id and text one stays."""
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("__id"), th.alias("__th"), F.struct("*").alias("__row"))
    kept = judged.where("kept").select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__kept_th")).distinct()
    stay = rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__th") == F.col("__kept_th")), "left_semi")
    return stay.groupBy("__id", "__th").agg(F.first("__row").alias("__row")).select("__row.*")
