"""Repeated passages removed from all but their first document, located by Aho-Corasick automata.

Every window of ``width`` words contains one gram that is smallest by hash; consecutive windows mostly share it and
form a run. Runs of different documents that share gram and words are the same windows, so passages are
confirmed as recurring from one row per run (about one for 22 words). Only where a gram occurs in different
runs, at the ends of shared passages, are single windows compared, once per distinct run. This tells for every
document which earlier documents hold its windows first. Those earlier documents are the dictionary: the
texts of one holder, cut in blocks of half a window, are compiled to an automaton, and the documents that repeat
it stream through. A block found is compared with its surroundings in the holder, and stretches of a whole window or
more are covered. Every shared window contains a block, so none is missed, and only equal words are ever removed.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.staging import small_side, stage

GRAM = 8
#: rows a task holds before it hands them over
ROWS_OUT = 100_000
#: places of a block compared at once
PLACES = 8192
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 2^bits of them."""
    up = np.full(1 << bits, _BASE, np.uint64)
    down = np.full(1 << bits, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Runs:
    """Runs of windows of one text: hash of the smallest gram, hash of the run's words, first and last window."""

    def __init__(self, words: list[bytes], width: int):
        n = len(words)
        self.windows = max(0, n - width + 1)
        if not self.windows:
            return
        up, down = powers(max(10, n.bit_length()))
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:n], dtype=np.uint64)])
        self.down, self.width = down, width
        grams = self.hashes(np.arange(n - GRAM + 1), GRAM)
        per = width - GRAM + 1
        at = np.arange(self.windows) + np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1)
        self.first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.last = np.r_[self.first[1:] - 1, self.windows - 1]
        self.gram = grams[at[self.first]]
        length = self.last - self.first + width
        where = (at[self.first] - self.first).astype(np.uint64)
        self.run = spread(self.hashes(self.first, length) + np.uint64(3) * length.astype(np.uint64) + (where << np.uint64(40)))

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        return spread((self.sums[start + length] - self.sums[start]) * self.down[start])

    def of_run(self, k: int) -> np.ndarray:
        return self.hashes(np.arange(self.first[k], self.last[k] + 1), self.width)


def run_rows(width: int):
    def run(batches):
        for pdf in batches:
            found, held = [], 0
            for doc, text in zip(pdf["doc"], pdf["text"]):
                r = Runs(words_of(text), width)
                if r.windows:
                    found.append((doc, r.gram, r.run))
                    held += len(r.gram)
                if held >= ROWS_OUT:
                    yield hash_rows(found, ["gram", "run"])
                    found, held = [], 0
            if found:
                yield hash_rows(found, ["gram", "run"])
    return run


def hash_rows(found: list, names: list[str]) -> pd.DataFrame:
    """One row per distinct (doc, hashes) of ``found``, a list of (doc, array of hashes, ...)."""
    doc = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
    hashes = {name: np.concatenate([x[k] for x in found]).astype(np.int64) for k, name in enumerate(names, start=1)}
    return pd.DataFrame({"doc": doc, **hashes}).drop_duplicates()


def window_rows(width: int):
    """Windows of the runs named in ``runs``."""
    def run(batches):
        for pdf in batches:
            found, held = [], 0
            for doc, text, wanted in zip(pdf["doc"], pdf["text"], pdf["runs"]):
                r = Runs(words_of(text), width)
                if r.windows:
                    for k in np.flatnonzero(np.isin(r.run.astype(np.int64), np.asarray(wanted))):
                        found.append((doc, r.of_run(k)))
                        held += len(found[-1][1])
                if held >= ROWS_OUT:
                    yield hash_rows(found, ["window"])
                    found, held = [], 0
            if found:
                yield hash_rows(found, ["window"])
    return run


class Passages:
    """Automaton over the blocks of one holder's texts.

    A window holds a whole block of its text, the first of which starts fewer than a block's words after the window. So a block
    found needs no more than its surroundings, from a block before it to a window after its start, to tell which windows
    around it are shared. Blocks of equal surroundings, as a repetitive text has them, are kept once, and the places
    of a block in a document are compared together: time is linear in the document for each surrounding.
    """

    def __init__(self, width: int):
        self.width, self.block = width, width // 2
        self.number: dict[bytes, int] = {}
        self.blocks: dict[str, dict[bytes, None]] = {}
        self.automaton = None

    def add(self, words: list[bytes]) -> None:
        ids = np.fromiter((self.number.setdefault(x, len(self.number)) for x in words), np.int32, len(words))
        around = np.concatenate([np.full(self.block - 1, -2, np.int32), ids, np.full(self.width, -2, np.int32)])
        for at in range(0, len(words) - self.block + 1, self.block):
            key = b" " + b" ".join(words[at:at + self.block]) + b" "
            self.blocks.setdefault(key.decode("latin-1"), {})[around[at:at + self.block - 1 + self.width].tobytes()] = None

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window of the holder."""
        n, before = len(words), self.block - 1
        if not self.blocks or n < self.width:
            return np.zeros(n, bool)
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for k, key in enumerate(self.blocks):
                self.automaton.add_word(key, (k, len(key)))
            self.automaton.make_automaton()
            self.around = [np.stack([np.frombuffer(x, np.int32) for x in found]) for found in self.blocks.values()]
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = np.fromiter(((k, end - size + 1) for end, (k, size) in self.automaton.iter(line)), np.dtype((np.int64, 2)))
        if not len(hits):
            return np.zeros(n, bool)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)])
        hits[:, 1] = np.searchsorted(starts, hits[:, 1])
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
        get = self.number.get
        ids = np.fromiter((get(x, -1) for x in words), np.int32, n)
        views = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([np.full(before, -1, np.int32), ids, np.full(self.width, -1, np.int32)]), before + self.width)
        edges = np.zeros(n + 1, np.int64)
        for part in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1):
            for lo in range(0, len(part), PLACES):
                at = part[lo:lo + PLACES, 1]
                here = views[at]
                for own in self.around[part[0, 0]]:
                    differs = here != own
                    left = np.where(differs[:, :before].any(axis=1), differs[:, :before][:, ::-1].argmax(axis=1), before)
                    right = np.where(differs[:, before:].any(axis=1), differs[:, before:].argmax(axis=1), self.width)
                    whole = left + right >= self.width
                    np.add.at(edges, at[whole] - left[whole], 1)
                    np.add.at(edges, at[whole] + right[whole], -1)
        return np.cumsum(edges[:n]) > 0


def located(width: int):
    """Streams groups (holder, part): the holder's texts first, then the documents that repeat it."""
    def run(batches):
        key, passages = None, None
        for pdf in batches:
            out = []
            for holder, part, role, doc, th, text in zip(pdf["holder"], pdf["part"], pdf["role"], pdf["doc"], pdf["th"], pdf["text"]):
                if key != (holder, part):
                    key, passages = (holder, part), Passages(width)
                words = words_of(text)
                if role == 0:
                    passages.add(words)
                    continue
                c = np.concatenate([[False], passages.covered(words), [False]])
                edge = np.flatnonzero(c[1:] != c[:-1])
                if len(edge):
                    out.append((doc, th, edge.tolist()))
            yield pd.DataFrame(out, columns=["doc", "th", "edges"])
    return run


def without_passages(batches):
    for pdf in batches:
        kept, total, removed = [], [], []
        for text, edges in zip(pdf["text"], pdf["edges"]):
            words = words_of(text)
            n = len(words)
            if edges is not None and len(edges):
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, np.asarray(edges)[::2], 1)
                np.add.at(gone, np.asarray(edges)[1::2], -1)
                stay = np.cumsum(gone[:n]) == 0
                words = [x for x, s in zip(words, stay) if s]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            total.append(n), removed.append(n - len(words))
        yield pd.DataFrame({"doc": pdf["doc"], "text": kept, "n_words": total, "n_removed": removed})


def few(df: DataFrame, array: str, most: int) -> DataFrame:
    """``df`` staged, with a broadcast hint if it has at most ``most`` rows and 20 array elements for each of them."""
    staged = stage(df)
    rows, elements = staged.agg(F.count("*"), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return F.broadcast(staged) if rows <= most and elements <= 20 * most else staged


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50,
                   part_docs: int = 256, broadcast_rows: int = 200_000) -> DataFrame:
    """Drop every word covered by a window of ``width`` words that also starts in a smaller document.

    Returns doc_id, text (kept words joined by one blank), n_words and n_removed for every row. Words are runs of
    anything but ASCII space; windows are judged on the input. A null or empty text has no words; repeats inside
    one document stay. A very long text costs time linear in its words, a repetitive one too. Rows that share an id are one document; null ids are one document that orders last.
    An empty table gives no rows. Other columns are ignored. Tables of up to ``broadcast_rows`` rows are broadcast
    so that texts without repeats are not shuffled; larger ones join by shuffle with the same result.
    """
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(id_col), last).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                       F.col(text_col).alias("text"))
    runs = stage(rows.select("doc", "text").mapInPandas(run_rows(width), "doc bigint, gram bigint, run bigint"))
    same = stage(runs.groupBy("gram", "run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    repeats = same.where("first <> last").select("gram", "run", "first")
    whole = runs.join(repeats, ["gram", "run"]).where("doc > first").select("doc", F.col("first").alias("holder"))

    ends = same.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high")) \
        .where("kinds > 1 and low <> high").select("gram")
    named = same.join(ends, "gram").groupBy(F.col("first").alias("doc")).agg(F.collect_set("run").alias("runs"))
    named = few(named, "runs", broadcast_rows)
    single = stage(rows.join(named, "doc").select("doc", "text", "runs").mapInPandas(window_rows(width), "doc bigint, window bigint"))
    first = stage(single.groupBy("window").agg(F.min("doc").alias("holder"), F.max("doc").alias("last"))
                  .where("holder <> last").select("window", "holder"))
    partial = single.join(first, "window").where("doc > holder").select("doc", "holder")
    pairs = stage(whole.unionByName(partial).distinct())

    counts = pairs.groupBy("holder").agg(F.expr(f"cast(1 + (count(*) - 1) div {part_docs} as int)").alias("parts"))
    counts = small_side(counts, broadcast_rows)
    dealt = pairs.join(counts, "holder").select("doc", "holder", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"))
    followers = rows.join(small_side(dealt, broadcast_rows), "doc") \
        .select("holder", "part", F.lit(1).alias("role"), "doc", "th", "text")
    holders = rows.join(counts.withColumnRenamed("holder", "doc"), "doc") \
        .select(F.col("doc").alias("holder"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                F.lit(0).alias("role"), "doc", "th", "text")
    streams = followers.unionByName(holders).repartition("holder", "part").sortWithinPartitions("holder", "part", "role")
    found = streams.mapInPandas(located(width), "doc bigint, th bigint, edges array<bigint>")
    per_doc = few(found.groupBy("doc", "th").agg(F.flatten(F.collect_list("edges")).alias("edges")), "edges", broadcast_rows)
    judged = rows.join(per_doc, ["doc", "th"], "left").select("doc", "text", "edges")
    kept = judged.mapInPandas(without_passages, "doc bigint, text string, n_words bigint, n_removed bigint")
    return kept.select(F.when(F.col("doc") != last, F.col("doc")).alias("doc_id"), "text", "n_words", "n_removed")
