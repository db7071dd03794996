"""Collocations of two and more words, counted by double-array tries.

Texts are written once as word numbers, and words are counted. For every further length one pass over all texts surveys: a phrase is a candidate only if
the phrases without its last and without its first word are frequent (Apriori) and its occurrences, each task's capped at the
least count, add up to that count. The next pass counts: the candidates are compiled into double-array tries over word
numbers, broadcast one shard of bounded size at a time, and numpy moves the states of all positions of a text one
word further, level by level; accepting states are binned and the tasks' bins summed. Counting one length and surveying
the next share a pass.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalspark.llm.scan import slices
from shoalspark.staging import stage

#: A-Z lower-cased, tab made a space, ends of pieces made 255, a byte that UTF-8 never has
_PIECES = bytes(255 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\xff"
SLAB = 2 << 20
#: rows of a batch that a task hands over
ROWS = 1 << 16
#: for rows of megabytes: Parquet looks at sizes after 100 rows only, and its readers and codecs hold whole pages and all rows of a block
_MEGABYTE_ROWS = {"parquet.block.size": str(4 * SLAB), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


# --- texts as numbers


class Words:
    """Words of many texts as local numbers in order; number 0 is the end of a piece or text."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.number[_END] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for part in slices(text.translate(_PIECES).replace(_END, b" \xff ")):
            words = part.split()
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(text)

    def row(self, lang: str) -> pa.RecordBatch:
        # dictionaries keep the order of arrival, so the words come by their numbers; no word holds the byte between them
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([_END.join(itertools.islice(self.number, 1, None))], pa.binary()),
                                           pa.array([np.concatenate(self.parts).tobytes()], pa.binary())], ["lang", "words", "ids"])


def encoded(batches):
    """Texts of a task by language, some megabytes in a row."""
    for batch in batches:
        open_: dict[str, Words] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words = open_.setdefault(lang, Words())
            words.add(text.as_py())
            if words.size >= SLAB:
                yield open_.pop(lang).row(lang)
        yield from (words.row(lang) for lang, words in open_.items())


def slabs(batches) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, words by local number, local numbers in order) of every row that ``encoded`` made."""
    for batch in batches:
        for lang, words, ids in zip(batch.column("lang").to_pylist(), batch.column("words"), batch.column("ids")):
            yield lang, pa.array((_END + words.as_py()).split(_END), pa.binary()), np.frombuffer(ids.as_buffer(), np.int32)
            pa.default_memory_pool().release_unused()


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1):
    """Hands tasks so few rows at a time while a job over ``encoded`` rows runs, as each holds megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_counts(batches):
    for lang, words, ids in slabs(batches):
        n = np.bincount(ids, minlength=len(words))
        here = np.flatnonzero(n[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(here), pa.string()), words.take(pa.array(here)), pa.array(n[here])],
                                         ["lang", "phrase", "n"])


# --- the trie


class Trie:
    """Double-array trie over rows of symbols.

    The child of state s by symbol c is ``base[s] + c`` if ``check`` there is s. States in which phrases end have no
    children, so their ``base`` is the number of the phrase. Symbols are numbered from 1; 0 is no symbol.
    """

    def __init__(self, paths: np.ndarray, symbols: int):
        """``paths``: distinct rows of symbols, sorted by columns from left to right."""
        n, depth = paths.shape
        size = symbols + 1 + 2 * n + 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.low, self.symbols, self.top = symbols + 1, symbols, symbols + 1  # states start above the symbols, so bases stay positive
        self.check[0] = 0  # the root
        owner = np.zeros(n, np.int32)  # state of each path so far
        new = np.arange(n) == 0
        for level in range(depth):
            column = paths[:, level].astype(np.int32)
            new[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(new)
            self._place(owner[at], column[at])
            owner = np.repeat(self.base[owner[at]] + column[at], np.diff(np.r_[at, n]))
        self.base[owner] = np.arange(n, dtype=np.int32)
        self.size = self.top + symbols + 1
        self._grow(self.size)
        self.base = self.base[:self.size].copy()
        self.check = self.check[:self.size].copy()

    @property
    def phrase(self) -> np.ndarray:
        """Numbers of the phrases by the states in which they end."""
        return self.base

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 5 * len(self.check) // 4) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int32)]
            self.check = np.r_[self.check, np.full(more, -1, np.int32)]

    def _place(self, owners: np.ndarray, symbols: np.ndarray) -> None:
        """Slots for the children of every owner; owners come in runs."""
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        fan = np.diff(np.r_[cuts, len(owners)])
        many = np.flatnonzero(fan > 1)
        for k in many[np.argsort(-fan[many], kind="stable")]:
            c = symbols[cuts[k]:cuts[k] + fan[k]]
            self._settle(int(owners[cuts[k]]), c, self._fit(c))
        single = cuts[fan == 1]  # each takes any free slot
        self._grow(self.top + len(single) + 1)
        free = self.low + np.flatnonzero(self.check[self.low:] < 0)[:len(single)]
        c = symbols[single]
        self.base[owners[single]], self.check[free] = free - c, owners[single]
        self.top = max(self.top, int(free.max(initial=0)) + 1)

    def _fit(self, c: np.ndarray) -> int:
        """A base whose slots for the symbols ``c`` are all free."""
        span = int(c[-1] - c[0])
        lo = self.low
        for _ in range(4):
            self._grow(lo + 256 + span + 1)
            free = lo + np.flatnonzero(self.check[lo:lo + 256] < 0)[:max(1, (1 << 16) // len(c))]
            if len(free):
                ok = (self.check[free[:, None] + (c - c[0])[None, :]] < 0).all(axis=1)
                if ok.any():
                    return int(free[ok.argmax()] - c[0])
            lo = max(lo + 256, self.top - span - 256)
        return self.top - int(c[0])  # above everything

    def _settle(self, owner: int, c: np.ndarray, base: int) -> None:
        self._grow(base + int(c[-1]) + 1)
        self.base[owner] = base
        self.check[base + c] = owner
        self.top = max(self.top, base + int(c[-1]) + 1)
        while self.check[self.low:self.low + 64].min(initial=-1) >= 0:  # the full front is not searched again
            self.low += 64

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States one symbol further, -1 where there is none; ``state`` holds -1 or states."""
        to = self.base[state] + symbol
        return np.where((state >= 0) & (symbol > 0) & (self.check[to] == state), to, np.int32(-1))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings, not necessarily distinct."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(words), ROWS):
        part = pa.concat_arrays([words.slice(lo, ROWS)])  # its offsets start at 0
        ends = np.frombuffer(part.buffers()[1], np.int32)[:len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[:ends[-1]]
        size = np.diff(ends)
        power = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends[:-1], size)], out=sums[1:])
        out.append(sums[ends[1:]] - sums[ends[:-1]])
    return np.concatenate(out)


class Vocabulary:
    """Distinct words in the order of their hashes, looked up by them: a table of words would be built again for every slab."""

    def __init__(self, words: pa.Array):
        key = hashes(words)
        order = np.argsort(key, kind="stable")
        self.key, self.words = key[order], words.take(pa.array(order))

    def __len__(self) -> int:
        return len(self.key)

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of ``words``, -1 for those that are not there."""
        key = hashes(words)
        at = np.searchsorted(self.key, key)
        out, left = np.full(len(words), -1, np.int32), np.arange(len(words))
        while len(left):  # once, unless words share a hash
            left = left[at[left] < len(self.key)]
            left = left[self.key[at[left]] == key[left]]
            same = pc.equal(words.take(pa.array(left)), self.words.take(pa.array(at[left]))).to_numpy(zero_copy_only=False).astype(bool)
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out


def _words(rows: pa.RecordBatch) -> pa.Array:
    return pc.list_flatten(pc.split_pattern(rows.column("phrase"), " "))


class Candidates:
    """Trie of phrases of ``length`` words, and the numbers that their table gives them in the trie's order.

    A path has the language and the words, each as the two digits of its number to a base near the root of their count:
    children then lie close together, and the arrays stay near the number of phrases.
    """

    def __init__(self, rows: list[pa.RecordBatch], length: int):
        """``rows`` (number, lang, phrase) are taken out of their list as they are read, as the driver holds little more than them."""
        self.length = length
        self.langs = pc.unique(pa.chunked_array([b.column("lang") for b in rows], pa.string())).to_pylist()
        self.words = Vocabulary(pc.unique(pa.chunked_array([pc.unique(_words(b)) for b in rows], pa.binary())))
        self.radix = int(np.sqrt(max(len(self.langs), len(self.words)))) + 2
        n = sum(b.num_rows for b in rows)
        self.number, path, hi = np.empty(n, np.int64), np.empty((length + 1, n), np.int32), 0
        while rows:
            b = rows.pop()
            lo, hi = hi, hi + b.num_rows
            words = _words(b).dictionary_encode()
            self.number[lo:hi] = b.column("number").to_numpy()
            path[0, lo:hi] = pc.index_in(b.column("lang"), pa.array(self.langs, pa.string())).to_numpy()
            path[1:, lo:hi] = self.words.find(words.dictionary)[words.indices.to_numpy()].reshape(-1, length).T
            del b, words
        pa.default_memory_pool().release_unused()
        order = np.lexsort(path[::-1])
        self.number = self.number[order]
        symbols = np.empty((2 * length + 2, n), np.min_scalar_type(self.radix + 2))
        for k in range(length + 1):
            symbols[2 * k:2 * k + 2] = self.digits(path[k][order] + 1)
        del path, order
        self.trie = Trie(symbols.T, self.radix)

    def digits(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of numbers from 1; 0, an unknown word, has none."""
        return np.where(number > 0, number // self.radix + 1, 0).astype(np.int32), (number % self.radix + 1).astype(np.int32)

    def advance(self, lang: str, words: pa.Array, ids: np.ndarray) -> np.ndarray:
        """States of all positions after ``length`` words."""
        by_word = self.digits(self.words.find(words) + 1)
        ids = np.r_[ids, np.zeros(self.length, np.int32)]  # number 0 is no word
        n = len(ids) - self.length
        start = np.zeros(1, np.int32)
        for digit in self.digits(np.array([self.langs.index(lang) + 1 if lang in self.langs else 0])):
            start = self.trie.step(start, digit)
        state = np.full(n, start[0], np.int32)
        for k in range(self.length):
            for digit in by_word:
                state = self.trie.step(state, digit[ids[k:k + n]])
        return state


# --- a pass over the texts


def surveyed(state: np.ndarray, words: pa.Array, ids: np.ndarray, length: int, whole: bool, cap: int):
    """Phrases one word longer than the trie's of a slab, with their occurrences up to ``cap``.

    Their first words end in a state of the trie; if the trie is ``whole``, so do their last ones.
    """
    follow = np.r_[ids, np.zeros(length, ids.dtype)][length:][:len(ids)]
    safe = (state >= 0) & (follow > 0)
    if whole:
        safe[:-1] &= state[1:] >= 0
    at = np.flatnonzero(safe)
    _, first, n = np.unique(state[at].astype(np.int64) * len(words) + follow[at], return_index=True, return_counts=True)
    for lo in range(0, len(n), ROWS):
        here = at[first[lo:lo + ROWS]]
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(ids[here + k])) for k in range(length + 1)], pa.scalar(b" ", pa.binary()))
        yield phrases, np.minimum(n[lo:lo + ROWS], cap)


def passed(shared, whole: bool, survey: bool, count: bool, cap: int):
    """Rows (lang, phrase, n) of surveyed phrases and (number, n) of counted ones."""
    def run(batches):
        held: Candidates = shared.value
        bins = np.zeros(len(held.number), np.int64)
        for lang, words, ids in slabs(batches):
            state = held.advance(lang, words, ids)
            if count:
                np.add.at(bins, held.trie.phrase[state[state >= 0]], 1)
            if survey:
                for phrases, n in surveyed(state, words, ids, held.length, whole, cap):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.nulls(len(n), pa.int64()),
                                                      pa.array(n, pa.int64())], _ROWS)
        found = np.flatnonzero(bins)
        for lo in range(0, len(found), ROWS):
            at = found[lo:lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.binary()),
                                              pa.array(held.number[at]), pa.array(bins[at])], _ROWS)
    return run


_ROWS = ["lang", "phrase", "number", "n"]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def one_pass(texts: DataFrame, candidates: DataFrame, length: int, survey: bool, count: bool, least: int,
             shard: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Counts of ``candidates`` (lang, phrase of ``length`` words) and the candidates one word longer.

    The candidates go through the texts in shards of about ``shard`` phrases, each a pass of its own.
    """
    shards = max(1, -(-candidates.count() // shard))
    split = stage(candidates.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).alias("shard"))
                  .withColumn("number", F.monotonically_increasing_id()))
    sums = []
    for k in range(shards):
        held = Candidates(split.where(F.col("shard") == k).select("number", "lang", "phrase").toArrow().to_batches(), length)
        shared = texts.sparkSession.sparkContext.broadcast(held)
        del held  # the broadcast has it in a file
        # a task hands over its bins once, so there are as many as slots of the cluster ask for, however large the input
        out = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(passed(shared, shards == 1, survey, count, least), "lang string, phrase binary, number bigint, n bigint")
        # a task has a phrase once for some megabytes of text, so adding its rows up before they move would only cost memory
        with few_rows(texts.sparkSession):
            sums.append(stage(out.repartition("lang", "phrase", "number").groupBy("lang", "phrase", "number").agg(F.sum("n").alias("n")).where(F.col("n") >= least)))
        shared.destroy()
    every = _union(sums)
    counted = every.where("number is not null").select("number", "n").join(split, "number").select("lang", "phrase", "n")
    return stage(counted) if count else None, every.where("number is null").select("lang", "phrase") if survey else None


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10,
                  shard: int = 2_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """Word occurrences by language (lang, n), and by length from 1 the phrases (lang, phrase, n) with n >= ``least``."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    texts = stage(rows.mapInArrow(encoded, "lang string, words binary, ids binary"), **_MEGABYTE_ROWS)
    with few_rows(docs.sparkSession):
        words = stage(texts.mapInArrow(word_counts, "lang string, phrase binary, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    found = [words.where(F.col("n") >= least)]
    for length in range(1, longest + 1):
        counted, longer = one_pass(texts, found[0] if length == 1 else longer, length, length < longest, length > 1, least, shard)
        if length > 1:
            found.append(counted)
    return words.groupBy("lang").agg(F.sum("n").alias("n")), found


# --- scores


def _part(lo: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", lo, n), " ")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, top: int = 2000,
         share: int = 50, shard: int = 2_000_000) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs, A-Z lower-cased. A
    phrase of 2 to ``longest`` words has a = occurrences inside pieces (at least ``least``), score = the least over all
    cuts of floor(1,000,000 a a / (l r)) for the occurrences l and r of the two parts, the smallest cut among equals. A
    candidate that stands in a longer one with at least ``share`` percent of its occurrences is dropped. The first ``top`` of a
    language by score, a (both falling) and phrase (by UTF-8 bytes) are returned; n is the number of all words of the
    language. Null texts are empty, a null language is ``und``, repeated rows count as often as they stand there, an empty table
    gives no rows, other columns are ignored. Very long texts are split into words a megabyte at a time and need some 20
    bytes a word. Integers are exact while a < 10^16.
    """
    totals, found = phrase_counts(docs, text_col, lang_col, longest, least, shard)
    text = F.col("phrase").cast("string").alias("phrase")
    every = found[0].select("lang", text, "n")
    for f in found[1:]:
        every = every.unionByName(f.select("lang", text, "n"))
    every = stage(every)
    split = every.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words")) \
        .withColumn("size", F.size("words")).where("size > 1")
    cuts = split.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")) \
        .select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("size")).alias("right"))
    left = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = "decimal(38,0)"
    score = F.expr(f"(cast(1000000 as {whole}) * cast(a as {whole}) * cast(a as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "a", "cut", "l", "r", score.alias("score"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = split.where("size > 2").select("lang", "words", "size", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")) \
        .select("lang", "words", "k", "longer", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("lo")) \
        .select("lang", _part(F.col("lo"), F.col("k")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
                                                           F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
