"""Language of documents by a mixture of languages over character trigrams.

Training counts trigrams by language in one aggregate. A document's trigrams are taken as draws from a mixture
of the languages' trigram laws; expectation-maximisation estimates the proportions. Starting from all
languages, the weakest is dropped one by one, and the set with the best penalised likelihood stays.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 15
SPACE = 32


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram over lower-cased letters; other characters count as one blank between words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where(letters()[c], c, SPACE)
    c = np.concatenate([[SPACE], c, [SPACE]]).astype(np.uint64)
    c = c[np.r_[True, (c[1:] != SPACE) | (c[:-1] != SPACE)]]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int64)


def trigram_counts(batches):
    """Counts by language of one partition."""
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, counts in total.items():
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": counts[seen]})


def is_held_out(id_col: str, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (buckets x languages) from all rows of ``docs``.

    Rows without text or language are left out. The driver receives at most buckets x languages counts.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInPandas(trigram_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(names)), smooth)
    where = {name: k for k, name in enumerate(names)}
    np.add.at(table, (counts["bucket"].to_numpy(np.int64), counts["lang"].map(where).to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    return names, (table / table.sum(axis=0)).astype(np.float32)


def proportions(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int):
    """Mixture proportions by EM for many documents at once, and their log likelihood before the last step.

    ``p`` holds trigram probabilities (entries x languages), ``n`` counts, ``starts`` each document's first entry.
    """
    size = np.diff(np.r_[starts, len(n)])
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        part = p * np.repeat(share, size, axis=0)
        mix = part.sum(axis=1)
        part *= (n / mix)[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    return share, np.add.reduceat(n * np.log(np.maximum(mix, 1e-30)), starts)


def mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, rounds: int):
    """Chosen proportions (documents x languages) under the set with the best penalised likelihood."""
    docs, langs = len(starts), p.shape[1]
    share, _ = proportions(p, n, starts, np.full((docs, langs), 1 / langs, np.float32), rounds)
    top = np.tile(np.arange(langs), (docs, 1))
    penalty = np.log(np.add.reduceat(n, starts))
    best, chosen, inside = np.full(docs, np.inf), share.copy(), np.ones_like(share, bool)
    for k in range(share.shape[1], 0, -1):
        share, fit = proportions(p, n, starts, share, rounds)
        cost = (k - 1) * penalty - 2 * fit / 3  # every letter is in three trigrams
        better = cost < best
        best[better], chosen[better] = cost[better], share[better]
        weakest = np.where(inside, share, np.inf).argmin(axis=1)
        inside[np.arange(docs), weakest] = False
        share = np.where(inside, np.maximum(share, 1e-6), 0).astype(np.float32)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return top, chosen


def predicted(names: list[str], shared, rounds: int, text_at: int, slice_docs: int = 128):
    def run(batches):
        table = np.frombuffer(shared.value, np.float32).reshape(BUCKETS, len(names))
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), [text_at])
            n = len(texts)
            lang, score, shares = ["und"] * n, [0.0] * n, [None] * n
            for lo in range(0, n, slice_docs):
                which, idx, cnt = [], [], []
                for r in range(lo, min(lo + slice_docs, n)):
                    grams = trigrams(texts[r].as_py() or "")
                    if len(grams) and names:
                        counts = np.bincount(grams, minlength=BUCKETS)
                        seen = np.flatnonzero(counts)
                        which.append(r), idx.append(seen), cnt.append(counts[seen])
                if not which:
                    continue
                starts = np.cumsum([0] + [len(x) for x in idx[:-1]])
                top, share = mixture(table[np.concatenate(idx)], np.concatenate(cnt).astype(np.float32), starts, rounds)
                for r, t, s in zip(which, top, share):
                    k = int(s.argmax())
                    lang[r], score[r] = names[t[k]], min(1.0, max(0.0, float(s[k])))
                    shares[r] = {names[t[j]]: float(s[j]) for j in np.flatnonzero(s > 0)}
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                ["row", "lang_pred", "score", "shares"])
    return run


def annotate(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", rounds: int = 6) -> DataFrame:
    """(row, lang_pred, score, shares) for every row of ``docs``; ``row`` holds its columns as they are."""
    names, table = learn(train, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    rows = docs.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])
    return rows.mapInArrow(predicted(names, shared, rounds, docs.columns.index(text_col)), schema)


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", rounds: int = 6, parts: int = 4, part: int = 2) -> DataFrame:
    """Predicted language of every row of ``docs``.

    Learns from the rows of ``train`` (``docs`` itself if None) whose id is not held out. Returns doc_id, held_out,
    lang_pred, score (share of the predicted language) and shares (map of the chosen languages to their shares;
    the selection starts from all learned languages). A null text or one without a letter is ``und`` with score 0,
    and so is everything if there is nothing to learn from. Ties go to the language first by name. Repeated rows
    get equal results, an empty table gives no rows, other columns are ignored.
    """
    known = (docs if train is None else train).where(~is_held_out(id_col, parts, part))
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col, parts, part).alias("held_out"), F.col(text_col).alias("text"))
    out = annotate(rows, known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), rounds=rounds)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score", "shares")


def in_a_language(docs: DataFrame, least: float = 1 / 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, unchanged, of which one language makes up at least ``least``; learns like ``identify``."""
    known = docs.where(~is_held_out(id_col, 4, 2))
    return annotate(docs, known, text_col, lang_col).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
