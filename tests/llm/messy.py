"""Small frames with nulls, empty and long texts, repeated rows and columns whose names clash."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: names that the operators use inside
CLASH = ["doc", "th", "key", "node", "size", "shard", "prio", "copy", "row", "group", "score", "gram", "__row", "__id", "item", "hash", "weight"]


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents of 20 to 200 words in lines, with copies, near copies and shared passages; ids are shuffled."""
    rng = random.Random(seed)
    shared = words(rng, 70)
    texts: list[str] = []
    for i in range(n):
        w = words(rng, rng.randrange(20, 200))
        kind = i % 6
        if kind == 1 and texts:
            w = texts[rng.randrange(len(texts))].split()
            w[rng.randrange(len(w))] = "changed"
        elif kind == 2:
            at = rng.randrange(len(w))
            cut = rng.randrange(0, 25)
            w[at:at] = shared[cut:]
        elif kind == 3 and texts:
            w = texts[rng.randrange(len(texts))].split()
        lines = [" ".join(w[k:k + 9]) for k in range(0, len(w), 9)]
        texts.append("\n".join(lines + (["  A Line That Repeats \t"] if i % 4 == 0 else ["a line that repeats"] if i % 4 == 1 else [])))
    ids = list(range(n))
    rng.shuffle(ids)
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t)) for d, t in zip(ids, texts)]


def edge_cases() -> list[tuple]:
    long = " ".join(f"x{i % 997}" for i in range(30_000))
    return [(1001, None, None, None, None), (1002, "", "en", "a", 0), (1003, " \n\t ", "en", "b", 4), (1004, "12 34 !!", "de", None, 8),
            (1005, long, "en", "a", len(long)), (1006, "one", "en", "c", 3), (1006, "one", "en", "c", 3), (1007, "Ünïcödé ßtraße 日本語 \u2003 x", "de", "b", 20),
            (None, "no id here at all but five words", "en", "a", 10), (None, None, None, None, None), (1008, "one", None, "b", 3)]


def frame(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH]) if clash else df
