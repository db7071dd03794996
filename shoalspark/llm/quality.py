"""Quality scores by a sparse ensemble of rules.

Every document is reduced to a few statistics in one pass. A forest of shallow trees over the labelled rows
yields conjunctive rules, one for each path from a root; a lasso logistic regression over rules and statistics
keeps few of them. What stays is compiled into one Spark column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.language import is_held_out
from shoalspark.staging import stage

STATS = ["log_words", "mean_word", "unique_words", "unique_pairs", "letters", "upper", "digits", "stops", "symbols",
         "spaces", "log_lines", "repeated_lines", "short_words", "longest_word", "entropy"]
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 192)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_STOP = np.isin(_BYTE, list(b".,;:!?'\"()-"))
_CHAR = (_BYTE < 128) | (_BYTE >= 192)
_SYMBOL = ~_LETTER & ~_DIGIT & ~_SPACE & ~_STOP & _CHAR


def text_stats(text: str | None) -> tuple[float, ...]:
    """Statistics in the order of ``STATS``; all zero for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * len(STATS)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = n[_CHAR].sum()
    words, lines = raw.split(), raw.split(b"\n")
    k = len(words) or 1
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    p = n[n > 0] / len(raw)
    return tuple(map(float, (
        np.log1p(len(words)), size.mean(), len(set(words)) / k, len(set(zip(words, words[1:]))) / max(1, k - 1),
        n[_LETTER].sum() / chars, n[_UPPER].sum() / chars, n[_DIGIT].sum() / chars, n[_STOP].sum() / chars,
        n[_SYMBOL].sum() / chars, n[_SPACE].sum() / chars, np.log(len(lines)), 1 - len(set(lines)) / len(lines),
        (size <= 3).mean(), size.max(), -(p * np.log2(p)).sum())))


def stat_rows(batches):
    for batch in batches:
        texts = batch.column("text")
        stats = np.array([text_stats(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in stats.T]], ["doc_id", *STATS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(stat_rows, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS))


Condition = tuple[str, str, float]


def tree_rules(node, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path below the root of a fitted tree."""
    found = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, at = STATS[split.featureIndex()], float(split.threshold())
        found += tree_rules(node.leftChild(), (*path, (name, "<=", at)))
        found += tree_rules(node.rightChild(), (*path, (name, ">", at)))
    return found


def rule_column(rule: tuple[Condition, ...]) -> Column:
    tests = [F.col(name) <= at if op == "<=" else F.col(name) > at for name, op, at in rule]
    return reduce(Column.__and__, tests).cast("double")


class RuleModel:
    """Weights of rules and statistics; ``score()`` is a column expression over the statistics."""

    def __init__(self, rules, weights, bias):
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self) -> Column:
        z = F.lit(float(self.bias))
        for column, w in zip([rule_column(r) if isinstance(r, tuple) else F.col(r) for r in self.rules], self.weights):
            z = z + F.lit(float(w)) * column
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(labelled: DataFrame, trees: int = 24, depth: int = 3, strength: float = 5e-4, seed: int = 3) -> RuleModel:
    """Fit on all rows of ``labelled`` (statistics and ``label`` 0 or 1).

    Without rows the score is 0.5 throughout, with one class only it is near that class.
    """
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    zero, one = counts.get(0.0, 0), counts.get(1.0, 0)
    if not zero or not one:
        return RuleModel([], [], np.log((one + 0.5) / (zero + 0.5)))
    data = VectorAssembler(inputCols=STATS, outputCol="stats").transform(labelled)
    forest = RandomForestClassifier(labelCol="label", featuresCol="stats", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="0.5", minInstancesPerNode=5, maxBins=64).fit(data)
    rules: list = sorted({r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))})
    terms = [*rules, *STATS]
    named = labelled.select("label", *[(rule_column(r) if isinstance(r, tuple) else F.col(r)).alias(f"t{i}") for i, r in enumerate(terms)])
    named = VectorAssembler(inputCols=[f"t{i}" for i in range(len(terms))], outputCol="terms").transform(named).select("label", "terms")
    lasso = LogisticRegression(labelCol="label", featuresCol="terms", regParam=strength, elasticNetParam=1.0,
                               maxIter=60, standardization=True).fit(named)
    w = lasso.coefficients.toArray()
    kept = np.flatnonzero(w)
    return RuleModel([terms[i] for i in kept], w[kept], lasso.intercept)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = 0.3, parts: int = 5, part: int = 0) -> DataFrame:
    """Score of every row of ``docs``: how likely its label is 1.

    Learns from the labelled rows whose id is not held out, all of them. Returns doc_id, held_out, score and predicted
    (score >= threshold). A null or empty text is scored by its zero statistics. Labels that are null or of unknown
    ids are unused, repeated labels count repeatedly, repeated rows are scored alike, an empty table gives no
    rows. Other columns are ignored.
    """
    stats = stage(statistics(docs, id_col, text_col))
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("double").alias("label")) \
        .where("label in (0, 1)").where(~is_held_out("doc_id", parts, part))
    model = fit_rules(stage(stats.join(known, "doc_id").select("label", *STATS)))
    return stats.select("doc_id", is_held_out("doc_id", parts, part).alias("held_out"), model.score().alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
