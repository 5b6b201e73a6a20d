"""Quality classifier: a sparse ensemble of rules over statistics of a text.

1. Statistics of whole texts are whole numbers (rates in thousandths), computed
   from byte and word arrays inside the tasks.
2. A random forest of shallow trees is grown by Spark on all labelled rows. Every
   path from a root to a node becomes a conjunction of bounds; equal conjunctions are kept once.
3. Labelled rows are counted by the pattern of rules that hold and by label, and
   a logistic regression with a lasso penalty is fitted on these weighted patterns, which is the
   same as on the rows. The penalty is the one of ``PENALTIES`` with the least log loss on a
   quarter of the rows (by hash of the id); the weights are then fitted on all rows.
4. Rules with a weight become one Spark column expression, so scoring reads the
   statistics and runs no model code.

Learning covers all labelled rows; the driver holds trees, rules and weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

TREES = 24
DEPTH = 3
MIN_ROWS = 5  # labelled rows in a leaf
PENALTIES = (0.001, 0.004, 0.016)
ROUNDS = 60
LEAST_WEIGHT = 1e-4
SEED = 7
THRESHOLD = 0.5

FEATURES = ("n_words", "word_bytes", "long_words", "upper_rate", "digit_rate", "mark_rate", "symbol_rate", "other_rate",
            "line_words", "distinct_words", "repeat_share", "same_next", "ends_marked", "bare_marks")

_KIND = np.zeros(256, np.uint8)  # 0: other ASCII
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_KIND[[ord(c) for c in "!?.,;:"]] = 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[128:] = 5
_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive places of ``first``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text (by 40 bits of them)."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.sort((owner << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return _sums(new, first)  # the texts stay in order


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of every text: (texts, features); rates in thousandths, -1 without words."""
    starts, ends, first = tx.word_bounds(data, offsets)
    hashes = tx.span_hashes(data, starts, ends)
    n, width = np.diff(first), ends - starts
    chars = _sums(width, first)
    kinds = _KIND[data]
    by_kind = [_sums(kinds == k, offsets) for k in range(1, 6)]
    lines = _sums(data == 10, offsets) + 1
    grams, at = tx.shingle_hashes(hashes, first, 3)
    n_grams = np.diff(at)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    opening = first[:-1][n > 0]
    same[opening] = False
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    bare = letters[ends] == letters[starts]
    marked = ~_LETTER[data[ends - 1]] & ~bare if len(ends) else bare

    def rate(a, b):
        return np.where(n > 0, 1000 * a // np.maximum(b, 1), -1)

    return np.stack([
        n, rate(chars, n), rate(_sums(width > 12, first), n), *[rate(c, chars) for c in by_kind],
        rate(n, 1000 * lines), rate(_distinct(hashes, first), n), rate(n_grams - _distinct(grams, at), n_grams),
        rate(_sums(same, first), n), rate(_sums(marked, first), n), rate(_sums(bare, first), n)], axis=1).astype(np.int64)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and FEATURES of every row; null text has no words."""
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = T.StructType([*fields, *[T.StructField(f, tx.LONG) for f in FEATURES]])

    def run(batches):
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(len(keep)))
            rows = [np.zeros((0, len(FEATURES)), np.int64)]
            rows += [text_features(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in tx.doc_chunks(offsets)]
            found = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c) for c in found.T]], out.names)

    return docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text")).mapInArrow(run, out).toDF(*keep, *FEATURES)


@dataclass(frozen=True, order=True)
class Rule:
    """A conjunction of bounds: (feature, exclusive lower, inclusive upper); None is open."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (F.col(name) > low)
            if high is not None:
                out = out & (F.col(name) <= high)
        return out

    def __str__(self) -> str:
        return " and ".join(" ".join(([f"{low:g} <"] if low is not None else []) + [f] + ([f"<= {high:g}"] if high is not None else []))
                            for f, low, high in self.bounds)


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def tree_rules(text: str, names=FEATURES) -> list[Rule]:
    """The rule of every node below the root, from a tree's printed form."""
    out, path = [], []
    for line in text.splitlines():
        if m := _TEST.match(line):
            depth, feature, upper, threshold = len(m[1]), names[int(m[2])], m[3] == "<=", float(m[4])
            path = [p for p in path if p[0] < depth] + [(depth, feature, upper, threshold)]
            bounds: dict[str, list] = {}
            for _, f, u, t in path:
                low, high = bounds.setdefault(f, [None, None])
                if u:
                    bounds[f][1] = t if high is None else min(high, t)
                else:
                    bounds[f][0] = t if low is None else max(low, t)
            out.append(Rule(tuple(sorted((f, *b) for f, b in bounds.items()))))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules: the score is the logistic of constant + the weights of the rules that hold."""

    constant: float
    weighted: tuple[tuple[Rule, float], ...]

    def margin(self) -> Column:
        out = F.lit(self.constant)
        for rule, weight in self.weighted:
            out = out + F.when(rule.column(), weight).otherwise(0.0)
        return out

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _fit(patterns: DataFrame, penalty: float):
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="n", regParam=penalty, elasticNetParam=1.0,
                              standardization=False, maxIter=ROUNDS).fit(patterns)


def _loss(patterns: DataFrame, model) -> float:
    """Log loss of weighted patterns."""
    from pyspark.ml.functions import vector_to_array

    m = F.element_at(vector_to_array("rawPrediction"), 2)
    row = F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - F.col("y") * m
    told = model.transform(patterns).agg(F.sum(F.col("n") * row).alias("s"), F.sum("n").alias("n")).first()
    return told["s"] / told["n"] if told["n"] else 0.0


def learn_rules(labelled: DataFrame, label: str = "label", names=FEATURES) -> Ensemble | float:
    """The ensemble from rows with features, doc_id and a label 0 or 1 (others are not used); the constant
    share of label 1 if one of the two is missing (no labels: 0)."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("double").alias("y"), (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)) == 0).alias("check"), *names)
    rows = tx.settle(rows, "rulefit-labelled")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(counts.get(1.0, 0) > 0)
    grown = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_ROWS,
                                   featureSubsetStrategy="onethird", seed=SEED).fit(
        VectorAssembler(inputCols=list(names), outputCol="x").transform(rows).select("x", "y"))
    rules = sorted({r for tree in grown.trees for r in tree_rules(tree.toDebugString, names)}, key=repr)
    holds = F.array(*[r.column().cast("double") for r in rules]) if rules else F.array().cast("array<double>")
    patterns = tx.settle(rows.select("y", "check", holds.alias("holds")).groupBy("y", "check", "holds").agg(F.count("*").cast("double").alias("n"))
                         .select("y", "check", "n", array_to_vector("holds").alias("x")), "rulefit-patterns")
    if not rules:
        return counts[1.0] / sum(counts.values())
    held, used = patterns.where("check"), patterns.where(~F.col("check"))
    kinds = {r["y"] for r in used.select("y").distinct().collect()}
    if len(kinds) == 2 and held.limit(1).count():
        penalty = min(PENALTIES, key=lambda p: _loss(held, _fit(used, p)))
    else:
        penalty = PENALTIES[0]
    model = _fit(patterns, penalty)
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights) if abs(w) >= LEAST_WEIGHT))


def judge(docs: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, score and predicted (1 if score >= THRESHOLD) of every row, learning from the labels where ``use``.

    Null and empty texts have no words (rates of -1) and are scored by the rules like
    any other. Null ids are scored and join no label; repeated rows are
    scored alike; a document with several labels counts once for each. Other columns, of either
    table, are ignored; empty tables give an empty result; with labels of one kind only, or
    none, the score is constant.
    """
    stats = tx.settle(statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "rulefit-statistics")
    told = labels.where(use).select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    model = learn_rules(stats.join(told, "doc_id"))
    score = F.lit(model) if isinstance(model, float) else model.score()
    return stats.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with the labels of the folds 0 and 2 of three; held_out marks fold 1."""
    told = judge(docs, labels, tx.fold("doc_id", 3) != 1)
    return told.select("doc_id", (tx.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
