"""Quality rules: fixed base rules and a learned decision list, DataFrame functions only.

The statistics of a text are computed in one projection without a shuffle.
A decision list is learned from labelled statistics by sequential covering: a
rule starts empty and grows by the threshold test with the best information
gain on the growing part of the labelled rows, until it covers no good text or
nothing is gained; it is pruned to the prefix with the best balance on the
pruning part, kept if its precision there suffices, and the rows it covers
leave. Each step needs one aggregate (counts by feature, bin and label, at most
``features x (BINS + 1) x 2`` rows for the driver), so learning reads all
labelled rows and collects none. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm import textops as tx

BINS = 32
MAX_RULES = 12
MAX_TESTS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 10  # labelled rows a rule must cover when it grows
WINDOW = 8
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT = 30  # percent of words in repeated windows

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!?.,;:"
FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
            "mark_rate", "loud_rate")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def marked(pairs: Column) -> Column:
            same = F.transform(pairs, lambda e, k: F.when(
                (F.get(pairs, k - 1)["h"] == e["h"]) | (F.get(pairs, k + 1)["h"] == e["h"]), e["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                F.sort_array(F.array_compact(same)), start,
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
                lambda acc: acc["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(pairs, marked)).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return _let(words, lambda w: F.when(F.size(w) > WINDOW, _let(windows(w), covered)).otherwise(F.lit(0).cast("long")))


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts and the characters the features need; null text has no words."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lined = rows.select(
        "doc_id", "text", F.regexp_extract_all(t, F.lit(_WORD), 0).alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD)).alias("lines"))
    n = F.length(t)
    return lined.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), _without(t, _BLANKS).cast("long").alias("word_chars"),
        (n - _without(t, _SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        (n - _without(t, _UPPER)).cast("long").alias("n_upper"), (n - _without(t, "0123456789")).cast("long").alias("n_digits"),
        (n - _without(t, _MARKS)).cast("long").alias("n_marks"), (n - _without(t, "!")).cast("long").alias("n_loud"))


def features(stats: DataFrame) -> DataFrame:
    """The statistics with the features the rules test: rates in thousandths, -1 without words."""
    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"1000 * {a} div {b}")).otherwise(F.lit(-1).cast("long"))

    return stats.withColumns({
        "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "digit_rate": rate("n_digits", "word_chars"),
        "mark_rate": rate("n_marks", "word_chars"), "loud_rate": rate("n_loud", "word_chars")})


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool  # value >= threshold, else value < threshold
    threshold: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _best_test(counts: dict, cuts: dict, bad: int, good: int) -> Test | None:
    """The test with the largest gain p * (log2 precision after - before); of equals the first."""
    best, gain = None, 1e-9
    before = math.log2(bad / (bad + good))
    for feature, thresholds in cuts.items():
        p = n = 0
        for k, threshold in enumerate(thresholds):  # bin k: below thresholds[k]
            p, n = p + counts.get((feature, k, 1), 0), n + counts.get((feature, k, 0), 0)
            for at_least, a, b in ((True, bad - p, good - n), (False, p, n)):
                if a + b >= MIN_COVERED and a:
                    g = a * (math.log2(a / (a + b)) - before)
                    if g > gain:
                        best, gain = Test(feature, at_least, threshold), g
    return best


def learn_list(labelled: DataFrame, names=FEATURES, label: str = "quality", bad_value: int = 0) -> list[tuple[Test, ...]]:
    """Ordered rules for bad texts from rows with features and a label (null labels not used).

    Without labelled rows of both kinds the list is empty.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        (F.col(label) == bad_value).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *names)
    rows = tx.settle(rows, "quality-labelled")
    probes = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, probes).alias(c) for c in names]).first()
    cuts = {c: sorted(set(found[c] or [])) for c in names}
    bins = F.array(*[F.struct(F.lit(c).alias("feature"), sum(((F.col(c) >= t).cast("int") for t in cuts[c]), F.lit(0)).alias("bin"))
                     for c in names])
    left, rules = F.lit(True), []
    while len(rules) < MAX_RULES:
        tests: list[Test] = []
        while len(tests) < MAX_TESTS:
            told = (rows.where(left & ~F.col("prune") & _all(tests)).select("bad", F.explode(bins).alias("e"))
                    .groupBy("e.feature", "e.bin", "bad").count().collect())
            counts = {(r["feature"], r["bin"], r["bad"]): r["count"] for r in told}
            bad, good = (sum(v for (f, _, y), v in counts.items() if f == names[0] and y == want) for want in (1, 0))
            if not bad or not good:
                break
            test = _best_test(counts, cuts, bad, good)
            if test is None:
                break
            tests.append(test)
        if not tests:
            break
        prefixes = [tests[:k] for k in range(1, len(tests) + 1)]
        told = rows.where(left & F.col("prune")).agg(
            *[F.count_if(_all(p) & (F.col("bad") == 1)).alias(f"p{k}") for k, p in enumerate(prefixes)],
            *[F.count_if(_all(p) & (F.col("bad") == 0)).alias(f"n{k}") for k, p in enumerate(prefixes)]).first()
        score = [(told[f"p{k}"] - told[f"n{k}"]) / max(told[f"p{k}"] + told[f"n{k}"], 1) for k in range(len(prefixes))]
        k = max(range(len(score)), key=lambda i: (score[i], -i))
        p, n = told[f"p{k}"], told[f"n{k}"]
        if not p or p / (p + n) < MIN_PRECISION:
            break
        rules.append(tuple(prefixes[k]))
        left = left & ~_all(prefixes[k])
    return rules


def list_column(rules) -> Column:
    """The decision list as one ordered expression: the number of the first rule that holds, else null."""
    out = None
    for k, tests in enumerate(rules):
        out = F.when(_all(tests), k + 1) if out is None else out.when(_all(tests), k + 1)
    return F.lit(None).cast("int") if out is None else out


def judge_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality") -> DataFrame:
    """Base counts, base_failed, the number of the learned rule that rejects (``rule``) and kept, for every row.

    Null and empty texts have no words and fail the base rules. Null ids are
    judged but join no label; repeated rows are judged alike; a document with
    several labels counts once for each. Other columns are ignored; empty
    tables give an empty result, and without labels only the base rules hold.
    """
    stats = tx.settle(text_statistics(docs, doc_id, text), "quality-statistics")
    told = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality"))
    rules = learn_list(features(stats).join(told, "doc_id"))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * F.col("n_words"))
    return features(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & list_column(rules).isNull()).alias("kept"), list_column(rules).alias("rule"))
