"""Logits to labels: probabilities, thresholds, gating and label names.

All functions return native column expressions (no Python at run time).
Two boundaries of the reference are kept apart on purpose: prediction says
YES when the softmax probability is >= 0.5 (a logit tie is YES), while the
gated-logits export says YES only when argmax is 1 (a tie is NO).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.arrays import as_col


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def binary_prob(b0: Column | str, b1: Column | str) -> Column:
    """Probability of YES: softmax of two logits, ``1 / (1 + exp(b0 - b1))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(as_col(b0) - as_col(b1)))


def at_least(x: Column, threshold: float) -> Column:
    """``x >= threshold`` where NaN is never a yes (Spark alone orders NaN
    above every number); null stays null."""
    return (x >= F.lit(threshold)) & ~F.isnan(x)


def each(arr: Column | str, fn: Callable[[Column, int], Column], n: int | None = None) -> Column:
    """``fn(element, index)`` for every element. With the length ``n`` known
    at plan time the elements are spelled out, which keeps the projection in
    whole-stage code generation (a lambda would leave it); a null array stays
    null, and an array of another length is cut or filled with nulls."""
    a = as_col(arr)
    if n is None:
        return F.transform(a, fn)
    return F.when(a.isNotNull(), F.array(*[fn(F.get(a, F.lit(i)), i) for i in range(n)]))


def category_conf(logits: Column | str, n: int | None = None) -> Column:
    """Per-label confidence, element-wise sigmoid."""
    return each(logits, lambda x, i: sigmoid(x), n) if n else F.transform(as_col(logits), sigmoid)


def threshold_labels(probs: Column | str, threshold: float = 0.5, n: int | None = None) -> Column:
    """0/1 per element, inclusive threshold (F6); NaN is 0."""
    if n:
        return each(probs, lambda p, i: at_least(p, threshold).cast("int"), n)
    return F.transform(as_col(probs), lambda p: at_least(p, threshold).cast("int"))


def argmax_label(arr: Column | str) -> Column:
    """Index of the largest element, first index on ties."""
    a = as_col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def negative_vector(n: int, on: int | float = 1, off: int | float = 0) -> Column:
    return F.array(F.lit(on), *[F.lit(off) for _ in range(n - 1)])


def gate_predictions(prob: Column | str, cats: Column | str, n: int = 6,
                     threshold: float = 0.5) -> Column:
    """Categories kept only for YES (``prob >= threshold``); otherwise the
    negative one-hot ``[1, 0, ..., 0]`` (F8). A NaN probability is no YES."""
    return F.when(at_least(as_col(prob), threshold), as_col(cats)).otherwise(negative_vector(n))


def gate_logits(binary_logits: Column | str, category_logits: Column | str, n: int = 6) -> Column:
    """Category logits kept only when argmax of the binary logits is 1;
    otherwise ``[1, -1, ..., -1]`` (F9). A binary tie counts as NO."""
    return F.when(argmax_label(binary_logits) == 1, as_col(category_logits)) \
            .otherwise(negative_vector(n, 1.0, -1.0))


def label_names(multi_hot: Column | str, names: Sequence[str]) -> tuple[Column, Column]:
    """Multi-hot to ``(array of names, pipe string)``; no label gives ``-``."""
    a = as_col(multi_hot)
    named = [F.when(F.get(a, F.lit(i)) == 1, F.lit(name)) for i, name in enumerate(names)]
    # names differ, so this drops the nulls only, and stays in generated code
    picked = F.when(a.isNotNull(), F.array_except(F.array(*named), F.array(F.lit(None).cast("string"))))
    pipe = F.when(F.size(picked) == 0, F.lit("-")).otherwise(F.array_join(picked, "|"))
    return picked, pipe


def strict_label_names(percent_scores: Column | str, names: Sequence[str],
                       threshold: float = 50.0) -> Column:
    """Names whose percent score is strictly above ``threshold``, joined by
    ``', '``; none gives ``'none'`` (F11). A NaN score names nothing."""
    a = as_col(percent_scores)
    scores = [F.get(a, F.lit(i)) for i in range(len(names))]
    named = [F.when((x > F.lit(threshold)) & ~F.isnan(x), F.lit(name)) for x, name in zip(scores, names)]
    joined = F.concat_ws(", ", *named)
    return F.when(a.isNotNull(), F.when(joined == "", F.lit("none")).otherwise(joined))


def union_labels(a: Column | str, b: Column | str, n: int) -> Column:
    """Element-wise OR of two multi-hot vectors of length ``n``."""
    x, y = as_col(a), as_col(b)
    return F.array(*[F.greatest(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(n)])


def contains_label(joined: Column | str, label: str, match: str = "substring") -> Column:
    """Label membership in a joined label string.

    ``substring`` follows the reference (a label inside a longer label also
    matches); ``exact`` splits on ``', '`` and compares whole names.
    """
    c = as_col(joined)
    if match == "substring":
        return c.contains(label)
    if match == "exact":
        return F.array_contains(F.split(c, ", "), label)
    raise ValueError(f"match must be 'substring' or 'exact', got {match!r}")


def contradiction(cats: Column | str) -> Column:
    """Category 0 set together with any other category (F16)."""
    c = as_col(cats)
    return (F.element_at(c, 1) == 1) & F.array_contains(F.slice(c, 2, F.size(c) - 1), 1)


def predict(b0: Column | str, b1: Column | str, category_logits: Column | str,
            n: int = 6, threshold: float = 0.5) -> dict[str, Column]:
    """Predicted labels from logits (M3): the four prediction columns."""
    prob = binary_prob(b0, b1)
    conf = category_conf(category_logits, n)
    cats = threshold_labels(conf, threshold, n)
    return {
        "pred_binary": at_least(prob, threshold).cast("int"),
        "pred_binary_prob": prob,
        "pred_category": gate_predictions(prob, cats, n, threshold),
        "pred_category_confidence": conf,
    }
