"""Focal losses per row as column arithmetic.

Cross entropy uses a stable log-sum-exp; binary cross entropy with logits
uses ``max(x, 0) - x*y + log1p(exp(-|x|))``. Class weights multiply the
whole element, and the probability of the true class is clamped to
``[1e-4, 1 - 1e-4]`` before the focal factor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.arrays import as_col

EPS = 1e-4


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0 - EPS))


def focal_ce(logits: Column | str, target: Column | str, weights: Column | None = None,
             gamma: float = 2.0) -> Column:
    """Focal cross entropy of one row: ``(1 - pt)**gamma * w[y] * (lse(b) - b[y])``.

    ``logits`` is an array, ``target`` the 0-based class index, ``weights``
    an optional array of per-class weights.
    """
    b = as_col(logits)
    y = as_col(target)
    m = F.array_max(b)
    lse = m + F.log(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    by = F.element_at(b, y + 1)
    ce = lse - by
    if weights is not None:
        ce = F.element_at(weights, y + 1) * ce
    pt = _clamp(F.exp(by - lse))
    return F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * ce


def focal_bce(logits: Column | str, targets: Column | str, weights: Column | None = None,
              gamma: float = 2.0) -> Column:
    """Element-wise focal BCE with logits; returns ``array<double>``.

    ``weights`` is read inside a lambda, so it must be a plain column (attach
    a scalar-subquery weight vector with ``withColumn`` first).
    """
    x_arr = as_col(logits)
    y_arr = as_col(targets)

    def elem(x, i):
        y = F.element_at(y_arr, i + 1).cast("double")
        bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        if weights is not None:
            bce = F.element_at(weights, i + 1) * bce
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
        pt = _clamp(F.when(y >= 0.5, p).otherwise(F.lit(1.0) - p))
        return F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * bce

    return F.transform(x_arr, elem)


def array_mean(arr: Column | str) -> Column:
    a = as_col(arr)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
