"""Linear heads over hashed text, trained together by Spark aggregates (M7, M9).

A text is its token slots (hashes modulo ``num_features``); token j adds its inverse
document frequency to feature j, and a text's features are divided by the root of
its number of tokens. The slots are computed once, by column functions, and
written; a margin is then a sum over slots.

A ``Head`` is one focal loss: class weights, focal exponent, an optional mask to YES
rows, a factor and a ridge. Any number of heads (both levels, all trials of a
search) share each pass over the slots: tasks add up loss and gradient of
all heads, and one grouped aggregate adds the tasks' sums by slot. Every head
runs its own L-BFGS with backtracking on the driver, which holds weights and
gradients only (heads x features numbers, never rows); a head that is done takes
no part in later passes. The result carries a certificate: the norm
of the objective's gradient at the weights that are returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-4  # the probability of the true class is clamped to [EPS, 1 - EPS] in the focal factor
MEMORY = 8  # steps an L-BFGS direction looks back
BACKTRACKS = 20
MODEL_BYTES = 64 << 20  # weights of the heads that share a pass
BLOCK_ROWS = 32  # texts whose slots are counted in one matrix
BLOCK_TOKENS = 1 << 15
ROWS_AT_ONCE = 256  # texts whose matrices a task holds


def token_slots(text: Column, num_features: int) -> Column:
    """Slot of every token of a text, in text order; null text has none."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))


def document_frequencies(features: DataFrame, num_features: int) -> tuple[int, np.ndarray]:
    """Number of rows, and log((rows + 1) / (rows with the slot + 1)) of every slot."""
    told = (features.select(F.explode(F.array_append(F.array_distinct("slots"), F.lit(-1))).alias("slot"))
            .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toPandas())  # at most num_features + 1 rows
    rows = int(told.loc[told["slot"] == -1, "n"].sum())
    seen = np.zeros(num_features)
    hit = told[told["slot"] >= 0]
    seen[hit["slot"].to_numpy()] = hit["n"].to_numpy()
    return rows, np.log((rows + 1.0) / (seen + 1.0))


@dataclass
class Head:
    """One focal loss over the rows. ``target`` is -1 for the binary label, else a category's index."""

    name: str
    target: int
    gamma: float
    weights: tuple[float, float]  # of label 0 and 1
    factor: float  # the sum over the rows is multiplied by this
    reg: float
    max_iter: int
    rows: int = 0
    positives: int = 0
    trial: int = 0

    @property
    def constant(self) -> bool:
        return self.positives in (0, self.rows)


@dataclass
class Fit:
    """Weights (features, then the constant) and the certificate of one head."""

    head: Head
    weights: np.ndarray
    loss: float = 0.0
    start_loss: float = 0.0
    grad_norm: float = 0.0
    passes: int = 0
    converged: bool = True
    _grad: np.ndarray | None = field(default=None, repr=False)
    _steps: list = field(default_factory=list, repr=False)
    _direction: np.ndarray | None = field(default=None, repr=False)
    _rate: float = 1.0
    _tried: int = 0


def focal_terms(margin: np.ndarray, label: np.ndarray, gamma: float, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Focal loss of each margin and its slope."""
    sign = np.where(label > 0, 1.0, -1.0)
    m = sign * margin
    ce = np.logaddexp(0.0, -m)
    pt = np.exp(-ce)
    q = 1.0 - np.clip(pt, EPS, 1.0 - EPS)
    inside = (pt > EPS) & (pt < 1.0 - EPS)
    w = np.where(label > 0, weights[1], weights[0])
    slope = -(q ** gamma) * (1.0 - pt)
    if gamma:
        slope -= gamma * q ** (gamma - 1.0) * pt * (1.0 - pt) * ce * inside
    return w * q ** gamma * ce, w * sign * slope


def _slot_counts(slots: np.ndarray, sizes: np.ndarray, features: int) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in blocks: their rows, the slots they have, and how often each of them has each of these slots.

    Sums over the tokens of a block are then products with its small dense matrix.
    """
    cut = np.concatenate([[0], np.cumsum(sizes)])
    out, lo = [], 0
    while lo < len(sizes):
        hi = int(np.searchsorted(cut, cut[lo] + BLOCK_TOKENS, "right")) - 1
        hi = min(max(hi, lo + 1), lo + BLOCK_ROWS, len(sizes))
        own = slots[cut[lo]: cut[hi]].astype(np.intp, copy=False)
        seen = np.zeros(features, bool)
        seen[own] = True
        some = np.flatnonzero(seen)
        place = np.empty(features, np.int64)
        place[some] = np.arange(len(some))
        cell = place[own] + np.repeat(np.arange(hi - lo) * len(some), sizes[lo:hi])
        counts = np.bincount(cell, minlength=(hi - lo) * len(some)).reshape(hi - lo, -1).astype(np.float64) if len(some) else np.zeros((hi - lo, 0))
        out.append((slice(lo, hi), some, counts))
        lo = hi
    return out


def _token_sums(blocks: list, table: np.ndarray, rows: int) -> np.ndarray:
    """(rows, heads): sums of the table's rows over the tokens of each text."""
    out = np.zeros((rows, table.shape[1]))
    for part, some, counts in blocks:
        out[part] = counts @ table[some]
    return out


def _pieces(sizes: np.ndarray):
    """(rows, tokens) of runs of at most ``ROWS_AT_ONCE`` texts."""
    cut = np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, len(sizes), ROWS_AT_ONCE):
        hi = min(lo + ROWS_AT_ONCE, len(sizes))
        yield slice(lo, hi), slice(cut[lo], cut[hi])


def margins(slots: np.ndarray, sizes: np.ndarray, table: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """(rows, heads): margins of texts from a (features, heads) table."""
    out = np.empty((len(sizes), table.shape[1]))
    for rows, tokens in _pieces(sizes):
        n = rows.stop - rows.start
        out[rows] = _token_sums(_slot_counts(slots[tokens], sizes[rows], len(table)), table, n)
    return out / np.sqrt(np.maximum(sizes, 1))[:, None] + constants


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end, and the number of values of each row."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _evaluate(features: DataFrame, idf, fits: list[Fit], points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every head at its point, without the ridge: one aggregate."""
    spark = features.sparkSession
    heads = [f.head for f in fits]
    size = len(points[0]) - 1
    shared = spark.sparkContext.broadcast((idf, np.stack(points, axis=1), heads))

    def run(batches):
        idf, w, heads = shared.value
        table = idf[:, None] * w[:-1]
        total, losses = np.zeros((size + 1, len(heads))), np.zeros(len(heads))
        for batch in batches:
            slots, sizes = _list_parts(batch.column(0))
            yes = batch.column(1).to_numpy(zero_copy_only=False)
            cats = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(len(sizes), -1)
            for rows, tokens in _pieces(sizes):
                blocks = _slot_counts(slots[tokens], sizes[rows], size)
                scale = 1.0 / np.sqrt(np.maximum(sizes[rows], 1))
                m = _token_sums(blocks, table, len(scale)) * scale[:, None] + w[-1]
                slopes = np.empty_like(m)
                for h, head in enumerate(heads):
                    label = yes[rows] if head.target < 0 else cats[rows, head.target]
                    loss, slope = focal_terms(m[:, h], label, head.gamma, head.weights)
                    if head.target >= 0:  # the category loss counts YES rows only
                        loss, slope = loss * yes[rows], slope * yes[rows]
                    losses[h] += loss.sum()
                    slopes[:, h] = slope
                total[size] += slopes.sum(axis=0)
                slopes *= scale[:, None]
                for part, some, counts in blocks:
                    total[some] += counts.T @ slopes[part]
        total[:size] *= idf[:, None]
        used = np.flatnonzero(total.any(axis=1))
        rows = np.concatenate([total[used], losses[None]])
        slot = np.concatenate([used, [size + 1]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slot), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], out.names)

    out = T.StructType([T.StructField("slot", T.IntegerType()), *[T.StructField(f"g{h}", T.DoubleType()) for h in range(len(heads))]])
    told = (features.select("slots", "y_bin", "y_cat").mapInArrow(run, out).groupBy("slot")
            .agg(*[F.sum(f"g{h}").alias(f"g{h}") for h in range(len(heads))]).toPandas())  # at most features + 2 rows
    shared.unpersist()
    grads, losses = np.zeros((size + 1, len(heads))), np.zeros(len(heads))
    slot, values = told["slot"].to_numpy(), told.drop(columns="slot").to_numpy()
    grads[slot[slot <= size]] = values[slot <= size]
    losses += values[slot > size].sum(axis=0)
    return losses, grads.T


def _direction(fit: Fit) -> np.ndarray:
    """L-BFGS direction from the last steps (two-loop recursion)."""
    q, kept = fit._grad.copy(), []
    for s, y, rho in reversed(fit._steps):
        a = rho * (s @ q)
        kept.append(a)
        q -= a * y
    if fit._steps:
        s, y, _ = fit._steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y, rho), a in zip(fit._steps, reversed(kept)):
        q += (a - rho * (y @ q)) * s
    return -q


def _advance(fit: Fit, point: np.ndarray, loss: float, grad: np.ndarray, tol: float) -> bool:
    """Take or refuse the point a pass has evaluated; False once the head is done."""
    fit.passes += 1
    first = fit._grad is None
    if not first and loss > fit.loss + 1e-4 * fit._rate * (fit._grad @ fit._direction):
        fit._rate, fit._tried = fit._rate / 2, fit._tried + 1
        if fit._tried > BACKTRACKS:
            if not fit._steps:
                return False  # not even steepest descent finds a lower point
            fit._steps, fit._tried = [], 0
            fit._direction, fit._rate = -fit._grad, min(1.0, 1.0 / np.linalg.norm(fit._grad))
        return fit.passes < fit.head.max_iter
    if first:
        fit.start_loss = loss
    else:
        s, y = point - fit.weights, grad - fit._grad
        if s @ y > 1e-12 * (y @ y):  # the focal loss is not convex: only steps of positive curvature count
            fit._steps = [*fit._steps, (s, y, 1.0 / (s @ y))][-MEMORY:]
    fit.weights, fit.loss, fit._grad = point, loss, grad
    fit.grad_norm = float(np.linalg.norm(grad))
    fit.converged = fit.grad_norm <= tol
    fit._direction, fit._tried = _direction(fit), 0
    if grad @ fit._direction >= 0:
        fit._steps, fit._direction = [], -grad
    fit._rate = 1.0 if fit._steps else min(1.0, 1.0 / max(fit.grad_norm, 1e-12))
    return not fit.converged and fit.passes < fit.head.max_iter


def fit_heads(features: DataFrame, idf: np.ndarray, heads: Sequence[Head], tol: float = 1e-3) -> list[Fit]:
    """Fit heads to rows of ``slots``, ``y_bin`` (0/1) and ``y_cat`` (array of 0/1).

    A head whose label is the same in all its rows is not fitted (``Head.constant``).
    ``max_iter`` counts passes; a head that ends above ``tol`` is marked as not converged.
    """
    size = len(idf)
    fits = [Fit(h, np.zeros(size + 1)) for h in heads]
    todo = [f for f in fits if not f.head.constant]
    per_pass = max(1, MODEL_BYTES // (8 * (size + 1)))
    for i in range(0, len(todo), per_pass):
        live = todo[i: i + per_pass]
        while live:
            points = [f.weights if f._direction is None else f.weights + f._rate * f._direction for f in live]
            losses, grads = _evaluate(features, idf, live, points)
            left = []
            for f, p, loss, grad in zip(live, points, losses, grads):
                ridge = np.append(p[:-1], 0.0) * f.head.reg
                total = f.head.factor * loss + 0.5 * float(ridge @ p)
                if _advance(f, p, total, f.head.factor * grad + ridge, tol):
                    left.append(f)
            live = left
    for f in fits:
        f._steps, f._direction, f._grad = [], None, None
    return fits


def margin_column(spark, slots: Column | str, idf: np.ndarray, weights: np.ndarray) -> Column:
    """Margins of all heads of a row as ``array<double>``; ``weights`` is (heads, features + 1)."""
    shared = spark.sparkContext.broadcast((idf[:, None] * weights[:, :-1].T, weights[:, -1]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def told(column: pd.Series) -> pd.Series:
        sizes = column.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64)
        return pd.Series(list(margins(flat, sizes, *shared.value)))

    return told(slots)
