"""Training on Spark (M7-M9).

M7 re-aims the reference's two-head network as a linear two-head model over
hashed text: focal cross entropy for the binary head, focal BCE of the YES rows for
one head per category, class weights in both, all heads fitted together by Spark
aggregates (``plans.linear``). It has the reference's interface and training
rule, not its quality. M8 analyses validation logs (best check and
early-stop check per run) exactly and without holding a run in one task. M9 fits a
grid of M7 models on a seeded sample and split, all trials in the same passes over
one stored feature table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.operators import metrics as M
from labelspark.operators.ordering import dense_positions
from labelspark.operators.sampling import sample_frac, stratified_split
from labelspark.plans import linear
from labelspark.scheme import DEFAULT_SCHEME, LabelScheme
from labelspark.session import materialise
from labelspark.streaming.scoring import with_predictions

CONSTANT_LOGIT = 10.0


# ---------------------------------------------------------------- M7
@dataclass
class TwoHeadModel:
    num_features: int
    idf: np.ndarray
    fits: list[linear.Fit]  # the binary head, then one per category

    def weights(self) -> np.ndarray:
        """(heads, features + 1); a constant head is its logit alone."""
        out = np.stack([f.weights for f in self.fits])
        for row, f in zip(out, self.fits):
            if f.head.constant:
                row[-1] = CONSTANT_LOGIT if f.head.positives else -CONSTANT_LOGIT
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``binary_logits`` ``[0, m]`` and ``category_logits`` per row; null text is scored as empty.

        A two-class softmax over ``[0, m]`` gives the head's probability
        ``sigmoid(m)``, so M3 applies unchanged.
        """
        m = linear.margin_column(df.sparkSession, linear.token_slots(F.col("text"), self.num_features), self.idf, self.weights())
        out = df.withColumn("_m", m)
        return out.select(*df.columns, F.array(F.lit(0.0), F.element_at("_m", 1)).alias("binary_logits"),
                          F.slice("_m", 2, len(self.fits) - 1).alias("category_logits"))

    def report(self, spark) -> DataFrame:
        """The certificate, one row per head: ``head, n_rows, positives, class_weight, constant,
        start_loss, loss, grad_norm, passes, converged``."""
        rows = [(f.head.name, f.head.rows, f.head.positives, float(f.head.weights[1]), f.head.constant, float(f.start_loss),
                 float(f.loss), float(f.grad_norm), f.passes, bool(f.converged)) for f in self.fits]
        return spark.createDataFrame(rows, REPORT)


REPORT = ("head string, n_rows long, positives long, class_weight double, constant boolean, start_loss double, loss double, "
          "grad_norm double, passes int, converged boolean")


def feature_table(labelled: DataFrame, num_features: int, keep: Sequence[str] = ()) -> DataFrame:
    """Slots and labels of the rows whose labels are known, written once, in as many parts as tasks can read at a time."""
    rows = labelled.where(F.col("binary_labels").isNotNull() & F.col("category_labels").isNotNull())
    return materialise(_spread(rows.select(
        *keep, linear.token_slots(F.col("text"), num_features).alias("slots"),
        F.element_at("binary_labels", 2).cast("double").alias("y_bin"), F.col("category_labels").cast("array<double>").alias("y_cat"))),
        "features")


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _weight(pos: int, n: int) -> float:
    return (n - pos) / pos if pos else float(n)


def two_heads(features: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, reg_param: float = 0.01, max_iter: int = 50,
              weighted: bool = True, gamma_binary: float = 1.0, gamma_category: float = 2.0, lambda_binary: float = 1.0,
              lambda_category: float = 1.0, trial: int = 0, counts=None) -> list[linear.Head]:
    """The heads of one model, with the class weights (A4) of the training rows.

    The binary loss is a mean over all rows; the category loss a mean over
    the labels, summed over YES rows and divided by max(#YES, 1).
    """
    n = scheme.n_categories
    c = counts or label_counts(features, n)
    rows, yes = c["n"], c["yes"]
    w = [(_weight(rows - yes, rows), _weight(yes, rows))] + [(_weight(c[f"p{j}"], rows),) * 2 for j in range(n)]
    if not weighted:
        w = [(1.0, 1.0)] * (n + 1)
    common = {"reg": reg_param, "max_iter": max_iter, "trial": trial}
    return [linear.Head("binary", -1, gamma_binary, w[0], lambda_binary / max(rows, 1), rows=rows, positives=yes, **common)] + [
        linear.Head(name, j, gamma_category, w[j + 1], lambda_category / (n * max(yes, 1)), rows=yes, positives=c[f"y{j}"], **common)
        for j, name in enumerate(scheme.level2)]


def label_counts(features: DataFrame, n: int) -> dict:
    """Rows, YES rows, and per category the positives of all rows (p) and of YES rows (y): one aggregate."""
    cat = [F.element_at("y_cat", j + 1) for j in range(n)]
    told = features.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_bin") == 1).alias("yes"),
        *[F.count_if(x == 1).alias(f"p{j}") for j, x in enumerate(cat)],
        *[F.count_if((x == 1) & (F.col("y_bin") == 1)).alias(f"y{j}") for j, x in enumerate(cat)]).first()
    return told.asDict()


def train_two_head(train: DataFrame, key: str = "doc_id", scheme: LabelScheme = DEFAULT_SCHEME,
                   num_features: int = 1 << 18, reg_param: float = 0.01, max_iter: int = 50, tol: float = 1e-3,
                   **kw) -> TwoHeadModel:
    """Fit the two-head model on labelled rows (``text``, ``binary_labels``, ``category_labels``).

    The objective is the reference's loss, ``lambda_binary`` x focal cross entropy +
    ``lambda_category`` x focal BCE of the YES rows, with class weights, plus a ridge
    (``reg_param``, not on the constants). Every head ends at a gradient norm of at most
    ``tol`` or after ``max_iter`` passes; ``TwoHeadModel.report`` tells which. Other
    keywords go to ``two_heads``. Rows with a null label are not used; without rows, and
    where a label never varies, a head is constant.
    """
    features = feature_table(train, num_features)
    _, idf = linear.document_frequencies(features, num_features)
    heads = two_heads(features, scheme, reg_param=reg_param, max_iter=max_iter, **kw)
    return TwoHeadModel(num_features, idf, linear.fit_heads(features, idf, heads, tol))


def predict_two_head(model: TwoHeadModel, df: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Score rows with a fitted model and apply M3."""
    return with_predictions(model.transform(df), scheme.n_categories)


# ---------------------------------------------------------------- M8
def best_check(log: DataFrame, run: str = "run_id", step: str = "step",
               score: str = "val_loss", mode: str = "min") -> DataFrame:
    """Checkpoint rule: the earliest check with the best score per run
    (strict improvement, no delta, no warm-up). One partial aggregate."""
    order = F.struct(F.col(score) if mode == "min" else -F.col(score), F.col(step))
    best = log.groupBy(run).agg(F.min_by(F.struct(step, score), order).alias("_b"),
                                F.count(F.lit(1)).alias("n_checks"))
    return best.select(run, "n_checks", F.col(f"_b.{step}").alias("best_step"),
                       F.col(f"_b.{score}").alias("best_score"))


def _improves(new, best, mode: str, min_delta: float):
    # a NaN on either side never improves (Spark alone orders NaN above all)
    real = ~F.isnan(new) & ~F.isnan(best)
    if mode == "min":
        return real & (new < best - F.lit(min_delta))
    if mode == "max":
        return real & (new > best + F.lit(min_delta))
    raise ValueError(f"mode must be 'min' or 'max', got {mode!r}")


def early_stop(log: DataFrame, patience: int = 10, min_delta: float = 0.001, warmup: int = 100,
               mode: str = "min", run: str = "run_id", step: str = "step",
               score: str = "val_loss", chunk: int = 4096, step_bucket: int = 1 << 16) -> DataFrame:
    """Early-stopping analysis of validation logs, exact (M8).

    Checks before ``warmup`` are ignored; the first counted check sets the
    best score; a later check improves if it beats the best by more than
    ``min_delta``; ``patience`` non-improving checks in a row stop the run.

    The sequential rule is evaluated without a per-run scan: (1) counted
    checks are numbered per run (bucketed dense positions); (2) each check
    finds the first improving check among the next ``patience`` ones with a
    sliding window over run chunks of ``chunk`` checks plus a halo of
    ``patience`` checks from the next chunk, so no window holds a whole run;
    (3) a pointer reaches at most ``patience`` checks ahead, so the chain of
    improvements enters a chunk only by its first ``patience`` checks: each
    chunk is folded once into the exits of these entries, and only this table,
    about ``rows * patience / chunk``, is followed by pointer doubling. The run
    stops ``patience`` checks after the chain's last element, if that check
    exists. Equal steps of a run count in the order of their scores.

    Output per run: ``n_checks`` (counted), ``best_step`` (0 when nothing
    beat the first counted check), ``best_score``, ``stop_step`` (null when
    the run never stops), ``stopped``.
    """
    chunk = max(chunk, patience)
    counted = log.where(F.col(step) >= warmup).select(run, step, score)
    numbered = dense_positions(materialise(counted, "early-stop-log"), [step, score],
                               F.floor(F.col(step) / step_bucket).cast("bigint"),
                               group=[run], out="k", refine=[F.col(step)])
    own = numbered.withColumn("_chunk", F.floor(F.col("k") / chunk)).withColumn("_halo", F.lit(False))
    halo = (numbered.where(F.col("k") % chunk < patience).where(F.col("k") >= chunk)
            .withColumn("_chunk", F.floor(F.col("k") / chunk) - 1).withColumn("_halo", F.lit(True)))
    # the frame holds at most ``patience`` checks; a window partition holds at
    # most ``chunk + patience`` checks, however long the run
    w = (Window.partitionBy(run, "_chunk").orderBy("k").rowsBetween(1, patience))
    ahead = own.unionByName(halo).withColumn("_next", F.collect_list(F.struct("k", score)).over(w))
    best_col = F.col(score)
    nxt = ahead.where(~F.col("_halo")).select(
        run, "k", step, score,
        F.try_element_at(F.filter("_next", lambda x: _improves(x[score], best_col, mode, min_delta)),
                         F.lit(1))["k"]
        .alias("_nxt"))
    # one materialisation of the successor table feeds every doubling round
    nxt = materialise(nxt, "early-stop")
    folded = (nxt.groupBy(run, F.floor(F.col("k") / chunk).alias("_chunk"))
              .agg(F.sort_array(F.collect_list(F.struct("k", "_nxt"))).alias("_a")))
    entry = F.filter(F.transform(F.slice("_a", 1, patience), lambda x: x["k"]),
                     lambda k: (F.col("_chunk") > 0) | (k == 0))
    exits = F.transform(entry, lambda e: F.struct(e.alias("k"), F.aggregate(
        "_a", e, lambda at, x: F.when(x["k"] == at, F.coalesce(x["_nxt"], at)).otherwise(at)).alias("_j")))
    nodes = materialise(folded.select(run, F.explode(exits).alias("_e")).select(run, "_e.k", "_e._j"), "early-stop-exits")
    longest = nodes.agg(F.max("k").alias("m")).first()["m"]
    rounds = math.ceil(math.log2((longest or 0) // chunk + 1))
    for _ in range(rounds):
        b = nodes.select(F.col(run).alias("_r"), F.col("k").alias("_k"), F.col("_j").alias("_jj"))
        nodes = materialise(
            nodes.join(b, (nodes[run] == b["_r"]) & (nodes["_j"] == b["_k"]), "left")
            .select(run, "k", F.coalesce("_jj", "_j").alias("_j")), "early-stop-round")
    last = nodes.where(F.col("k") == 0).select(run, F.col("_j").alias("_t"))
    stats = nxt.groupBy(run).agg(F.count(F.lit(1)).alias("n_checks"))
    at_t = nxt.select(run, F.col("k").alias("_t"), F.col(step).alias("_tstep"),
                           F.col(score).alias("best_score"))
    at_stop = nxt.select(run, F.col("k").alias("_s"), F.col(step).alias("stop_step"))
    out = (last.join(stats, run).join(at_t, [run, "_t"])
           .withColumn("_s", F.col("_t") + patience)
           .join(at_stop, [run, "_s"], "left"))
    return out.select(run, "n_checks",
                      F.when(F.col("_t") == 0, F.lit(0)).otherwise(F.col("_tstep"))
                      .cast("bigint").alias("best_step"),
                      "best_score", F.col("stop_step").cast("bigint").alias("stop_step"),
                      F.col("stop_step").isNotNull().alias("stopped"))


# ---------------------------------------------------------------- M9
_PARAM_NAMES = {"regParam": "reg_param", "maxIter": "max_iter", "numFeatures": "num_features"}


def grid_from_param_maps(param_maps) -> list[dict]:
    """``ParamGridBuilder().addGrid(lr.regParam, [...]).build()`` (with
    ``LogisticRegression`` / ``HashingTF`` params) -> keyword grid for
    ``trial_table``."""
    grid = []
    for pm in param_maps:
        point = {}
        for param, value in pm.items():
            if param.name not in _PARAM_NAMES:
                raise ValueError(f"unsupported parameter {param.name!r}; use {sorted(_PARAM_NAMES)}")
            point[_PARAM_NAMES[param.name]] = value
        grid.append(point)
    return grid


def trial_table(labelled: DataFrame, grid: Sequence[dict], key: str = "doc_id",
                sample: float = 0.2, held_out: float = 0.10, seed: int = 42,
                scheme: LabelScheme = DEFAULT_SCHEME, tol: float = 1e-3) -> DataFrame:
    """Fit M7 for every grid point (keywords of ``train_two_head``) on a seeded sample with a
    stratified split; rank trials by weighted category F1 on the held-out part (the
    reference's search maximises it).

    Both parts are tokenised once per distinct ``num_features``; the trials that share
    it share every pass of the fit, and all of them are scored in one pass and
    counted in one aggregate keyed by trial. Returns ``trial, <params>, n_train,
    n_held_out, converged, f1_weighted, f1_binary, rank``.
    """
    # the draw reads the rows three times, their plan runs once
    drawn = materialise(_spread(sample_frac(materialise(labelled, "trial-rows"), sample, key, seed)), "trial-sample")
    with_y = drawn.withColumn("_y", F.element_at("binary_labels", 2))
    split = stratified_split(with_y, "_y", held_out, key, seed).drop("_y")
    points = [{"num_features": 1 << 18, **g} for g in grid]
    scored = None
    for size in sorted({g["num_features"] for g in points}):
        trials = [i for i, g in enumerate(points) if g["num_features"] == size]
        features = feature_table(split, size, keep=["part"])
        train, test = (features.where(F.col("part") == p) for p in ("train", "held_out"))
        _, idf = linear.document_frequencies(train, size)
        counts = label_counts(train, scheme.n_categories)
        heads = [h for i in trials for h in two_heads(train, scheme, trial=i, counts=counts, **{k: v for k, v in points[i].items() if k != "num_features"})]
        fits = linear.fit_heads(train, idf, heads, tol)
        per = scheme.n_categories + 1
        models = [TwoHeadModel(size, idf, fits[k: k + per]) for k in range(0, len(fits), per)]
        told = _held_out_counts(test, models, trials, scheme)
        facts = labelled.sparkSession.createDataFrame(
            [(i, *[float(points[i].get(k, 0.0)) for k in sorted(grid[0])], counts["n"], all(f.converged for f in m.fits))
             for i, m in zip(trials, models)],
            "trial int, " + "".join(f"{k} double, " for k in sorted(grid[0])) + "n_train long, converged boolean")
        one = facts.join(told, "trial", "left")
        scored = one if scored is None else scored.unionByName(one)
    return scored.select("trial", *sorted(grid[0]), "n_train", F.coalesce("n_held_out", F.lit(0)).alias("n_held_out"), "converged",
                         F.coalesce("f1_weighted", F.lit(0.0)).alias("f1_weighted"), F.coalesce("f1_binary", F.lit(0.0)).alias("f1_binary")) \
        .withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1_weighted"), "trial")))  # a row per grid point


def _held_out_counts(test: DataFrame, models: Sequence[TwoHeadModel], trials: Sequence[int], scheme: LabelScheme) -> DataFrame:
    """``trial, n_held_out, f1_weighted, f1_binary``: margins of all models in one pass, one aggregate keyed by trial."""
    per = scheme.n_categories + 1
    m = linear.margin_column(test.sparkSession, "slots", models[0].idf, np.concatenate([x.weights() for x in models]))
    one = F.transform(F.sequence(F.lit(0), F.lit(len(models) - 1)), lambda k: F.slice("_m", k * per + 1, per))
    rows = test.select("y_bin", "y_cat", m.alias("_m")).select("y_bin", "y_cat", F.posexplode(one).alias("_t", "_l"))
    rows = rows.select(F.element_at(F.array(*[F.lit(i) for i in trials]), F.col("_t") + 1).alias("trial"),
                       F.col("y_bin").cast("int").alias("y_bin"), F.col("y_cat").cast("array<int>").alias("y_cat"),
                       F.array(F.lit(0.0), F.element_at("_l", 1)).alias("binary_logits"), F.slice("_l", 2, per - 1).alias("category_logits"))
    pred = with_predictions(rows, scheme.n_categories)
    return M.f1_by_group(pred, "trial", scheme.n_categories).withColumnRenamed("n_rows", "n_held_out")
