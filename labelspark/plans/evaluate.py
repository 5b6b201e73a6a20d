"""Evaluation (M3, M4): gold labels joined to model logits, predictions,
and a long report of losses, F1 and ICM computed in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.predict import predict
from labelspark.operators import metrics as M
from labelspark.scheme import DEFAULT_SCHEME, LabelScheme

LOGIT_COLS = ("b0", "b1", "c0", "c1", "c2", "c3", "c4", "c5")


def logits_arrays(scores: DataFrame, key: str = "doc_id", n: int = 6) -> DataFrame:
    """Flat logit columns ``b0, b1, c0..`` -> ``b``, ``c`` arrays."""
    return scores.select(key, F.array("b0", "b1").alias("b"),
                         F.array(*[f"c{i}" for i in range(n)]).alias("c"))


def predict_labels(logits: DataFrame, n: int = 6, threshold: float = 0.5) -> DataFrame:
    """Add the four prediction columns to a frame with ``b`` and ``c`` arrays."""
    cols = predict(F.element_at("b", 1), F.element_at("b", 2), F.col("c"), n, threshold)
    return logits.select("*", *[c.alias(k) for k, c in cols.items()])


def evaluation_frame(gold: DataFrame, scores: DataFrame, key: str = "doc_id",
                     n: int = 6) -> DataFrame:
    """Gold (``binary_labels``, ``category_labels``) joined to logits on the
    key, with predictions: ``y_bin``, ``y_cat``, ``b``, ``c`` and M3 columns."""
    g = gold.select(key, (F.element_at("binary_labels", 2) == 1).cast("int").alias("y_bin"),
                    F.col("category_labels").alias("y_cat"))
    return predict_labels(g.join(logits_arrays(scores, key, n), key), n)


def evaluation_report(ev: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
                      gamma_binary: float = 1.0, gamma_category: float = 2.0) -> DataFrame:
    """Long report ``metric, label, value`` (M4).

    One aggregate holds the loss sums, the binary and per-label confusion
    counts and the label frequencies ICM needs (IC is linear in the node
    ICs, so the priors need no earlier pass). Everything else is arithmetic
    on that one row.
    """
    n = scheme.n_categories
    lb, lc = M.loss_columns(F.col("b"), F.col("y_bin"), F.col("c"), F.col("y_cat"),
                            gamma_binary, gamma_category)
    g, p = F.col("y_cat"), F.col("pred_category")
    majority = F.array(F.lit(1), *[F.lit(0) for _ in range(n - 1)])
    minority = F.array(*[F.lit(v) for v in M.MINORITY_VECTOR])
    preds = {"predicted": p, "gold": g, "majority": majority, "minority": minority}
    # per-row values first, so the one aggregate sums plain columns
    rows = ev.select(lb.alias("_lb"), lc.alias("_lc"), F.col("y_bin"), F.col("pred_binary"),
                     *[(F.element_at(g, i + 1) == 1).alias(f"_gi{i}") for i in range(n)],
                     *[(F.element_at(p, i + 1) == 1).alias(f"_pi{i}") for i in range(n)],
                     *M.icm_row_cols(g, preds, n))
    pb, yb = F.col("pred_binary"), F.col("y_bin")
    aggs = M.loss_aggs(F.col("_lb"), F.col("_lc"), yb) + [
        F.count_if((pb == 1) & (yb == 1)).alias("btp"),
        F.count_if((pb == 1) & (yb == 0)).alias("bfp"),
        F.count_if((pb == 0) & (yb == 1)).alias("bfn"),
    ] + M.icm_aggs(list(preds), n)
    for i in range(n):
        gi, pi = F.col(f"_gi{i}"), F.col(f"_pi{i}")
        aggs += [F.count_if(gi & pi).alias(f"tp{i}"),
                 F.count_if(~gi & pi).alias(f"fp{i}"),
                 F.count_if(gi & ~pi).alias(f"fn{i}")]
    row = rows.agg(*aggs)
    f1s = [M._f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")) for i in range(n)]
    sup = [F.col(f"tp{i}") + F.col(f"fn{i}") for i in range(n)]
    total_sup = sum(sup[1:], sup[0])
    weighted = F.when(total_sup == 0, F.lit(0.0)).otherwise(
        sum([f * s for f, s in zip(f1s[1:], sup[1:])], f1s[0] * sup[0]) / total_sup)
    entries = [({"metric": "loss", "label": "all"}, {"value": F.col("loss")}),
               ({"metric": "loss_binary", "label": "all"}, {"value": F.col("loss_binary")}),
               ({"metric": "loss_category", "label": "all"}, {"value": F.col("loss_category")}),
               ({"metric": "f1_binary", "label": "YES"},
                {"value": M._f1(F.col("btp"), F.col("bfp"), F.col("bfn"))})]
    entries += [({"metric": "f1", "label": name}, {"value": f1s[i]})
                for i, name in enumerate(scheme.level2)]
    entries += [({"metric": "f1_macro", "label": "all"}, {"value": sum(f1s[1:], f1s[0]) / n}),
                ({"metric": "f1_weighted", "label": "all"}, {"value": weighted})]
    entries += [({"metric": f"icm_{k}", "label": "all"}, {"value": M.icm_from_sums(k, n)})
                for k in ("predicted", "gold", "majority", "minority")]
    return M._unpivot(row, entries)
