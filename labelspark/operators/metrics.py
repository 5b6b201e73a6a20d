"""Class weights, losses, F1 and the hierarchical ICM measure.

Every metric is one grouped (or global) aggregate with partial aggregation;
per-label figures come from conditional sums in the same pass and are then
unpivoted. Global constants (ICM priors, class weights) travel as one-row
scalar subqueries, evaluated once and inlined, never as driver values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.arrays import as_col
from labelspark.functions.losses import array_mean, focal_bce, focal_ce
from labelspark.functions.predict import at_least, union_labels
from labelspark.scheme import DEFAULT_SCHEME


def _unpivot(row: DataFrame, entries: list[tuple[dict, dict]]) -> DataFrame:
    """One-row frame -> long frame; each entry is (literal fields, column fields)."""
    structs = []
    for lits, cols in entries:
        structs.append(F.struct(*[F.lit(v).alias(k) for k, v in lits.items()],
                                *[c.alias(k) for k, c in cols.items()]))
    return row.select(F.explode(F.array(*structs)).alias("_e")).select("_e.*")


# ------------------------------------------------------------ class weights
def class_weights(df: DataFrame, label_col: str, names: Sequence[str], level: int) -> DataFrame:
    """Per-label weight ``neg / pos``, or ``neg`` when ``pos = 0`` (A4).

    Output: ``level, label_index, label, pos, weight``; one aggregate.
    """
    n = len(names)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.coalesce(F.sum(F.element_at(label_col, i + 1)), F.lit(0)).cast("bigint")
                   .alias(f"_p{i}") for i in range(n)])
    entries = []
    for i, name in enumerate(names):
        pos = F.col(f"_p{i}")
        neg = F.col("_n") - pos
        w = F.when(pos > 0, neg / pos).otherwise(neg.cast("double"))
        entries.append(({"level": level, "label_index": i, "label": name},
                        {"pos": pos, "weight": w}))
    return _unpivot(agg, entries)


def weights_vector(weights_long: DataFrame) -> Column:
    """Long class-weight frame (one row per label) -> ``array<double>``
    scalar subquery column."""
    arr = weights_long.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("label_index", "weight"))),
        lambda s: s["weight"]).alias("w"))
    return arr.scalar()


# ------------------------------------------------------------------ losses
def loss_columns(b: Column, y_bin: Column, c: Column, y_cat: Column,
                 gamma_binary: float = 1.0, gamma_category: float = 2.0,
                 binary_weights: Column | None = None,
                 category_weights: Column | None = None) -> tuple[Column, Column]:
    """Per-row binary focal loss and mean category focal loss."""
    lb = focal_ce(b, y_bin, binary_weights, gamma_binary)
    lc = array_mean(focal_bce(c, y_cat, category_weights, gamma_category))
    return lb, lc


def loss_aggs(lb: Column, lc: Column, y_bin: Column, lambda_binary: float = 1.0,
              lambda_category: float = 1.0) -> list[Column]:
    """Total loss of a set of rows (A5): mean binary loss; category loss
    averaged over YES rows only (divided by ``max(#YES, 1)``); weighted sum."""
    loss_b = F.avg(lb)
    loss_c = F.sum(lc * y_bin) / F.greatest(F.sum(y_bin), F.lit(1))
    return [(F.lit(lambda_binary) * loss_b + F.lit(lambda_category) * loss_c).alias("loss"),
            loss_b.alias("loss_binary"), loss_c.alias("loss_category")]


def loss_summary(df: DataFrame, **kw) -> DataFrame:
    """One row ``loss, loss_binary, loss_category`` over all rows of an
    evaluation frame (``b, y_bin, c, y_cat`` columns)."""
    lam_b = kw.pop("lambda_binary", 1.0)
    lam_c = kw.pop("lambda_category", 1.0)
    lb, lc = loss_columns(F.col("b"), F.col("y_bin"), F.col("c"), F.col("y_cat"), **kw)
    rows = df.select(lb.alias("_lb"), lc.alias("_lc"), F.col("y_bin"))
    return rows.agg(*loss_aggs(F.col("_lb"), F.col("_lc"), F.col("y_bin"), lam_b, lam_c))


def loss_by_batch(df: DataFrame, batch_col: str = "batch_id", **kw) -> DataFrame:
    """Mean of per-batch losses (A6), as the reference reports evaluation loss."""
    lam_b = kw.pop("lambda_binary", 1.0)
    lam_c = kw.pop("lambda_category", 1.0)
    lb, lc = loss_columns(F.col("b"), F.col("y_bin"), F.col("c"), F.col("y_cat"), **kw)
    rows = df.select(batch_col, lb.alias("_lb"), lc.alias("_lc"), F.col("y_bin"))
    per_batch = rows.groupBy(batch_col).agg(
        *loss_aggs(F.col("_lb"), F.col("_lc"), F.col("y_bin"), lam_b, lam_c))
    return per_batch.agg(F.avg("loss").alias("loss"), F.avg("loss_binary").alias("loss_binary"),
                         F.avg("loss_category").alias("loss_category"),
                         F.count(F.lit(1)).alias("n_batches"))


# ---------------------------------------------------------------------- F1
def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    den = F.lit(2) * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((F.lit(2.0) * tp) / den)


def f1_binary(df: DataFrame, gold: str = "y_bin", prob: str = "pred_binary_prob",
              threshold: float = 0.5) -> DataFrame:
    """Binary F1 with YES at ``prob >= threshold`` (A7); one row."""
    p = at_least(F.col(prob), threshold).cast("int")
    g = F.col(gold)
    agg = df.agg(F.count_if((p == 1) & (g == 1)).alias("tp"),
                 F.count_if((p == 1) & (g == 0)).alias("fp"),
                 F.count_if((p == 0) & (g == 1)).alias("fn"))
    return agg.select("tp", "fp", "fn", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def confusion_columns(gold: str, pred: str, n: int) -> list[Column]:
    """Aggregates ``tp{i}``, ``fp{i}``, ``fn{i}`` of every label."""
    aggs = []
    for i in range(n):
        g = F.element_at(gold, i + 1)
        p = F.element_at(pred, i + 1)
        aggs += [F.count_if((g == 1) & (p == 1)).alias(f"tp{i}"),
                 F.count_if((g != 1) & (p == 1)).alias(f"fp{i}"),
                 F.count_if((g == 1) & (p != 1)).alias(f"fn{i}")]
    return aggs


def label_confusion(df: DataFrame, gold: str, pred: str, n: int) -> DataFrame:
    """One row of tp/fp/fn/support per label, all from one pass."""
    return df.agg(*confusion_columns(gold, pred, n))


def f1_by_group(df: DataFrame, group: str, n: int, gold: str = "y_cat", pred: str = "pred_category",
                gold_binary: str = "y_bin", pred_binary: str = "pred_binary") -> DataFrame:
    """Support-weighted category F1 and binary F1 of every group, from one aggregate:
    ``<group>, n_rows, f1_weighted, f1_binary``."""
    g, p = F.col(gold_binary), F.col(pred_binary)
    conf = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), *confusion_columns(gold, pred, n), F.count_if((p == 1) & (g == 1)).alias("tp"),
        F.count_if((p == 1) & (g == 0)).alias("fp"), F.count_if((p == 0) & (g == 1)).alias("fn"))
    parts = [(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")) for i in range(n)]
    support = sum((tp + fn for tp, _, fn in parts), F.lit(0))
    gain = sum((_f1(tp, fp, fn) * (tp + fn) for tp, fp, fn in parts), F.lit(0.0))
    return conf.select(group, "n_rows", F.when(support == 0, F.lit(0.0)).otherwise(gain / support).alias("f1_weighted"),
                       _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1_binary"))


def f1_per_label(df: DataFrame, gold: str = "y_cat", pred: str = "pred_category",
                 names: Sequence[str] = DEFAULT_SCHEME.level2) -> DataFrame:
    """Per-label F1 (A8): ``label_index, label, tp, fp, fn, support, f1``."""
    conf = label_confusion(df, gold, pred, len(names))
    entries = []
    for i, name in enumerate(names):
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        entries.append(({"label_index": i, "label": name},
                        {"tp": tp, "fp": fp, "fn": fn, "support": tp + fn, "f1": _f1(tp, fp, fn)}))
    return _unpivot(conf, entries)


def f1_macro(per_label: DataFrame) -> DataFrame:
    """Unweighted mean over all labels, unsupported ones included."""
    return per_label.agg(F.avg("f1").alias("f1_macro"))


def f1_weighted(per_label: DataFrame) -> DataFrame:
    """Support-weighted mean of per-label F1 (A10); 0 when no support."""
    s = F.sum("support")
    return per_label.agg(F.when(s == 0, F.lit(0.0))
                         .otherwise(F.sum(F.col("f1") * F.col("support")) / s).alias("f1_weighted"))


# --------------------------------------------------------------------- ICM
def icm_priors(gold_df: DataFrame, gold: str = "y_cat", n: int = 6) -> DataFrame:
    """Label priors with ``+1/N`` smoothing, the parent ("any label 1..n-1")
    and the root (1.0), one row: ``p0..p{n-1}, p_parent, p_root, n_rows`` (A11)."""
    N = F.count(F.lit(1))
    aggs = [(F.count_if(F.element_at(gold, i + 1) == 1) / N + F.lit(1.0) / N).alias(f"p{i}")
            for i in range(n)]
    any_cat = F.exists(F.slice(F.col(gold), 2, n - 1), lambda x: x == 1)
    aggs.append((F.count_if(any_cat) / N + F.lit(1.0) / N).alias("p_parent"))
    aggs.append(F.lit(1.0).alias("p_root"))
    aggs.append(N.alias("n_rows"))
    return gold_df.agg(*aggs)


def node_ic(gold_df: DataFrame, gold: str = "y_cat", n: int = 6) -> Column:
    """Information content ``-log2 p`` of every tree node as one struct
    (``ic0..``, ``ic_parent``), a scalar subquery evaluated once."""
    pr = icm_priors(gold_df, gold, n)
    ic = pr.select(F.struct(*[(-F.log2(F.col(f"p{i}"))).alias(f"ic{i}") for i in range(n)],
                            (-F.log2(F.col("p_parent"))).alias("ic_parent")).alias("ic"))
    return ic.scalar()


def with_node_ic(df: DataFrame, gold: str = "y_cat", n: int = 6, out: str = "_ic") -> DataFrame:
    """Attach the node IC struct as a column (one subquery reference, so
    the prior pass runs once however many IC terms use it)."""
    return df.withColumn(out, node_ic(df, gold, n))


def information_content(labels: Column | str, ic: Column, n: int = 6) -> Column:
    """IC of a label set on the tree root -> label 0, root -> parent -> 1..n-1.

    ``ic`` is the node IC struct of ``node_ic``. Closed form of the
    reference recursion: the sum of node ICs over the set, less
    ``ic_parent`` once for every category label after the first. The empty
    set has IC 0.
    """
    lab = as_col(labels)
    total = None
    for i in range(n):
        term = F.when(F.element_at(lab, i + 1) == 1, ic[f"ic{i}"]).otherwise(F.lit(0.0))
        total = term if total is None else total + term
    n_cat = F.size(F.filter(F.slice(lab, 2, n - 1), lambda x: x == 1))
    return total - F.greatest(n_cat - 1, F.lit(0)) * ic["ic_parent"]


def icm_row_cols(gold: Column, preds: dict[str, Column], n: int = 6) -> list[Column]:
    """Per-row label indicators ICM is summed from (scalar columns, so the
    aggregate itself stays small): gold labels ``_g<i>``, whether any
    category is set ``_gpar``, the parent corrections ``_xg`` / ``_xp_*`` /
    ``_xu_*``, and per prediction its labels ``_p_*_<i>`` and the union with
    gold ``_u_*_<i>``."""
    def ind(arr, i):
        return (F.element_at(arr, i + 1) == 1).cast("int")

    def extra(cols):
        return F.greatest(sum(cols[2:], cols[1]) - 1, F.lit(0))

    g = [ind(gold, i) for i in range(n)]
    out = [c.alias(f"_g{i}") for i, c in enumerate(g)]
    out += [F.greatest(*g[1:]).alias("_gpar"), extra(g).alias("_xg")]
    for name, pred in preds.items():
        p = [ind(pred, i) for i in range(n)]
        u = [ind(union_labels(gold, pred, n), i) for i in range(n)]
        out += [c.alias(f"_p_{name}_{i}") for i, c in enumerate(p)]
        out += [c.alias(f"_u_{name}_{i}") for i, c in enumerate(u)]
        out += [extra(p).alias(f"_xp_{name}"), extra(u).alias(f"_xu_{name}")]
    return out


def icm_aggs(names, n: int = 6) -> list[Column]:
    """Sums over ``icm_row_cols`` from which ICM follows without a second
    pass.

    IC of a set is linear in the node ICs, so the mean ICM term is a linear
    combination of label frequencies: the priors (gold frequencies) and,
    per prediction, the frequencies of predicted and union labels and the
    mean parent correction.
    """
    cols = ["_gpar", "_xg"] + [f"_g{i}" for i in range(n)]
    for name in names:
        cols += [f"_p_{name}_{i}" for i in range(n)] + [f"_u_{name}_{i}" for i in range(n)]
        cols += [f"_xp_{name}", f"_xu_{name}"]
    return [F.count(F.lit(1)).alias("_N")] + [F.sum(c).alias(c) for c in cols]


def icm_from_sums(name: str, n: int = 6) -> Column:
    """ICM of prediction ``name`` from the one-row ``icm_sums`` result."""
    N = F.col("_N").cast("double")
    ic = [-F.log2(F.col(f"_g{i}") / N + F.lit(1.0) / N) for i in range(n)]
    ic_parent = -F.log2(F.col("_gpar") / N + F.lit(1.0) / N)
    total = None
    for i in range(n):
        term = ic[i] * (F.lit(2.0) * F.col(f"_g{i}") + F.lit(2.0) * F.col(f"_p_{name}_{i}")
                        - F.lit(3.0) * F.col(f"_u_{name}_{i}"))
        total = term if total is None else total + term
    total = total - ic_parent * (F.lit(2.0) * F.col("_xg") + F.lit(2.0) * F.col(f"_xp_{name}")
                                 - F.lit(3.0) * F.col(f"_xu_{name}"))
    return total / N


def icm(df: DataFrame, gold: str = "y_cat", pred: str = "pred_category", n: int = 6) -> DataFrame:
    """ICM of predictions against gold (A13), one pass; priors from gold."""
    rows = df.select(*icm_row_cols(F.col(gold), {"pred": F.col(pred)}, n))
    return rows.agg(*icm_aggs(["pred"], n)).select(icm_from_sums("pred", n).alias("icm"))


MINORITY_VECTOR = (0, 0, 0, 0, 1, 0)


def icm_baselines(df: DataFrame, gold: str = "y_cat", pred: str = "pred_category", n: int = 6,
                  minority: Sequence[int] = MINORITY_VECTOR) -> DataFrame:
    """ICM of the gold labels themselves, all-negative, one fixed category
    vector and the predictions, in one pass (A14): ``prediction, icm``."""
    g = F.col(gold)
    majority = F.array(F.lit(1), *[F.lit(0) for _ in range(n - 1)])
    minor = F.array(*[F.lit(int(v)) for v in minority])
    preds = {"gold": g, "majority": majority, "minority": minor, "predicted": F.col(pred)}
    row = df.select(*icm_row_cols(g, preds, n)).agg(*icm_aggs(list(preds), n))
    return _unpivot(row, [({"prediction": k}, {"icm": icm_from_sums(k, n)}) for k in preds])
