"""Information contrast (A11-A13) over any declared label tree.

``metrics.icm`` knows the two-level tree of the label scheme. Here the tree is a
parameter, of any depth. A label set stands for its labels and all their ancestors, its
closure, and its information content is the sum over the closure of what each node adds to
its parent, ``ic(node) - ic(parent)`` with ``ic(root) = 0``. That sum equals the recursive
definition over lowest common ancestors and is linear in closure flags, so the mean over all
rows follows from three counts a node (gold, predicted, union), taken in one aggregate.

Closures are built inside the row from the declared tree (a literal of the plan: labels times
depth, not data), so nothing but partial counts by node crosses a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.functions.arrays import as_col
from labelspark.session import materialise


@dataclass(frozen=True)
class LabelTree:
    """A label hierarchy: every label with its parent, ``None`` directly below the root.

    A parent that is no label of the tree, a label that is its own ancestor and an empty tree
    raise ``ValueError``.
    """

    parents: Mapping[str, str | None]

    def __post_init__(self):
        if not self.parents:
            raise ValueError("a label tree needs at least one label")
        for label, parent in self.parents.items():
            if parent is not None and parent not in self.parents:
                raise ValueError(f"the parent {parent!r} of {label!r} is no label of the tree")
        for label in self.parents:
            self.path(label)

    def path(self, label: str) -> list[str]:
        """The label and its ancestors, nearest first."""
        out: list[str] = []
        at: str | None = label
        while at is not None:
            if at in out:
                raise ValueError(f"{label!r} is its own ancestor")
            out.append(at)
            at = self.parents[at]
        return out

    def closure_table(self, spark: SparkSession) -> DataFrame:
        """``label, node``: every label with itself and each of its ancestors."""
        rows = [(label, node) for label in self.parents for node in self.path(label)]
        return spark.createDataFrame(rows, "label string, node string")

    def node_table(self, spark: SparkSession) -> DataFrame:
        """``node, parent``."""
        return spark.createDataFrame(list(self.parents.items()), "node string, parent string")


def closed(labels: Column | str, tree: LabelTree) -> Column:
    """The distinct nodes of a label set's closure. Null and repeated labels, labels that the tree
    does not hold and a null set add nothing."""
    paths = F.create_map(*[x for label in tree.parents
                           for x in (F.lit(label), F.array(*[F.lit(n) for n in tree.path(label)]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(
        F.coalesce(as_col(labels), none), lambda x: F.coalesce(F.try_element_at(paths, x), none))))


def node_counts(df: DataFrame, tree: LabelTree, gold: str, preds: Mapping[str, Column | str]) -> DataFrame:
    """``node, g, p_<name>, u_<name>``: rows whose gold, predicted and united closure hold the node.
    The row of the null node, the root, counts all rows; nodes that never occur are absent."""
    sets = {"_g": closed(gold, tree), **{f"_p{k}": closed(c, tree) for k, c in enumerate(preds.values())}}
    rows = df.select(*[c.alias(name) for name, c in sets.items()])
    nodes = F.array_distinct(F.concat(*sets)) if len(sets) > 1 else F.col("_g")
    each = rows.select(*sets, F.explode(F.array_append(nodes, F.lit(None).cast("string"))).alias("node"))

    def holds(name):
        return F.col("node").isNull() | F.array_contains(name, F.col("node"))

    aggs = [F.count_if(holds("_g")).alias("g")]
    for k, name in enumerate(preds):
        aggs += [F.count_if(holds(f"_p{k}")).alias(f"p_{name}"),
                 F.count_if(holds("_g") | holds(f"_p{k}")).alias(f"u_{name}")]
    return each.groupBy("node").agg(*aggs)


def _priced(counts: DataFrame, tree: LabelTree) -> DataFrame:
    """All nodes of the tree with their counts, smoothed prior, ``ic`` and ``delta``.

    ``counts`` is a stored table of at most one row a node.
    """
    figures = [c for c in counts.columns if c != "node"]
    rows = F.nullif(counts.where("node IS NULL").agg(F.max("g").alias("n")).scalar(), F.lit(0))
    all_nodes = (tree.node_table(counts.sparkSession).join(counts, "node", "left")
                 .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in figures})
                 .withColumn("n_rows", rows)
                 .withColumn("prior", F.col("g") / F.col("n_rows") + F.lit(1.0) / F.col("n_rows"))
                 .withColumn("ic", -F.log2("prior")))
    above = all_nodes.select(F.col("node").alias("parent"), F.col("ic").alias("_up"))
    return (all_nodes.join(above, "parent", "left")
            .withColumn("delta", F.col("ic") - F.coalesce("_up", F.lit(0.0))).drop("_up"))



def tree_priors(df: DataFrame, tree: LabelTree, gold: str = "labels") -> DataFrame:
    """Node statistics (A11): ``node, parent, g`` (rows with the node in their gold closure),
    ``n_rows, prior`` (``g / n_rows + 1 / n_rows``), ``ic, delta``. Without rows the last four are null."""
    counts = materialise(node_counts(df, tree, gold, {}), "tree-counts")
    return _priced(counts, tree).select("node", "parent", "g", "n_rows", "prior", "ic", "delta")


def deltas(priors: DataFrame) -> Column:
    """``tree_priors`` as one map, a scalar subquery that every row refers to."""
    return priors.agg(F.map_from_entries(F.collect_list(F.struct("node", "delta"))).alias("m")).scalar()


def tree_ic(labels: Column | str, tree: LabelTree, delta: Column) -> Column:
    """Information content of a label set (A12); 0 for a set without labels of the tree.
    ``delta`` is a column that holds ``deltas``."""
    return F.aggregate(closed(labels, tree), F.lit(0.0), lambda acc, x: acc + F.try_element_at(delta, x))


def tree_icm(df: DataFrame, tree: LabelTree, gold: str, preds: Mapping[str, Column | str]) -> DataFrame:
    """ICM of one or more predictions (columns of label names) against gold (A13), priors from gold:
    ``prediction, icm``. One pass over the rows for all predictions; null without rows."""
    nodes = _priced(materialise(node_counts(df, tree, gold, preds), "tree-counts"), tree)
    terms = [F.sum(F.col("delta") * (2 * F.col("g") + 2 * F.col(f"p_{name}") - 3 * F.col(f"u_{name}")) / F.col("n_rows"))
             .alias(f"_{k}") for k, name in enumerate(preds)]
    each = F.array(*[F.struct(F.lit(name).alias("prediction"), F.col(f"_{k}").alias("icm")) for k, name in enumerate(preds)])
    return nodes.agg(*terms).select(F.explode(each).alias("r")).select("r.*")
