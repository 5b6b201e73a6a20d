"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import textops as tx


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # from the larger end only
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    seen = both.join(least, "a")
    if large:  # only the larger neighbours are linked anew
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it is connected with.

    ``edges``: columns a, b. Each round is written to the shared folder; rounds
    grow with the logarithm of the longest path. Stars are pre-aggregated, so a
    node with very many edges is combined before it is shuffled.
    """
    now = tx.settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        after = tx.settle(_star(_star(now, True), False), "edges")
        changed = after.select("a", "b").exceptAll(now.select("a", "b")).limit(1).count()
        changed = changed or now.select("a", "b").exceptAll(after.select("a", "b")).limit(1).count()
        now = after
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
