"""Annotator votes to consensus labels (level 1 binary, level 2 multi-label).

Votes arrive in long form, one row per (item, annotator, label); level-2
votes may hold several labels per annotator (the flattened vote list). All
counting is one grouped aggregate per item with partial aggregation, so a
hot item is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.scheme import (DEFAULT_SCHEME, STATUS_NO_MAJORITY, STATUS_OK, STATUS_TIE,
                               LabelScheme)


def count_col(level: int, index: int) -> str:
    return f"n{level}_{index}"


def flatten_votes(nested: DataFrame, item: str = "doc_id", votes: str = "votes",
                  annotator: str = "annotator") -> DataFrame:
    """Per-item ``array<array<string>>`` of votes to long form (F2).

    ``posexplode`` keeps the annotator position, a second ``explode`` yields
    one row per label.
    """
    outer = nested.select(item, F.posexplode(votes).alias(annotator, "_labels"))
    return outer.select(item, annotator, F.explode("_labels").alias("label"))


def vote_counts(votes1: DataFrame | None, votes2: DataFrame | None,
                scheme: LabelScheme = DEFAULT_SCHEME, item: str = "doc_id",
                label: str = "label") -> DataFrame:
    """Votes per scheme label per item, both levels in one aggregate (A1).

    Output: ``item``, ``n1_<i>`` for level-1 labels, ``n2_<i>`` for level-2
    labels, and ``votes1`` / ``votes2`` (vote rows per level, 0 when the
    item has no votes at that level). Labels outside the scheme count only
    toward the per-level totals.
    """
    parts = []
    if votes1 is not None:
        parts.append(votes1.select(item, F.lit(1).alias("_lvl"), F.col(label).alias("_lab")))
    if votes2 is not None:
        parts.append(votes2.select(item, F.lit(2).alias("_lvl"), F.col(label).alias("_lab")))
    if not parts:
        raise ValueError("at least one vote table is needed")
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    aggs = []
    for lvl in (1, 2):
        for i, name in enumerate(scheme.labels(lvl)):
            aggs.append(F.count_if((F.col("_lvl") == lvl) & (F.col("_lab") == name))
                        .cast("bigint").alias(count_col(lvl, i)))
        aggs.append(F.count_if(F.col("_lvl") == lvl).cast("bigint").alias(f"votes{lvl}"))
    return long.groupBy(item).agg(*aggs)


def _one_hot(n: int, index: int) -> Column:
    return F.array(*[F.lit(1 if i == index else 0) for i in range(n)])


def consensus_level1(counts: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> tuple[Column, Column]:
    """Level-1 rule (A2): NO count == tie -> tie, > tie -> NO, else YES."""
    no = F.col(count_col(1, 0))
    n = len(scheme.level1)
    labels = (F.when(no == scheme.tie_votes, F.lit(None))
              .when(no > scheme.tie_votes, _one_hot(n, 0))
              .otherwise(_one_hot(n, 1)))
    status = F.when(no == scheme.tie_votes, STATUS_TIE).otherwise(STATUS_OK)
    return labels, status


def consensus_level2(counts: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> tuple[Column, Column]:
    """Level-2 rule (A3): ``-`` count == tie -> tie, > tie -> ``-`` only,
    else every known label with at least ``min_category_votes`` votes; no
    such label -> no majority. The ``-`` slot is 0 in the multi-label branch."""
    dash = F.col(count_col(2, 0))
    n = scheme.n_categories
    multi = F.array(F.lit(0), *[(F.col(count_col(2, i)) >= scheme.min_category_votes).cast("int")
                               for i in range(1, n)])
    any_label = F.greatest(*[F.col(count_col(2, i)) for i in range(1, n)]) >= scheme.min_category_votes
    labels = (F.when(dash == scheme.tie_votes, F.lit(None))
              .when(dash > scheme.tie_votes, _one_hot(n, 0))
              .when(any_label, multi))
    status = (F.when(dash == scheme.tie_votes, STATUS_TIE)
              .when(dash > scheme.tie_votes, STATUS_OK)
              .when(any_label, STATUS_OK).otherwise(STATUS_NO_MAJORITY))
    return labels, status


def consensus(votes1: DataFrame, votes2: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
              item: str = "doc_id") -> DataFrame:
    """Both consensus levels per item, one shuffle on the item id.

    Output: ``item``, ``binary_labels array<int>``, ``binary_status``,
    ``category_labels array<int>``, ``category_status``. Items with no vote at
    a level have null labels and status ``missing`` at that level (the
    reference drops rows whose vote list is missing).
    """
    counts = vote_counts(votes1, votes2, scheme, item=item)
    b_lab, b_status = consensus_level1(counts, scheme)
    c_lab, c_status = consensus_level2(counts, scheme)
    has1 = F.col("votes1") > 0
    has2 = F.col("votes2") > 0
    return counts.select(
        item,
        F.when(has1, b_lab).alias("binary_labels"),
        F.when(has1, b_status).otherwise("missing").alias("binary_status"),
        F.when(has2, c_lab).alias("category_labels"),
        F.when(has2, c_status).otherwise("missing").alias("category_status"))


def filter_split(df: DataFrame, split: str, multilingual: bool = False,
                 scheme: LabelScheme = DEFAULT_SCHEME, col: str = "split") -> DataFrame:
    """Choose a split (P1): ``train`` / ``test`` map to split values, any other
    value keeps every row. The ``isin`` predicate reaches the parquet scan."""
    values = scheme.split_values(split, multilingual)
    if values is None:
        return df
    return df.where(F.col(col).isin(*values))


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def drop_undecided(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep rows decided at both levels (P4) and report what was dropped.

    Report (one row): ``binary_ties`` counts rows not ``ok`` at level 1;
    ``category_ties`` counts rows not ``ok`` at level 2 among those that
    survived the level-1 drop (the reference drops binary first).
    """
    b_ok = F.col("binary_status") == STATUS_OK
    c_ok = F.col("category_status") == STATUS_OK
    kept = df.where(b_ok & c_ok)
    report = df.agg(F.count(F.lit(1)).alias("rows_in"),
                    F.count_if(~b_ok).cast("bigint").alias("binary_ties"),
                    F.count_if(b_ok & ~c_ok).cast("bigint").alias("category_ties"),
                    F.count_if(b_ok & c_ok).cast("bigint").alias("rows_kept"))
    return kept, report
