"""Prepare a labelled dataset (M1): split filter, column harmonising,
consensus at both levels, optional cleaning, undecided rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.text import clean_text
from labelspark.operators.consensus import consensus, drop_undecided, filter_split
from labelspark.scheme import DEFAULT_SCHEME, LabelScheme


def prepare_labels(posts: DataFrame, votes1: DataFrame, votes2: DataFrame,
                   split: str = "train", multilingual: bool = False, clean: bool = False,
                   scheme: LabelScheme = DEFAULT_SCHEME, item: str = "doc_id",
                   text_col: str = "tweet", remove_undecided: bool = True):
    """Return ``(labelled, report)``.

    ``labelled``: ``item``, ``text``, ``binary_labels``, ``category_labels``
    (plus the two status columns when ``remove_undecided`` is off).
    ``report``: the one-row drop report of ``drop_undecided``.

    Plan: the split predicate is pushed to the posts scan; votes of both
    levels are counted in one aggregate keyed by item (one shuffle), joined
    to the filtered posts on the item id. Posts without votes drop out of
    the inner join, as rows with a missing vote list do in the reference.
    """
    p = filter_split(posts, split, multilingual, scheme)
    p = p.select(item, F.col(text_col).alias("text"))
    labels = consensus(votes1, votes2, scheme, item=item).where(
        (F.col("binary_status") != "missing") & (F.col("category_status") != "missing"))
    joined = p.join(labels, item)
    if clean:
        joined = joined.withColumn("text", clean_text("text"))
    if not remove_undecided:
        return joined, None
    kept, report = drop_undecided(joined)
    return kept.drop("binary_status", "category_status"), report


def load_processed_data(spark, path: str, split: str = "train", multilingual: bool = False,
                        clean: bool = False, dataset: str = "EXIST", remove_undecided: bool = True,
                        multi_line: bool = False):
    """Annotated file -> labelled rows, as the reference's loader does:
    read (by extension), split filter, consensus, optional cleaning, drop
    undecided. Returns ``(labelled, report)`` keyed by the source ``id``.
    ``multi_line``: CSV fields may hold line ends (one task per file)."""
    from labelspark.scheme import scheme_for
    from labelspark.sources.annotated import annotated_votes, read_annotated

    scheme = scheme_for(dataset)
    raw = read_annotated(spark, path, dataset, id_col="id", multi_line=multi_line)
    v1, v2 = annotated_votes(raw, "id")
    return prepare_labels(raw, v1, v2, split=split, multilingual=multilingual, clean=clean,
                          scheme=scheme, item="id", text_col="text",
                          remove_undecided=remove_undecided)
