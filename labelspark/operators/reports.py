"""Counts, prevalence by group, result checks, drift and stage funnels
(A15-A20), plus the joins of predictions to posts (J1-J3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelspark.functions.predict import contains_label


# -------------------------------------------------------------- aggregates
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (A15), most frequent first: ``<col>, count``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def prevalence_by_group(df: DataFrame, group: str, label_col: str, labels: Sequence[str],
                        match: str = "substring", groups: Sequence[str] | None = None,
                        none_label: str = "none") -> DataFrame:
    """Percent of rows per group whose label string contains each label
    (A16), ``none`` first: ``<group>, label, pct``.

    One grouped aggregate of conditional counts (partial aggregation), then
    an unpivot. Rows with a null group are left out; ``groups`` restricts the
    groups (the filter reaches the scan).
    """
    src = df.where(F.col(group).isNotNull())
    if groups is not None:
        src = src.where(F.col(group).isin(*groups))
    names = [none_label, *labels]
    aggs = [F.count_if(contains_label(label_col, name, match)).alias(f"_k{i}")
            for i, name in enumerate(names)]
    per = src.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    structs = [F.struct(F.lit(name).alias("label"),
                        (F.lit(100.0) * F.col(f"_k{i}") / F.col("_n")).alias("pct"))
               for i, name in enumerate(names)]
    return per.select(group, F.explode(F.array(*structs)).alias("_e")).select(group, "_e.*")


def positive_rate(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Percent of rows per group with ``flag = 1``."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg((F.lit(100.0) * F.avg(F.col(flag).cast("double"))).alias("pct_positive")))


def prediction_checks(preds: DataFrame, inputs: DataFrame, sentinel: int = 99,
                      strict: bool = False) -> DataFrame:
    """Result checks (A18): no sentinel in the predictions and no more
    predictions than inputs. One aggregate per side, one report row.
    ``strict`` runs the report and raises on a violation."""
    p = preds.agg(F.count(F.lit(1)).alias("n_predictions"),
                  F.count_if(F.col("pred_binary") == sentinel).alias("binary_sentinels"),
                  F.count_if(F.array_contains("pred_category", sentinel)).alias("category_sentinels"))
    n_in = inputs.agg(F.count(F.lit(1)).alias("n")).scalar()
    report = p.select("*", n_in.alias("n_inputs"))
    report = report.withColumn("ok", (F.col("binary_sentinels") == 0)
                               & (F.col("category_sentinels") == 0)
                               & (F.col("n_predictions") <= F.col("n_inputs")))
    if strict:
        row = report.first()
        if not row["ok"]:
            raise ValueError(f"prediction checks failed: {row.asDict()}")
    return report


def score_drift(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Max absolute element difference per row between two model outputs
    joined on the key (A19): ``key, max_abs_diff``."""
    j = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key)
    return j.select(key, F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
                    .alias("max_abs_diff"))


def overall_drift(per_row: DataFrame) -> DataFrame:
    return per_row.agg(F.max("max_abs_diff").alias("max_abs_diff"))


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Row count per named stage (A20): ``stage_no, stage, n_rows``."""
    out = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that come along when it next runs; ``Observation.get`` gives them."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def funnel_rows(known: Sequence[tuple[str, int]], rest: DataFrame, stages: Sequence[str]) -> DataFrame:
    """The funnel from counts that jobs have observed (``known``) and a one-row frame with the columns ``stages``."""
    rows = [(name, F.lit(n).cast("bigint")) for name, n in known] + [(name, F.col(name)) for name in stages]
    return rest.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), n.alias("n_rows")) for i, (name, n) in enumerate(rows)])).alias("_e")) \
        .select("_e.*")


# ------------------------------------------------------------------- joins
def join_predictions(posts: DataFrame, preds: DataFrame, key: str = "data_id") -> DataFrame:
    """Inner equi join of posts and predictions (J1). Duplicate post keys all
    receive the one prediction; AQE splits a skewed key's partition."""
    return posts.join(preds, key, "inner")


def join_demographics(preds: DataFrame, posts: DataFrame, key: str = "item_id",
                      cols: Sequence[str] = ("gender",)) -> DataFrame:
    """Left join of predictions to the posts' group columns (J2). Only the
    key and the wanted columns are taken from the right, so no column is
    duplicated; duplicate right keys fan out as in any left join.

    The posts are first cut to the predicted ids, so a small stored set of
    predictions does not shuffle every post: Spark broadcasts the ids if their
    stored size is small, and joins by shuffle otherwise."""
    right = posts.select(key, *cols).join(preds.select(key).distinct(), key, "left_semi")
    return preds.drop(*[c for c in cols if c in preds.columns]).join(right, key, "left")


def remaining_rows(posts: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Rows not scored yet (J3): anti join on the stable key. A log stored with ``steps.write_bucketed``
    is read bucket by bucket and does not move."""
    return posts.join(scored.select(key), key, "left_anti")
