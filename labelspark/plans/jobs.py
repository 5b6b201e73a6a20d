"""End-to-end jobs: the scoring job (M5) and the group study (M6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.predict import contradiction, each, label_names, sigmoid, strict_label_names
from labelspark.operators import reports
from labelspark.operators.posts import filter_posts, harmonise_posts, surrogate_ids
from labelspark.operators.sampling import dedup_first, sample_n
from labelspark.scheme import DEFAULT_SCHEME, GROUP_STUDY_LABELS, LabelScheme
from labelspark.session import materialise as materialise_df
from labelspark.streaming.scoring import ScorerFactory, score, with_predictions


@dataclass
class ScoringResult:
    labelled: DataFrame   # posts with predictions and label names
    checks: DataFrame     # one-row result checks (A18)
    funnel: DataFrame     # rows per stage (A20)
    predictions: DataFrame


def scoring_job(posts_raw: DataFrame, scorer: ScorerFactory, scheme: LabelScheme = DEFAULT_SCHEME,
                seed: int = 51, batch_size: int = 32, strict_checks: bool = True,
                materialise: bool = True, order: Sequence[str] = ()) -> ScoringResult:
    """Score posts and label them (M5).

    harmonise columns -> drop null text -> integer surrogate ids -> score
    (mapInPandas) -> predict and gate -> keep the first prediction per id ->
    checks -> join back to posts -> contradiction flag -> label names. The
    original string id comes back as ``data_id``.

    "First" is by the source columns ``order`` (a row index or a time), then
    by a hash of the whole post, so the result never depends on the order rows
    are read in. A post without an id makes every id a generated one and is
    kept. With ``strict_checks`` the result checks raise, as in the reference.

    With ``materialise`` the posts with their ids and the predictions are
    written to the session's shared checkpoint folder: ids are made and the
    model runs once for all the outputs (labelled rows, checks, funnel), and a
    lost executor does not send finished posts back through the model. The
    text goes into the scorer and never comes back out of it.
    """
    posts = harmonise_posts(posts_raw)
    if materialise:  # counted by the job that makes the ids
        posts, came = reports.observed(posts, input=F.count(F.lit(1)), with_text=F.count("text"))
    with_text = posts.dropna(subset=["text"])
    first = [*order, "_first"]
    keyed = with_text.withColumn("_first", F.xxhash64(*with_text.columns))
    ided = surrogate_ids(keyed, "item_id", seed=seed).select("item_id", "data_id", "text", *first)
    if materialise:
        ided = materialise_df(ided, "posts")
    inputs = ided.select("item_id", "data_id", "text")
    preds = with_predictions(score(ided, scorer, keep=["data_id", *first], batch_size=batch_size),
                             scheme.n_categories)
    if materialise:
        preds, scored = reports.observed(preds, predictions=F.count(F.lit(1)))
        preds = materialise_df(preds, "scored")
    deduped = dedup_first(preds, "data_id", order=first).drop(*first)
    checks = reports.prediction_checks(deduped, inputs, strict=strict_checks)
    joined = reports.join_predictions(inputs, deduped, "data_id")
    names, pipe = label_names("pred_category", scheme.level2)
    labelled = (joined.withColumn("contradiction", contradiction("pred_category"))
                .withColumn("pred_category_labels", names)
                .withColumn("pred_category_pipe", pipe)
                .drop("data_id").withColumnRenamed("item_id", "data_id"))
    if materialise:
        ids = (inputs.select("data_id", F.lit(1).alias("i"), F.lit(0).alias("p"))
               .unionByName(preds.select("data_id", F.lit(0).alias("i"), F.lit(1).alias("p")))
               .groupBy("data_id").agg(F.sum("i").alias("i"), F.max("p").alias("p")).where("p = 1"))
        last = ids.agg(F.count(F.lit(1)).alias("deduplicated"), F.coalesce(F.sum("i"), F.lit(0)).cast("bigint").alias("labelled"))
        funnel = reports.funnel_rows([*came.get.items(), *scored.get.items()], last, ["deduplicated", "labelled"])
    else:
        funnel = reports.funnel([("input", posts), ("with_text", with_text),
                                 ("predictions", preds), ("deduplicated", deduped),
                                 ("labelled", labelled)])
    return ScoringResult(labelled, checks, funnel, deduped)


def group_scores(posts: DataFrame, scorer: ScorerFactory, labels: Sequence[str],
                 batch_size: int = 32) -> DataFrame:
    """Third-party multi-label scorer: percent scores and the strict
    (> 50) joined label string ``predicted_label`` per ``item_id``."""
    scored = score(posts.select("item_id", "text"), scorer, keep=["item_id"], batch_size=batch_size)
    pct = each("category_logits", lambda x, i: sigmoid(x) * 100, len(labels))
    return scored.select("item_id", strict_label_names(pct, labels).alias("predicted_label"))


def group_study(posts_raw: DataFrame, scorer: ScorerFactory,
                labels: Sequence[str] = GROUP_STUDY_LABELS, n: int = 10000, seed: int = 42,
                groups: Sequence[str] = ("Female", "Male"), match: str = "substring",
                predictions: DataFrame | None = None):
    """Label prevalence by demographic group (M6).

    Filter posts (reply, by_public, not a later duplicate), drop null text,
    draw ``n`` posts, score them (or take stored ``predictions``), join the
    group column back by id, report percent per label per group.
    Returns ``(prevalence, predictions)``.
    """
    posts = harmonise_posts(posts_raw)
    # the draw and its scores are written once: both results read them
    chosen = materialise_df(sample_n(filter_posts(posts.dropna(subset=["text"])), n, "item_id", seed)
                            .select("item_id", "text"), "study-posts")
    preds = predictions if predictions is not None else materialise_df(
        group_scores(chosen, scorer, labels), "study-scores")
    joined = reports.join_demographics(preds, posts, "item_id", ("gender",))
    prevalence = reports.prevalence_by_group(joined, "gender", "predicted_label", labels,
                                             match=match, groups=groups)
    return prevalence, preds
