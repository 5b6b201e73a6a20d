"""Scoring posts with a pluggable model (M2) and restartable streaming
scoring (ST1).

The scorer is the one place Python runs on the executors. A scorer factory
is called once per task (the model is loaded once per partition, never
captured with data in a closure); the function it returns maps a pandas
Series of texts to binary logits ``[n, 2]`` and category logits ``[n, k]``.
Texts arrive in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``
caps them) and are cut into model batches of ``batch_size``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.predict import predict
from labelspark.operators.posts import harmonise_posts
from labelspark.sources.steps import read_steps, write_step

# The task code below is shipped by value, so executors need numpy and pandas
# but not this package. A scorer defined in a user module must be importable
# on the executors (``--py-files``) or registered the same way.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ScoreFn = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]
ScorerFactory = Callable[[], ScoreFn]


class LengthScorer:
    """Deterministic stand-in model: logits on a 0.05 grid from the text
    length in code points. Used by tests and the registered queries, where
    no trained network is available; any real model plugs in the same way."""

    def __init__(self, n_categories: int = 6):
        self.n_categories = n_categories

    def __call__(self) -> ScoreFn:
        k = self.n_categories

        def score(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            n = texts.fillna("").str.len().to_numpy(dtype=np.int64)
            b = np.zeros((len(n), 2))
            b[:, 1] = ((n * 37) % 101 - 50) / 20.0
            c = np.stack([((n * (41 + 14 * j) + 7 * j) % 101 - 50) / 20.0 for j in range(k)], axis=1) \
                if len(n) else np.zeros((0, k))
            return b, c

        return score


def _output_schema(df: DataFrame, keep: Sequence[str]) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    return T.StructType(fields + [
        T.StructField("binary_logits", T.ArrayType(T.DoubleType())),
        T.StructField("category_logits", T.ArrayType(T.DoubleType())),
    ])


def score(df: DataFrame, scorer: ScorerFactory, keep: Sequence[str] = ("item_id",),
          text_col: str = "text", batch_size: int = 32) -> DataFrame:
    """Attach ``binary_logits`` and ``category_logits`` to each row (M2).

    Runs as ``mapInPandas``: rows stay in their partitions (no shuffle), only
    ``keep`` plus the text cross to Python, and one frame goes back per Arrow
    batch, cut into model batches of ``batch_size`` inside. Batches of very
    long texts are bounded by the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch``, which is the caller's.
    """
    keep = list(keep)
    schema = _output_schema(df, keep)
    cols = keep + ([text_col] if text_col not in keep else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            if not len(pdf):
                continue
            texts = pdf[text_col]
            logits = [model(texts.iloc[start:start + batch_size])
                      for start in range(0, len(pdf), batch_size)]
            out = pdf[keep].copy()
            out["binary_logits"] = list(np.concatenate([np.asarray(b, dtype=float) for b, _ in logits]))
            out["category_logits"] = list(np.concatenate([np.asarray(c, dtype=float) for _, c in logits]))
            yield out

    return df.select(*cols).mapInPandas(run, schema)


def with_predictions(scored: DataFrame, n: int = 6, threshold: float = 0.5) -> DataFrame:
    """M3 on scorer output: the four prediction columns, logits dropped."""
    cols = predict(F.element_at("binary_logits", 1), F.element_at("binary_logits", 2),
                   F.col("category_logits"), n, threshold)
    return scored.select(*[c for c in scored.columns
                           if c not in ("binary_logits", "category_logits")],
                         *[c.alias(k) for k, c in cols.items()])


def stream_scoring(spark, source_dir: str, schema: T.StructType, sink_dir: str,
                   checkpoint_location: str, scorer: ScorerFactory, key: str = "item_id",
                   event_time: str | None = None, watermark: str = "1 hour",
                   max_files_per_trigger: int | None = None, batch_size: int = 32):
    """Interruptible scoring (ST1): new post files under ``source_dir`` are
    scored, predicted and written to ``sink_dir`` as committed steps; ``steps.read_steps`` reads them.

    The checkpoint records which files were done, so a restart scores only
    new files; a batch that is replayed after a crash is the same step again and
    counts once. Runs with ``availableNow`` and returns after the backlog is done.

    Ids are deduplicated on ``key`` before the model sees them, exactly and without state: each
    batch keeps one post per id and drops the ids that earlier steps hold. Only ids are
    read back, and only those of the batch are looked for (Spark broadcasts the batch's ids
    when they are few, so the stored ids are not shuffled). With ``event_time`` given,
    ``dropDuplicatesWithinWatermark`` is used instead: repeats within the watermark go, and the
    stored ids are not read.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    posts = harmonise_posts(reader.parquet(source_dir)).dropna(subset=["text"])
    keep = [key] + ([event_time] if event_time else [])
    if event_time:
        posts = posts.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        if not event_time:
            batch = _new_ids(batch, sink_dir, key)
        write_step(with_predictions(score(batch, scorer, keep=keep, batch_size=batch_size)), sink_dir, number)

    q = (posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _new_ids(batch: DataFrame, sink_dir: str, key: str) -> DataFrame:
    """One post per id (the least by its columns) of the ids that no committed step holds."""
    first = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("_r")).select(key, "_r.*")
    done = read_steps(batch.sparkSession, sink_dir, batch.select(key).schema).select(key)
    known = done.join(first.select(key), key, "left_semi").distinct()
    return first.select(*batch.columns).join(known, key, "left_anti")
