"""Early stopping decided while the validation log is written (M8, live).

``plans.train.early_stop`` judges a finished log. Here the checks arrive as files; a run
keeps a state of constant size (best score, checks since, last step) between the triggers,
and its decision is known after the trigger that brought the deciding check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelspark.sources.steps import read_steps, write_step

_STATE = "best double, best_step bigint, waited bigint, n_checks bigint, n_late bigint, last_step bigint, stop_step bigint"
_DECISION = "n_checks bigint, n_late bigint, best_step bigint, best_score double, stop_step bigint, stopped boolean"


def _fold(checks, best, best_step, waited, stop, patience, min_delta, sign):
    """The rule over checks in order; NaN on either side never improves."""
    for at, value in checks:
        if sign * value < sign * best - min_delta:
            best, best_step, waited = value, at, 0
            continue
        waited += 1
        if waited >= patience:
            return best, best_step, waited, at
    return best, best_step, waited, stop


def live_early_stop(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                    checkpoint_location: str, patience: int = 10, min_delta: float = 0.001, warmup: int = 100,
                    mode: str = "min", run: str = "run_id", step: str = "step", score: str = "val_loss",
                    max_bytes_per_trigger: int = 1 << 30):
    """Follow the parquet logs under ``source_dir``, all runs at once; returns when the backlog is done.

    The rule is that of ``early_stop``. Every trigger writes, as one committed step under
    ``sink_dir``, the decisions of the runs it brought checks for: ``run, n_checks, n_late,
    best_step, best_score, stop_step, stopped``; ``live_decisions`` reads the newest of each run.
    A restart goes on from the checkpoint; a replayed trigger is the same step and counts once.

    A trigger's checks of a run count in the order of their steps, equal steps in the order of their
    scores. A check whose step is not after the last one counted by an earlier trigger comes too late to
    change what was decided: it is counted in ``n_late`` only. Checks with a null run or step are not
    counted; a null score never improves. The state of a run does not grow; one trigger holds a
    run's new checks at 16 bytes each, bounded by ``max_bytes_per_trigger``. With very many runs use
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', got {mode!r}")
    sign = 1.0 if mode == "min" else -1.0
    out = f"`{run}` {schema[run].dataType.simpleString()}, {_DECISION}"

    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value = [], []
        for frame in frames:
            at.append(frame["_step"].to_numpy(np.int64))
            value.append(frame["_score"].to_numpy(np.float64))
        steps, scores = np.concatenate(at), np.concatenate(value)
        order = np.lexsort((scores, steps))
        steps, scores = steps[order], scores[order]
        if state.exists:
            best, best_step, waited, n, late, last, stop = state.get
            fresh = int(np.searchsorted(steps, last, "right"))
            begin = fresh
        else:
            best, best_step, waited, n, late, stop, fresh, begin = float(scores[0]), 0, 0, 0, 0, None, 0, 1
        late += fresh
        n += len(steps) - fresh
        if stop is None:
            checks = zip(steps[begin:].tolist(), scores[begin:].tolist(), strict=True)
            best, best_step, waited, stop = _fold(checks, best, best_step, waited, None, patience, min_delta, sign)
        last = int(steps[-1]) if fresh < len(steps) else last
        state.update((best, best_step, waited, n, late, last, stop))
        yield pd.DataFrame({run: [key[0]], "n_checks": [n], "n_late": [late], "best_step": [best_step], "best_score": [best],
                            "stop_step": pd.array([stop], dtype="Int64"), "stopped": [stop is not None]})

    log = (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(source_dir)
           .where((F.col(step) >= warmup) & F.col(run).isNotNull())
           .select(run, F.col(step).cast("bigint").alias("_step"), F.col(score).cast("double").alias("_score")))
    decisions = log.groupBy(run).applyInPandasWithState(follow, out, _STATE, "update", GroupStateTimeout.NoTimeout)
    q = (decisions.writeStream.outputMode("update")
         .foreachBatch(lambda batch, number: write_step(batch, sink_dir, number))
         .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def live_decisions(spark: SparkSession, sink_dir: str, run: str = "run_id") -> DataFrame:
    """The newest decision of every run: one partial aggregate over the committed steps."""
    rows = read_steps(spark, sink_dir)
    fields = [c for c in rows.columns if c != run]
    newest = F.max_by(F.struct(*fields), F.struct("n_checks", "n_late"))
    return rows.groupBy(run).agg(newest.alias("_d")).select(run, "_d.*")
