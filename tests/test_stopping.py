"""Live early stopping decides what the finished log would (M8)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from labelspark.plans import train as TR
from labelspark.sources import steps
from labelspark.streaming.stopping import live_decisions, live_early_stop

SCHEMA = "run_id string, step bigint, val_loss double"
COLUMNS = ["run_id", "n_checks", "best_step", "best_score", "stop_step", "stopped"]


def _log(seed, runs=12, checks=60):
    rnd = random.Random(seed)
    return [(f"r{r}", 5 * k, float("nan") if rnd.random() < 0.03 else round(3.0 / (1 + k * (r % 4)) + rnd.random(), 3))
            for r in range(runs) for k in range(rnd.randint(1, checks))]


def _run(spark, parts, tmp_dir, **kw):
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("log", "sink", "ckpt"))
    for part in parts:
        df = spark.createDataFrame(part, SCHEMA)
        df.repartition(3).write.mode("append").parquet(src)
        live_early_stop(spark, src, df.schema, sink, ckpt, **kw)
    return sink


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("mode", ["min", "max"])
def test_parts_decide_like_the_whole_log(spark, tmp_dir, mode):
    log, kw = _log(7), {"patience": 4, "min_delta": 0.01, "warmup": 20, "mode": mode}
    parts = [[r for r in log if lo <= r[1] < hi] for lo, hi in ((0, 60), (60, 65), (65, 200), (200, 10**6))]
    sink = _run(spark, parts, tmp_dir, **kw)
    whole = TR.early_stop(spark.createDataFrame(log, SCHEMA), **kw)
    assert _rows(live_decisions(spark, sink)) == _rows(whole)
    assert live_decisions(spark, sink).agg(F.sum("n_late")).first()[0] == 0


def test_decision_is_known_when_the_check_arrives(spark, tmp_dir):
    first = [("r", 0, 1.0), ("r", 1, 2.0)]
    sink = _run(spark, [first], tmp_dir, patience=2, warmup=0)
    assert not live_decisions(spark, sink).first()["stopped"]
    sink = _run(spark, [[("r", 2, 2.0), ("r", 3, 0.1)]], tmp_dir, patience=2, warmup=0)
    r = live_decisions(spark, sink).first()
    assert r["stopped"] and r["stop_step"] == 2 and r["best_score"] == 1.0 and r["n_checks"] == 4
    # nothing new: a restart writes no decision again
    before = steps.read_steps(spark, sink).count()
    log = spark.createDataFrame(first, SCHEMA)
    live_early_stop(spark, os.path.join(tmp_dir, "log"), log.schema, sink, os.path.join(tmp_dir, "ckpt"), patience=2, warmup=0)
    assert steps.read_steps(spark, sink).count() == before


def test_late_and_odd_checks(spark, tmp_dir):
    parts = [[("r", 10, 1.0), (None, 10, 0.0), ("r", None, 0.0), ("n", 10, None), ("n", 11, 0.5)],
             [("r", 10, 0.0), ("r", 5, 0.0), ("r", 11, 0.9)]]
    sink = _run(spark, parts, tmp_dir, patience=3, warmup=0)
    out = {r["run_id"]: r for r in live_decisions(spark, sink).collect()}
    assert set(out) == {"r", "n"}
    assert (out["r"]["n_checks"], out["r"]["n_late"], out["r"]["best_step"], out["r"]["best_score"]) == (2, 2, 11, 0.9)
    assert out["n"]["best_step"] == 0 and not out["n"]["stopped"]


def test_bad_mode(spark, tmp_dir):
    with pytest.raises(ValueError):
        live_early_stop(spark, tmp_dir, spark.createDataFrame([], SCHEMA).schema, tmp_dir, tmp_dir, mode="best")
