"""Restartable streaming scoring equals the batch result (ST1)."""

import os

from pyspark.sql import functions as F

from labelspark import fixtures as fx
from labelspark.operators.posts import harmonise_posts
from labelspark.sources import steps
from labelspark.streaming.scoring import LengthScorer, score, stream_scoring, with_predictions

SF = "/root/testdata/sf0.001"


def test_stream_restart_scores_only_new_files(spark, tmp_dir):
    posts = fx.fx_posts(spark, SF).select("item_id", "tweet", "doc_id")
    src = os.path.join(tmp_dir, "src")
    for part in range(3):
        posts.where(F.col("doc_id") % 4 == part).drop("doc_id").coalesce(1) \
             .write.mode("append").parquet(src)
    schema = posts.drop("doc_id").schema
    sink = os.path.join(tmp_dir, "sink")
    ckpt = os.path.join(tmp_dir, "ckpt")
    stream_scoring(spark, src, schema, sink, ckpt, LengthScorer(6))
    first = steps.read_steps(spark, sink).count()
    # a new file: the remaining posts plus a repeat of some already scored ids
    extra = posts.where((F.col("doc_id") % 4 == 3) | (F.col("doc_id") < 10)).drop("doc_id")
    extra.coalesce(1).write.mode("append").parquet(src)
    stream_scoring(spark, src, schema, sink, ckpt, LengthScorer(6))
    streamed = steps.read_steps(spark, sink)
    batch = with_predictions(score(harmonise_posts(posts.drop("doc_id")).dropna(subset=["text"]),
                                   LengthScorer(6), keep=["item_id"]))
    cols = ["item_id", "pred_binary", "pred_binary_prob", "pred_category"]
    s_rows = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b_rows = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert first < len(s_rows)
    assert s_rows == b_rows
    assert streamed.select("item_id").distinct().count() == streamed.count()


def test_stream_dedup_within_watermark(spark, tmp_dir):
    posts = fx.fx_posts(spark, SF).select(
        "item_id", "cleaned_text", "doc_id",
        (F.lit("2024-01-01 00:00:00").cast("timestamp")
         + F.make_dt_interval(secs=F.col("doc_id").cast("int"))).alias("ts"))
    src = os.path.join(tmp_dir, "src")
    posts.where(F.col("doc_id") < 100).drop("doc_id").coalesce(1).write.parquet(src)
    # the same ids again a few seconds later: inside the watermark, dropped
    posts.where(F.col("doc_id") < 20).drop("doc_id").coalesce(1).write.mode("append").parquet(src)
    schema = posts.drop("doc_id").schema
    sink = os.path.join(tmp_dir, "sink")
    stream_scoring(spark, src, schema, sink, os.path.join(tmp_dir, "ckpt"), LengthScorer(6),
                   event_time="ts", watermark="1 hour")
    out = steps.read_steps(spark, sink)
    assert out.count() == 100
    assert out.select("item_id").distinct().count() == 100


def test_stream_replay_of_a_batch_counts_once(spark, tmp_dir):
    """A crash between the commit of a step and that of the checkpoint: the batch runs again."""
    import shutil
    posts = fx.fx_posts(spark, SF).select("item_id", "cleaned_text").limit(40)
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ckpt"))
    posts.unionByName(posts).repartition(4).write.parquet(src)  # every id twice
    stream_scoring(spark, src, posts.schema, sink, ckpt, LengthScorer(6), max_files_per_trigger=2)
    assert steps.read_steps(spark, sink).count() == 40
    commits = sorted(f for f in os.listdir(os.path.join(ckpt, "commits")) if f.isdigit())
    for f in os.listdir(os.path.join(ckpt, "commits")):
        if f.strip(".crc").strip(".") == commits[-1]:
            os.remove(os.path.join(ckpt, "commits", f))  # the last batch is not known as done
    stream_scoring(spark, src, posts.schema, sink, ckpt, LengthScorer(6), max_files_per_trigger=2)
    out = steps.read_steps(spark, sink)
    assert out.count() == 40 and out.select("item_id").distinct().count() == 40


def test_stream_keeps_no_state(spark, tmp_dir):
    posts = fx.fx_posts(spark, SF).select("item_id", "cleaned_text").limit(20)
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ckpt"))
    posts.write.parquet(src)
    q = stream_scoring(spark, src, posts.schema, sink, ckpt, LengthScorer(6))
    assert not os.path.exists(os.path.join(ckpt, "state")) and not any(p["stateOperators"] for p in q.recentProgress)
