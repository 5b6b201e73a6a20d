"""Plan shape: Python only in the scorer, filters and column pruning reach
the parquet scan, row-level rankings are partitioned by hash bucket."""

import os

import pytest
from pyspark.sql import functions as F

from harness import SF_SMALL
from labelspark import fixtures as fx
from labelspark.operators import consensus as C
from labelspark.operators.ordering import hash_positions
from labelspark.operators.posts import filter_posts
from labelspark.queries import QUERIES

PYTHON_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "PythonUDF", "FlatMapGroupsInPandas")
SCORER_QUERIES = {"score_posts", "scoring_job", "stream_scoring", "prediction_checks", "funnel", "positive_rate",
                  "group_study", "value_counts", "join_demographics", "train_two_head", "two_head_predictions",
                  "trial_table", "trial_ranks", "write_labelled", "cached_scores"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SCORER_QUERIES))
def test_no_python_outside_the_scorer(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(node in text for node in PYTHON_NODES), name


def test_scorer_is_map_in_pandas(spark):
    assert "MapInPandas" in plan(QUERIES["score_posts"](spark, SF_SMALL))


@pytest.fixture(scope="module")
def stored_posts(spark):
    import tempfile
    path = os.path.join(tempfile.mkdtemp(prefix="labelspark-plan-"), "posts.parquet")
    fx.fx_posts(spark, SF_SMALL).write.parquet(path)
    return path


def test_split_filter_is_pushed_to_scan(spark, stored_posts):
    df = C.filter_split(spark.read.parquet(stored_posts), "train", multilingual=True)
    text = formatted(df)
    assert "PushedFilters" in text and "In(split" in text


def test_post_filters_are_pushed_to_scan(spark, stored_posts):
    text = formatted(filter_posts(spark.read.parquet(stored_posts)).select("item_id"))
    assert "EqualTo(item_type,reply)" in text and "EqualTo(author_type,by_public)" in text
    assert "In(duplicates" in text
    # only the needed columns are read
    read_schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "cleaned_text" not in read_schema and "tweet" not in read_schema


def test_row_ranking_is_partitioned_by_hash_bucket(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    text = plan(hash_positions(df, "key", 1))
    assert "hashpartitioning(_b" in text
    assert "row_number()" in text


def test_consensus_is_one_aggregate_on_item(spark):
    df = C.consensus(fx.fx_votes1(spark, SF_SMALL), fx.fx_votes2(spark, SF_SMALL))
    text = plan(df)
    assert text.count("hashpartitioning(doc_id") == 1
    assert "partial_count" in text or "partial_sum" in text or "HashAggregate" in text


def test_split_filter_prunes_partitions(spark, tmp_dir):
    from labelspark.sources.annotated import store_annotated
    path = store_annotated(fx.fx_posts(spark, SF_SMALL), os.path.join(tmp_dir, "annotated"))
    df = C.filter_split(spark.read.parquet(path), "test")
    text = formatted(df)
    assert "PartitionFilters" in text and "DEV_EN" in text
    assert {r["split"] for r in df.collect()} == {"DEV_EN"}


def test_session_checkpoint_folder_is_honoured(spark, tmp_dir):
    from labelspark.session import checkpoint_dir, materialise
    current = checkpoint_dir(spark)
    out = materialise(spark.range(3), "probe")
    assert out.count() == 3
    assert checkpoint_dir(spark) == current


def test_per_group_sample_limits_before_the_shuffle(spark):
    from labelspark.operators.sampling import sample_per_group
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"))
    text = formatted(sample_per_group(df, "g", 10, "key"))
    # a partial group limit runs on the map side, so a hot group never arrives whole
    assert text.count("WindowGroupLimit") >= 2


def test_scored_log_does_not_move(spark):
    """The bucketed log is read bucket by bucket; only the posts are shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["remaining_rows"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = text[text.index("Bucketed: true"):]
    join = text[text.index("SortMergeJoin"):]
    right = join[join.rindex("\n      ", 0, join.index("Bucketed: true")):] if "Bucketed: true" in join else ""
    assert "Bucketed: true" in scan and "Exchange" not in right


def test_funnel_counts_come_with_the_jobs(spark):
    """The stages are counted while they run; the report reads ids only."""
    text = formatted(QUERIES["funnel"](spark, SF_SMALL))
    reads = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert reads and all(line.strip() in ("ReadSchema: struct<data_id:bigint>",) for line in reads), reads


def test_million_strata_are_ranked_in_ranges(spark):
    from labelspark.operators.sampling import split_sizes
    n = 1_000_000
    counts = spark.range(n).select(F.col("id").alias("s"), (1 + F.col("id") % 5).alias("_c"))
    got = split_sizes(counts, "s", 0.1)
    text = plan(got)
    assert "Window" in text and "_p" in text
    told = got.join(counts, "s").agg(F.sum("n_take").alias("t"), F.count("*").alias("n"), F.min("n_take").alias("lo"),
                                     F.count_if(F.col("n_take") > F.col("_c")).alias("bad")).first()
    total = 3 * n
    assert (told.t, told.n, told.bad) == (-(-total // 10), n, 0) and told.lo >= 0
