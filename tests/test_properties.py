"""Property tests: cleaning = Python ``re``, exact sizes, partitions,
invariance under repartitioning, early-stop = plain loop, hash order."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelspark.functions.text import CLEANING_PATTERNS_PY, clean_text
from labelspark.operators import consensus as C
from labelspark.operators import sampling as S
from labelspark.operators.ordering import hash_positions
from labelspark.operators.posts import surrogate_ids
from labelspark.plans import train as TR

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ",
          " ", " ", "　"]
PIECES = ["RT", " @", "@", "user_1", "ab-c", "http", "https://t.co/x", "bit.ly/", "bitxly/q",
          "&amp;", "&#39;", "&x", ";", "<MENTION_0>", "<MENTION_3>", "<URL>", "#tag", "word",
          "ü", "日本", "-", "_"] + SPACES


def py_clean(s):
    for p in CLEANING_PATTERNS_PY:
        s = re.sub(p, "", s)
    return s


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=60))
def test_clean_text_matches_python_re(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_clean(t), repr(t)


def test_clean_text_null_and_strict(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(clean_text("t").alias("c")).first()["c"] is None
    with pytest.raises(Exception):
        df.select(clean_text("t", strict=True).alias("c")).collect()


def _md5_order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), str(k)))


def test_hash_positions_follow_md5_order(spark):
    keys = [f"k{i}" for i in range(700)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["pos"] for r in hash_positions(df, "key", 7, digits=1).collect()}
    want = {k: i for i, k in enumerate(_md5_order(keys, 7))}
    assert got == want


@pytest.mark.parametrize("n,frac", [(1, 0.2), (7, 0.5), (250, 0.2), (613, 0.37), (1000, 0.0)])
def test_sample_frac_exact_size(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "key")
    got = sorted(r["key"] for r in S.sample_frac(df, frac, "key", seed=3).collect())
    want_n = round(frac * n)
    assert len(got) == want_n
    assert got == sorted(_md5_order(list(range(n)), "3:sample_frac")[:want_n])


def _split_sizes(counts, test_size):
    n = sum(counts.values())
    n_train = n - math.ceil(test_size * n)
    cont = {k: c / n * n_train for k, c in counts.items()}
    fl = {k: math.floor(v) for k, v in cont.items()}
    extra = n_train - sum(fl.values())
    for k in sorted(counts, key=lambda k: (-(cont[k] - fl[k]), k))[:extra]:
        fl[k] += 1
    return {k: counts[k] - fl[k] for k in counts}


@pytest.mark.parametrize("n,test_size,p", [(60, 0.05, 0.3), (333, 0.1, 0.5), (17, 0.5, 0.2)])
def test_stratified_split_is_exact_partition(spark, n, test_size, p):
    rnd = random.Random(n)
    rows = [(i, 1 if rnd.random() < p else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, y int")
    out = S.stratified_split(df, "y", test_size, "key", seed=42).collect()
    assert sorted(r["key"] for r in out) == list(range(n))
    counts = {0: sum(1 for _, y in rows if y == 0), 1: sum(1 for _, y in rows if y == 1)}
    want = _split_sizes({k: v for k, v in counts.items() if v}, test_size)
    for y, k in want.items():
        held = sorted(r["key"] for r in out if r["y"] == y and r["part"] == "held_out")
        stratum = [key for key, yy in rows if yy == y]
        assert held == sorted(_md5_order(stratum, "42:stratified_split")[:k])


def test_sample_per_group_and_strict(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "key long, g int")
    out = S.sample_per_group(df, "g", 5, "key", seed=1).collect()
    for g in range(3):
        keys = [r["key"] for r in out if r["g"] == g]
        assert sorted(keys) == sorted(_md5_order([i for i in range(50) if i % 3 == g], 1)[:5])
    with pytest.raises(ValueError):
        S.sample_per_group(df, "g", 40, "key", strict=True)


def test_dedup_first_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 5, "z")],
                               "k long, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in S.dedup_first(df, "k", ["o"]).collect()}
    assert got == {1: (0, "a"), 2: (5, "z")}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_consensus_invariant_under_repartition(spark, parts):
    from labelspark import fixtures as fx
    sf = "/root/testdata/sf0.001"
    base = C.consensus(fx.fx_votes1(spark, sf), fx.fx_votes2(spark, sf)).collect()
    again = C.consensus(fx.fx_votes1(spark, sf).repartition(parts),
                        fx.fx_votes2(spark, sf).repartition(parts)).collect()
    assert sorted(map(tuple, base), key=repr) == sorted(map(tuple, again), key=repr)


def test_surrogate_ids_paths(spark):
    nums = spark.createDataFrame([("12",), ("7",), ("300",)], "item_id string")
    assert sorted(r["data_id"] for r in surrogate_ids(nums).collect()) == [7, 12, 300]
    mixed = spark.createDataFrame([(f"x{i}",) for i in range(40)] + [("5",)], "item_id string")
    ids = [r["data_id"] for r in surrogate_ids(mixed).collect()]
    assert sorted(ids) == list(range(1, 42))


def declared_early_stop(scores, patience, min_delta, warmup, steps, sign=1):
    """The rule as a definition: from a check the run moves to the first check within ``patience`` that
    beats it; it ends at the check that nothing beats, and stops ``patience`` checks later if it gets there."""
    seen = [(step, sign * s) for s, step in zip(scores, steps) if step >= warmup]
    if not seen:
        return None, 0, None
    beaten_by = {i: min((j for j in range(i + 1, min(i + patience, len(seen) - 1) + 1) if seen[j][1] < seen[i][1] - min_delta),
                        default=None) for i in range(len(seen))}
    at = 0
    while beaten_by[at] is not None:
        at = beaten_by[at]
    stop = seen[at + patience][0] if at + patience < len(seen) else None
    return sign * seen[at][1], (seen[at][0] if at else 0), stop


def test_early_stop_matches_plain_loop(spark):
    rnd = random.Random(5)
    runs, rows = {}, []
    for run in range(60):
        length = rnd.choice([0, 1, 3, 9, 25, 70, 140])
        level = 10.0
        scores = []
        for _ in range(length):
            level += rnd.choice([-0.5, -0.0005, 0.0, 0.3, 0.0011])
            scores.append(round(level + rnd.random() * 0.01, 4))
        steps = [1 + 20 * i for i in range(length)]
        runs[run] = (scores, steps)
        rows += [(run, st_, s) for s, st_ in zip(scores, steps)]
    df = spark.createDataFrame(rows, "run_id long, step long, val_loss double")
    # tiny chunks so the halo and the pointer doubling are exercised
    out = {r["run_id"]: r for r in TR.early_stop(df, patience=4, min_delta=0.001, warmup=30,
                                                   chunk=5, step_bucket=64).collect()}
    for run, (scores, steps) in runs.items():
        best, best_step, stop = declared_early_stop(scores, 4, 0.001, 30, steps)
        if best is None:
            assert run not in out
            continue
        r = out[run]
        assert (r["best_score"], r["best_step"], r["stop_step"]) == (best, best_step, stop), run


def test_hot_key_is_ranked_in_pieces_and_stays_exact(spark):
    # one key holds a third of the rows; with a tiny hot threshold its bucket
    # is split by the row hash, and positions stay a dense permutation in
    # (hash, key) order
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, v int")
    out = hash_positions(df, "key", 9, digits=1, piece_rows=20).collect()
    assert sorted(r["pos"] for r in out) == list(range(900))
    order = _md5_order(sorted({k for k, _ in rows}), 9)
    start, expect = 0, {}
    for k in order:
        n = sum(1 for kk, _ in rows if kk == k)
        expect[k] = set(range(start, start + n))
        start += n
    got = {}
    for r in out:
        got.setdefault(r["key"], set()).add(r["pos"])
    assert got == expect
    # same positions on a second run (ties among duplicates resolve by row hash)
    again = {(r["key"], r["v"]): r["pos"] for r in hash_positions(df, "key", 9, digits=1, piece_rows=20).collect()}
    assert again == {(r["key"], r["v"]): r["pos"] for r in out}


def test_cutoff_with_hot_key_is_exact(spark):
    rows = [(7, i) for i in range(200)] + [(i + 100, i) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, v int")
    for frac in (0.1, 0.5, 0.9):
        got = S.sample_frac(df, frac, "key", seed=4, piece_rows=10)
        n = round(frac * len(rows))
        keys = [r["key"] for r in got.collect()]
        assert len(keys) == n
        # whole keys in hash order, the cut key partly
        order = _md5_order(sorted({k for k, _ in rows}), "4:sample_frac")
        flat = [k for k in order for _ in range(sum(1 for kk, _ in rows if kk == k))]
        assert sorted(keys) == sorted(flat[:n])


def test_batches_in_input_order(spark):
    from labelspark.sources.annotated import attach_row_index
    df = attach_row_index(spark.range(70).select(F.col("id").alias("v")), "row_index")
    out = {r["v"]: r["batch_id"] for r in S.batch_ids(df, "v", 32, position="row_index").collect()}
    assert out == {v: v // 32 for v in range(70)}


def test_clean_text_on_web_pages_matches_python_re(spark):
    # raw pages carry real entities, links and markup
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r["page_id"]: (r["html"], r["c"]) for r in
           pages.select("page_id", "html", clean_text("html").alias("c")).collect()}
    assert got
    for html, cleaned in got.values():
        assert cleaned == py_clean(html)


def test_early_stop_max_mode(spark):
    rnd = random.Random(11)
    rows, runs = [], {}
    for run in range(30):
        scores = [round(rnd.random(), 3) for _ in range(rnd.choice([2, 15, 40]))]
        steps = [5 * i for i in range(len(scores))]
        runs[run] = (scores, steps)
        rows += [(run, st_, s) for s, st_ in zip(scores, steps)]
    df = spark.createDataFrame(rows, "run_id long, step long, val_loss double")
    out = {r["run_id"]: r for r in TR.early_stop(df, patience=3, min_delta=0.01, warmup=10,
                                                   mode="max", chunk=4).collect()}
    for run, (scores, steps) in runs.items():
        best, best_step, stop = declared_early_stop(scores, 3, 0.01, 10, steps, sign=-1)
        if best is None:
            assert run not in out
            continue
        r = out[run]
        assert (r["best_score"], r["best_step"], r["stop_step"]) == (best, best_step, stop), run


def test_best_check_is_earliest_minimum(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 21, 0.3), (1, 41, 0.3), (1, 61, 0.4)],
                               "run_id long, step long, val_loss double")
    r = TR.best_check(df).first()
    assert (r["best_step"], r["best_score"], r["n_checks"]) == (21, 0.3, 4)


@pytest.mark.parametrize("n", [0, 1, 37, 500, 5000])
def test_sample_n_exact(spark, n):
    keys = [f"p{i}" for i in range(800)]
    df = spark.createDataFrame([(k,) for k in keys], "item_id string")
    got = sorted(r["item_id"] for r in S.sample_n(df, n, "item_id", seed=42).collect())
    assert got == sorted(_md5_order(keys, "42:sample_n")[:n])


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_positions_and_split_invariant_under_repartition(spark, parts):
    rows = [(i, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, y int")
    base = {r["key"]: r["pos"] for r in hash_positions(df, "key", 2).collect()}
    again = {r["key"]: r["pos"] for r in hash_positions(df.repartition(parts), "key", 2).collect()}
    assert base == again
    s1 = {r["key"]: r["part"] for r in S.stratified_split(df, "y", 0.2, "key", 5).collect()}
    s2 = {r["key"]: r["part"] for r in S.stratified_split(df.repartition(parts), "y", 0.2, "key", 5).collect()}
    assert s1 == s2


def test_score_cuts_model_batches(spark):
    from labelspark.streaming.scoring import score

    class CountingScorer:
        def __call__(self):
            import numpy as np

            def fn(texts):
                n = len(texts)
                assert n <= 7
                return np.zeros((n, 2)), np.full((n, 6), float(n))
            return fn

    df = spark.createDataFrame([(str(i), "t" * i) for i in range(50)], "item_id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    out = score(df.coalesce(1), CountingScorer(), keep=["item_id"], batch_size=7).collect()
    assert len(out) == 50
    # Arrow batches of 20, 20, 10 rows cut into model batches of 7, 7, 6 / 7, 3
    assert sorted({int(r["category_logits"][0]) for r in out}) == [3, 6, 7]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cluster_conf_sizes_partitions():
    from labelspark.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4, executor_memory_gb=16, cores_per_executor=4)
    assert 10_000 < int(conf["spark.sql.shuffle.partitions"]) < 100_000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_sample_n_with_a_hot_key_is_exact(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "item_id string, v int")
    order = _md5_order(sorted({k for k, _ in rows}), "3:sample_n")
    flat = [k for k in order for _ in range(sum(1 for kk, _ in rows if kk == k))]
    for n in (5, 150, 399):
        got = sorted(r["item_id"] for r in S.sample_n(df, n, "item_id", seed=3, piece_rows=10).collect())
        assert got == sorted(flat[:n])


def test_copies_of_one_row_are_ranked_in_parallel_pieces(spark):
    # one row copied 300 times (a third of the table), plus 600 distinct rows
    rows = [("hot", 1)] * 300 + [(f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, v int")
    out = hash_positions(df, "key", 9, digits=1, piece_rows=20).collect()
    assert len(out) == 900
    assert sorted(r["pos"] for r in out) == list(range(900))
    order = _md5_order(sorted({k for k, _ in rows}), 9)
    start, expect = 0, {}
    for k in order:
        n = sum(1 for kk, _ in rows if kk == k)
        expect[k] = set(range(start, start + n))
        start += n
    got = {}
    for r in out:
        got.setdefault(r["key"], set()).add(r["pos"])
    assert got == expect
    # the cutoff select keeps exact sizes when the cut falls inside the copies
    keys = [r["key"] for r in S.sample_frac(df, 0.5, "key", seed=9, piece_rows=20).collect()]
    order = _md5_order(sorted({k for k, _ in rows}), "9:sample_frac")
    flat = [k for k in order for _ in range(sum(1 for kk, _ in rows if kk == k))]
    assert sorted(keys) == sorted(flat[:450])


def test_grouped_positions_with_hot_buckets(spark):
    from labelspark.operators.ordering import dense_positions
    rnd = random.Random(2)
    rows = [(g, rnd.randint(0, 50), i) for i in range(600) for g in [0 if i < 400 else 1 + i % 3]]
    df = spark.createDataFrame(rows, "g long, t long, id long")
    out = dense_positions(df, ["t", "id"], F.floor(F.col("t") / 25), group=["g"], out="k",
                          refine=[F.col("t")], piece_rows=15).collect()
    got = {(r["g"], r["id"]): r["k"] for r in out}
    for g in {r[0] for r in rows}:
        ordered = sorted((t, i) for gg, t, i in rows if gg == g)
        for k, (_, i) in enumerate(ordered):
            assert got[(g, i)] == k


def test_nan_is_never_a_yes_and_never_improves(spark):
    from labelspark.functions import predict as P
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan, [nan] * 6), (0.0, 1.0, [nan, 1.0, -1.0, 0.0, nan, 2.0])],
                               "b0 double, b1 double, c array<double>")
    cols = P.predict(F.col("b0"), F.col("b1"), F.col("c"))
    rows = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    assert rows[0]["pred_binary"] == 0 and rows[0]["pred_category"] == [1, 0, 0, 0, 0, 0]
    assert rows[1]["pred_binary"] == 1 and rows[1]["pred_category"] == [0, 1, 0, 1, 0, 1]
    for n in (None, 6):
        assert df.select(P.threshold_labels("c", 0.5, n)).first()[0] == [0] * 6
    names = df.select(P.strict_label_names("c", list("abcdef"), 0.5)).collect()
    assert [r[0] for r in names] == ["none", "b, f"]
    for mode, scores, best in (("min", [nan, 0.5, 0.4], (0, nan)), ("max", [0.5, nan, 0.6], (2, 0.6)), ("min", [0.5, nan, 0.4], (2, 0.4))):
        log = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "run_id long, step long, val_loss double")
        r = TR.early_stop(log, patience=3, min_delta=0.01, warmup=0, mode=mode).first()
        assert r["best_step"] == best[0] and (r["best_score"] == best[1] or best[1] != best[1])


def test_draws_with_one_seed_are_independent(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("y"))
    held = {r["key"] for r in S.stratified_split(df, "y", 0.05, "key", 42).where("part = 'held_out'").collect()}
    drawn = {r["key"] for r in S.sample_frac(df, 0.2, "key", 42).collect()}
    assert len(held) == 200 and 15 <= len(held & drawn) <= 75


def test_scoring_job_keeps_posts_without_ids_in_any_order(spark):
    from labelspark.plans.jobs import scoring_job
    from labelspark.streaming.scoring import LengthScorer
    rows = [("1", "a"), ("2", "bbbb"), (None, "cc"), (None, "ddddd"), ("1", "eeeeeee"), ("3", None)]
    frames = [spark.createDataFrame(r, "item_id string, text string").coalesce(1) for r in (rows, rows[::-1])]
    got = [scoring_job(f, LengthScorer(6)) for f in frames]
    labelled = [sorted(((r["data_id"], r["text"], r["pred_binary"]) for r in g.labelled.collect()), key=repr) for g in got]
    assert labelled[0] == labelled[1] and len(labelled[0]) == 5
    check = got[0].checks.first()
    assert check["ok"] and check["n_predictions"] == check["n_inputs"] == 5
    repeated = [("1", "a"), ("1", "bbbbbbbbbbb"), ("2", "c")]
    frames = [spark.createDataFrame(r, "item_id string, text string").coalesce(1) for r in (repeated, repeated[::-1])]
    one, two = [sorted(map(tuple, scoring_job(f, LengthScorer(6)).labelled.select("data_id", "text", "pred_binary_prob").collect())) for f in frames]
    assert one == two and len(one) == 3 and one[0][2] == one[1][2]


def test_negative_zero_survives_the_ranking(spark):
    rows = [("k", -0.0)] * 40 + [("j", 0.0)] * 40
    out = hash_positions(spark.createDataFrame(rows, "key string, v double"), "key", 1, digits=1, piece_rows=5).collect()
    assert sorted(r["pos"] for r in out) == list(range(80))
    assert sum(str(r["v"]) == "-0.0" for r in out) == 40


def test_sample_n_strict(spark):
    with pytest.raises(ValueError):
        S.sample_n(spark.range(3).withColumnRenamed("id", "key"), 5, "key", strict=True)
