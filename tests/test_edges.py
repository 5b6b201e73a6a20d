"""Edge cases: empty input, all ties, no YES rows, zero support, N = 1."""

import math

import pytest
from pyspark.sql import functions as F

from labelspark.operators import consensus as C
from labelspark.operators import metrics as M
from labelspark.operators import sampling as S
from labelspark.operators.ordering import hash_positions

EV_SCHEMA = "b array<double>, y_bin int, c array<double>, y_cat array<int>, pred_category array<int>"


def test_empty_inputs(spark):
    votes = spark.createDataFrame([], "doc_id long, annotator int, label string")
    assert C.consensus(votes, votes).count() == 0
    kept, report = C.drop_undecided(C.consensus(votes, votes))
    r = report.first()
    assert kept.count() == 0 and (r["rows_in"], r["binary_ties"], r["category_ties"]) == (0, 0, 0)
    keys = spark.createDataFrame([], "key long, y int")
    assert S.sample_frac(keys, 0.5, "key").count() == 0
    assert S.sample_n(keys, 10, "key").count() == 0
    assert S.stratified_split(keys, "y", 0.1, "key").count() == 0
    assert hash_positions(keys, "key", 1).count() == 0
    ev = spark.createDataFrame([], EV_SCHEMA)
    assert M.f1_binary(ev.withColumn("pred_binary_prob", F.lit(0.5)), "y_bin").first()["f1"] == 0.0


def test_all_ties(spark):
    rows = [(k, a, "NO" if a < 3 else "YES") for k in range(4) for a in range(6)]
    v1 = spark.createDataFrame(rows, "doc_id long, annotator int, label string")
    v2 = spark.createDataFrame([(k, a, "-" if a < 3 else "OBJECTIFICATION") for k, a, _ in rows],
                               "doc_id long, annotator int, label string")
    kept, report = C.drop_undecided(C.consensus(v1, v2))
    assert kept.count() == 0
    assert report.first()["binary_ties"] == 4


def test_no_yes_rows_and_zero_support(spark):
    ev = spark.createDataFrame([([1.0, 0.0], 0, [0.5] * 6, [1, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0])] * 3,
                               EV_SCHEMA)
    loss = M.loss_summary(ev, gamma_binary=1.0, gamma_category=2.0).first()
    assert loss["loss_category"] == 0.0 and loss["loss"] == pytest.approx(loss["loss_binary"])
    w = {r["label_index"]: (r["pos"], r["weight"]) for r in
         M.class_weights(ev, "y_cat", ["-", "a", "b", "c", "d", "e"], 2).collect()}
    assert w[0] == (3, 0.0) and w[1] == (0, 3.0)   # no positives: weight is the negative count
    per = {r["label_index"]: r["f1"] for r in M.f1_per_label(ev).collect()}
    assert per[0] == 1.0 and all(per[i] == 0.0 for i in range(1, 6))


def test_single_row_icm(spark):
    ev = spark.createDataFrame([([0.0, 1.0], 1, [0.0] * 6, [0, 1, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0])],
                               EV_SCHEMA)
    # N = 1: every prior is count + 1 >= 1, so ICs are <= 0; gold label 1 has p = 2
    ic1 = -math.log2(2.0)
    assert M.icm(ev).first()["icm"] == pytest.approx(2 * ic1 + 2 * ic1 - 3 * ic1)


def test_one_stratum_split_and_frac_rounding(spark):
    df = spark.range(5).withColumnRenamed("id", "key").withColumn("y", F.lit(1))
    parts = [r["part"] for r in S.stratified_split(df, "y", 0.5, "key").collect()]
    assert parts.count("held_out") == 3          # ceil(0.5 * 5)
    assert S.sample_frac(df, 0.5, "key").count() == 2   # round half to even: round(2.5) = 2
    assert S.sample_frac(spark.range(7).withColumnRenamed("id", "key"), 0.5, "key").count() == 4


def test_null_keys_and_groups_keep_their_rows(spark):
    from labelspark.operators.ordering import dense_positions
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "key string, v int")
    pos = sorted(r["pos"] for r in hash_positions(df, "key", 1).collect())
    assert pos == [0, 1, 2, 3]
    g = spark.createDataFrame([(None, 5), (None, 1), (1, 2)], "g long, step long")
    out = dense_positions(g, ["step"], F.col("step"), group=["g"], out="k").collect()
    assert sorted((r["g"], r["step"], r["k"]) for r in out if r["g"] is None) == [(None, 1, 0), (None, 5, 1)]
    split = S.stratified_split(spark.createDataFrame([(i, None) for i in range(10)], "key long, y int"),
                               "y", 0.3, "key")
    assert split.count() == 10
