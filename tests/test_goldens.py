"""Hand-worked goldens: consensus, ICM, F1, losses, gating boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from labelspark.functions import predict as P
from labelspark.functions.losses import focal_bce, focal_ce
from labelspark.operators import consensus as C
from labelspark.operators import metrics as M

L2 = ["-", "IDEOLOGICAL-INEQUALITY", "STEREOTYPING-DOMINANCE", "OBJECTIFICATION",
      "SEXUAL-VIOLENCE", "MISOGYNY-NON-SEXUAL-VIOLENCE"]


def votes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, annotator int, label string")


def test_consensus_goldens(spark):
    # item 100: the worked example; 101: tie at both levels; 102: NO majority,
    # 103: YES but no category with two votes; 104: NO at level 1 but categories at level 2
    l1 = {100: ["YES", "YES", "NO", "YES", "NO", "YES"], 101: ["NO", "NO", "NO", "YES", "YES", "YES"],
          102: ["NO"] * 5 + ["YES"], 103: ["YES"] * 6, 104: ["NO"] * 4 + ["YES"] * 2}
    l2 = {100: [["OBJECTIFICATION"], ["OBJECTIFICATION", "UNKNOWN"], ["-"], ["STEREOTYPING-DOMINANCE"],
                ["-"], ["SEXUAL-VIOLENCE"]],
          101: [["-"], ["-"], ["-"], ["OBJECTIFICATION"], ["SEXUAL-VIOLENCE"], ["UNKNOWN"]],
          102: [["-"]] * 5 + [["OBJECTIFICATION"]],
          103: [["OBJECTIFICATION"], ["SEXUAL-VIOLENCE"], ["UNKNOWN"], ["UNKNOWN"], ["-"],
                ["IDEOLOGICAL-INEQUALITY"]],
          104: [["-"], ["-"], ["SEXUAL-VIOLENCE"], ["SEXUAL-VIOLENCE", "OBJECTIFICATION"],
                ["OBJECTIFICATION"], ["UNKNOWN"]]}
    v1 = votes(spark, [(k, a, lab) for k, labs in l1.items() for a, lab in enumerate(labs)])
    v2 = votes(spark, [(k, a, lab) for k, labs in l2.items() for a, ls in enumerate(labs) for lab in ls])
    got = {r["doc_id"]: r for r in C.consensus(v1, v2).collect()}
    assert got[100]["binary_labels"] == [0, 1] and got[100]["category_labels"] == [0, 0, 0, 1, 0, 0]
    assert got[101]["binary_status"] == "tie" and got[101]["category_status"] == "tie"
    assert got[101]["binary_labels"] is None and got[101]["category_labels"] is None
    assert got[102]["binary_labels"] == [1, 0] and got[102]["category_labels"] == [1, 0, 0, 0, 0, 0]
    assert got[103]["binary_labels"] == [0, 1] and got[103]["category_status"] == "no_majority"
    assert got[104]["binary_labels"] == [1, 0] and got[104]["category_labels"] == [0, 0, 0, 1, 1, 0]


def test_drop_undecided_counts_category_after_binary(spark):
    df = spark.createDataFrame(
        [(1, "tie", "tie"), (2, "ok", "tie"), (3, "ok", "no_majority"), (4, "ok", "ok"),
         (5, "tie", "ok")], "doc_id long, binary_status string, category_status string")
    kept, report = C.drop_undecided(df)
    r = report.first()
    assert (r["binary_ties"], r["category_ties"], r["rows_kept"]) == (2, 2, 1)
    assert [x["doc_id"] for x in kept.collect()] == [4]


def _ic_by_definition(probs, item):
    """IC of a label set from the tree: the ICs of its labels, less the IC of the
    node "any category" (which every category label carries) for each one after the first."""
    ics = [-math.log2(p) for p in probs]
    chosen = [i for i, v in enumerate(item) if v]
    categories = [i for i in chosen if i > 0]
    return sum(ics[i] for i in chosen) - ics[len(item)] * max(len(categories) - 1, 0)


def test_label_set_ic_by_definition_on_all_sets(spark):
    import itertools
    gold = [[1, 0, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 1, 1],
            [1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 1, 0], [0, 0, 1, 0, 0, 0]]
    n = len(gold)
    probs = [sum(g[i] for g in gold) / n + 1 / n for i in range(6)]
    probs += [sum(1 for g in gold if any(g[1:])) / n + 1 / n, 1.0]
    sets = [list(v) for v in itertools.product([0, 1], repeat=6)]
    gdf = spark.createDataFrame([(g,) for g in gold], "y_cat array<int>")
    ic = M.node_ic(gdf)
    sdf = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<int>")
    got = {r["i"]: r["ic"] for r in sdf.withColumn("_ic", ic).select(
        "i", M.information_content("s", F.col("_ic")).alias("ic")).collect()}
    for i, s in enumerate(sets):
        assert got[i] == pytest.approx(_ic_by_definition(probs, s), abs=1e-9)


def test_icm_goldens(spark):
    gold = [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 0]]
    pred = [[1, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 1, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0]]
    n = len(gold)
    probs = [sum(g[i] for g in gold) / n + 1 / n for i in range(6)]
    probs += [sum(1 for g in gold if any(g[1:])) / n + 1 / n, 1.0]
    want = sum(2 * _ic_by_definition(probs, g) + 2 * _ic_by_definition(probs, p)
               - 3 * _ic_by_definition(probs, [max(a, b) for a, b in zip(g, p)])
               for g, p in zip(gold, pred)) / n
    df = spark.createDataFrame(list(zip(gold, pred)), "y_cat array<int>, pred_category array<int>")
    assert M.icm(df).first()["icm"] == pytest.approx(want, abs=1e-12)
    base = {r["prediction"]: r["icm"] for r in M.icm_baselines(df).collect()}
    assert base["predicted"] == pytest.approx(want, abs=1e-12)
    gold_icm = sum(_ic_by_definition(probs, g) for g in gold) / n
    assert base["gold"] == pytest.approx(gold_icm, abs=1e-12)


def test_f1_goldens(spark):
    # gold/pred binary: tp=2, fp=1, fn=1 -> f1 = 4/6
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.2), (0, 0.7), (0, 0.1)],
                               "y_bin int, pred_binary_prob double")
    r = M.f1_binary(df).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["f1"] == pytest.approx(2 / 3)
    rows = [([1, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0]), ([0, 1, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0]),
            ([0, 1, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0])]
    cdf = spark.createDataFrame(rows, "y_cat array<int>, pred_category array<int>")
    per = {r["label_index"]: r for r in M.f1_per_label(cdf).collect()}
    assert per[0]["f1"] == pytest.approx(2 / 3)      # tp 1, fp 1
    assert per[1]["f1"] == pytest.approx(2 / 3)      # tp 1, fn 1
    assert per[2]["f1"] == 0.0 and per[3]["f1"] == 0.0  # fp only / no support
    assert M.f1_macro(M.f1_per_label(cdf)).first()[0] == pytest.approx((2 / 3 + 2 / 3) / 6)
    # weighted by gold support: label 0 support 1, label 1 support 2
    assert M.f1_weighted(M.f1_per_label(cdf)).first()[0] == pytest.approx((2 / 3 * 1 + 2 / 3 * 2) / 3)


def test_loss_goldens(spark):
    b, y, gamma = [0.3, -1.2], 0, 1.0
    lse = math.log(math.exp(b[0]) + math.exp(b[1]))
    pt = min(max(math.exp(b[y] - lse), 1e-4), 1 - 1e-4)
    want_ce = (1 - pt) ** gamma * 2.5 * (lse - b[y])
    c, yc = [2.0, -0.5, 0.0], [1, 0, 1]
    want_bce = []
    for x, t, w in zip(c, yc, [1.0, 2.0, 3.0]):
        p = 1 / (1 + math.exp(-x))
        ptc = min(max(p if t >= 0.5 else 1 - p, 1e-4), 1 - 1e-4)
        want_bce.append((1 - ptc) ** 2 * w * (max(x, 0) - x * t + math.log1p(math.exp(-abs(x)))))
    df = spark.createDataFrame([(b, y, c, yc, [2.5, 1.0], [1.0, 2.0, 3.0])],
                               "b array<double>, y int, c array<double>, yc array<int>, "
                               "wb array<double>, wc array<double>")
    r = df.select(focal_ce("b", "y", F.col("wb"), gamma).alias("ce"),
                  focal_bce("c", "yc", F.col("wc"), 2.0).alias("bce")).first()
    assert r["ce"] == pytest.approx(want_ce, rel=1e-12)
    assert r["bce"] == pytest.approx(want_bce, rel=1e-12)


def test_loss_summary_masks_category_to_yes_rows(spark):
    df = spark.createDataFrame(
        [([0.0, 1.0], 1, [0.0, 0.0], [0, 1]), ([1.0, 0.0], 0, [5.0, 5.0], [0, 0])],
        "b array<double>, y_bin int, c array<double>, y_cat array<int>")
    r = M.loss_summary(df, gamma_binary=0.0, gamma_category=0.0).first()
    # category loss only from row 1 (YES): mean bce of logits 0 -> log(2)
    assert r["loss_category"] == pytest.approx(math.log(2))
    assert r["loss"] == pytest.approx(r["loss_binary"] + r["loss_category"])


def test_gating_boundaries(spark):
    # an exact binary tie: prediction says YES (prob 0.5 >= 0.5), gated logits say NO
    df = spark.createDataFrame([(0.4, 0.4, [0.0, 1.0, -1.0, 0.0, 2.0, -3.0])],
                               "b0 double, b1 double, c array<double>")
    cols = P.predict("b0", "b1", "c")
    r = df.select(*[v.alias(k) for k, v in cols.items()],
                  P.gate_logits(F.array("b0", "b1"), "c").alias("g")).first()
    assert r["pred_binary"] == 1 and r["pred_binary_prob"] == 0.5
    assert r["pred_category"] == [1, 1, 0, 1, 1, 0]  # sigmoid(0) = 0.5 counts
    assert r["g"] == [1.0, -1.0, -1.0, -1.0, -1.0, -1.0]


def test_label_name_rules(spark):
    df = spark.createDataFrame([([0, 0, 0, 0, 0, 0], [10.0, 50.0, 50.1]),
                                ([0, 1, 0, 0, 1, 0], [60.0, 20.0, 99.0])],
                               "m array<int>, s array<double>")
    names, pipe = P.label_names("m", L2)
    rows = df.select(names.alias("n"), pipe.alias("p"),
                     P.strict_label_names("s", ["a", "b", "c"]).alias("q")).collect()
    assert rows[0]["p"] == "-" and rows[0]["n"] == [] and rows[0]["q"] == "c"
    assert rows[1]["p"] == "IDEOLOGICAL-INEQUALITY|SEXUAL-VIOLENCE" and rows[1]["q"] == "a, c"


def test_substring_and_exact_membership(spark):
    df = spark.createDataFrame([("severe_toxic, insult",)], "l string")
    r = df.select(P.contains_label("l", "toxic").alias("sub"),
                  P.contains_label("l", "toxic", "exact").alias("exact")).first()
    assert r["sub"] is True and r["exact"] is False
