"""Two-head training feeds prediction (M3) and the evaluation report (M4)."""

from pyspark.sql import functions as F

from harness import SF_SMALL
from labelspark import fixtures as fx
from labelspark.plans import evaluate as E
from labelspark.plans import train as TR
from labelspark.plans.prepare import prepare_labels


def test_two_head_model_feeds_evaluation(spark):
    posts, v1, v2 = fx.fx_posts(spark, SF_SMALL), fx.fx_votes1(spark, SF_SMALL), fx.fx_votes2(spark, SF_SMALL)
    train, _ = prepare_labels(posts, v1, v2, split="train", multilingual=True, clean=True)
    test, _ = prepare_labels(posts, v1, v2, split="all")
    model = TR.train_two_head(train, "doc_id", num_features=1 << 12, max_iter=10)
    scored = model.transform(test.select("doc_id", "text", "binary_labels", "category_labels"))
    ev = E.predict_labels(scored.select(
        "doc_id", (F.element_at("binary_labels", 2) == 1).cast("int").alias("y_bin"),
        F.col("category_labels").alias("y_cat"),
        F.col("binary_logits").alias("b"), F.col("category_logits").alias("c")))
    report = {(r["metric"], r["label"]): r["value"] for r in E.evaluation_report(ev).collect()}
    assert ("icm_predicted", "all") in report and ("f1_weighted", "all") in report
    assert 0.0 <= report[("f1_binary", "YES")] <= 1.0
    assert ev.count() == test.count()
    # a YES-only head set: gated rows carry the negative one-hot
    neg = ev.where(F.col("pred_binary") == 0).select("pred_category").distinct().collect()
    assert all(r["pred_category"] == [1, 0, 0, 0, 0, 0] for r in neg)


def test_param_grid_maps_to_trial_grid(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.tuning import ParamGridBuilder
    lr, tf = LogisticRegression(), HashingTF()
    maps = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).addGrid(tf.numFeatures, [1 << 12]).build()
    grid = TR.grid_from_param_maps(maps)
    assert sorted(g["reg_param"] for g in grid) == [0.0, 0.1]
    assert all(g["num_features"] == 1 << 12 for g in grid)


def test_group_study_from_stored_predictions(spark, tmp_dir):
    import os
    from labelspark.plans.jobs import group_study
    from labelspark.sources.annotated import cached_or_compute
    from labelspark.streaming.scoring import LengthScorer
    posts = fx.fx_posts(spark, SF_SMALL)
    fresh, preds = group_study(posts, LengthScorer(8), n=10000, seed=42)
    path = os.path.join(tmp_dir, "stored.parquet")
    stored = cached_or_compute(spark, path, lambda: preds)
    again, _ = group_study(posts, LengthScorer(8), predictions=stored)
    rows = lambda df: sorted((r["gender"], r["label"], round(r["pct"], 9)) for r in df.collect())
    assert rows(fresh) == rows(again)


def labelled_texts(spark, n=200):
    import random
    rng = random.Random(11)
    rows = []
    for k in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rng.randrange(0, 9))]
        yes = int(("alpha" in words) != (rng.random() < 0.1))
        cats = [1 - yes] + [yes * int(("beta" in words) != (rng.random() < 0.2)), yes * int(rng.random() < 0.3), 0, yes, yes * int(len(words) > 4)]
        rows.append((k, " ".join(words) if k % 17 else None, [1 - yes, yes], cats))
    rows.append((n, "not decided", None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, binary_labels array<int>, category_labels array<int>")


def test_focal_slope_is_the_derivative():
    import numpy as np
    from labelspark.plans.linear import focal_terms
    m, y = np.linspace(-6, 6, 41), np.arange(41) % 2
    for gamma in (0.0, 1.0, 2.0, 2.5):
        loss, slope = focal_terms(m, y, gamma, (0.7, 3.0))
        ahead, _ = focal_terms(m + 1e-6, y, gamma, (0.7, 3.0))
        assert np.abs((ahead - loss) / 1e-6 - slope).max() < 1e-4


def test_loss_of_margins_is_the_focal_loss_column(spark):
    """The trainer's losses are those that evaluation reports."""
    import numpy as np
    from labelspark.functions.losses import focal_bce, focal_ce
    from labelspark.plans.linear import focal_terms
    m = [-3.0, -0.4, 0.0, 0.7, 5.0, 12.0]
    df = spark.createDataFrame([(x, y) for x in m for y in (0, 1)], "m double, y int")
    rows = df.select("m", "y", focal_ce(F.array(F.lit(0.0), F.col("m")), F.col("y"), F.array(F.lit(0.5), F.lit(2.0)), 1.0).alias("ce"),
                     focal_bce(F.array("m"), F.array("y"), None, 2.0)[0].alias("bce")).collect()
    x, y = np.array([r.m for r in rows]), np.array([r.y for r in rows])
    assert np.allclose(focal_terms(x, y, 1.0, (0.5, 2.0))[0], [r.ce for r in rows], atol=1e-9)
    assert np.allclose(focal_terms(x, y, 2.0, (1.0, 1.0))[0], [r.bce for r in rows], atol=1e-9)


def test_certificate_is_the_gradient_at_the_returned_weights(spark):
    import numpy as np
    from labelspark.plans.linear import focal_terms
    frame = labelled_texts(spark)
    model = TR.train_two_head(frame, num_features=64, max_iter=80, tol=1e-4)
    features = TR.feature_table(frame, 64).collect()
    x = np.zeros((len(features), 65))
    for r, row in zip(features, x):
        for s in r.slots:
            row[s] += model.idf[s] / np.sqrt(len(r.slots))
        row[64] = 1.0
    yes = np.array([r.y_bin for r in features])
    assert len(features) == 200 and [f.head.name for f in model.fits][0] == "binary"
    for f in model.fits:
        h = f.head
        if h.constant:
            continue
        label = yes if h.target < 0 else np.array([r.y_cat[h.target] for r in features])
        loss, slope = focal_terms(x @ f.weights, label, h.gamma, h.weights)
        mask = np.ones_like(yes) if h.target < 0 else yes
        grad = h.factor * x.T @ (slope * mask) + np.append(f.weights[:-1] * h.reg, 0)
        assert f.converged and abs(np.linalg.norm(grad) - f.grad_norm) < 1e-9 and f.grad_norm <= 1e-4
        assert abs(h.factor * (loss * mask).sum() + h.reg / 2 * (f.weights[:-1] ** 2).sum() - f.loss) < 1e-9
    report = {r["head"]: r for r in model.report(spark).collect()}
    assert report["SEXUAL-VIOLENCE"]["constant"] and report["OBJECTIFICATION"]["positives"] == 0
    scored = model.transform(frame).select("doc_id", "binary_logits", "category_logits").collect()
    assert len(scored) == 201 and all(len(r.category_logits) == 6 and r.category_logits[3] == -TR.CONSTANT_LOGIT for r in scored)
    margin = {r.doc_id: r.binary_logits[1] for r in scored}
    plain = x @ model.fits[0].weights
    assert len(set(round(v, 6) for v in plain)) > 5 and abs(np.mean(plain) - np.mean([margin[k] for k in range(200)])) < 1e-9


def test_without_focus_and_weights_it_is_logistic_regression(spark):
    """gamma 0, no class weights: the same minimum as pyspark.ml's ridge logistic regression."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    frame = labelled_texts(spark)
    model = TR.train_two_head(frame, num_features=32, max_iter=200, tol=1e-7, reg_param=0.05, weighted=False, gamma_binary=0.0)
    rows = []
    for r in TR.feature_table(frame, 32).collect():
        x = np.zeros(32)
        for s in r.slots:
            x[s] += model.idf[s] / np.sqrt(len(r.slots))
        rows.append((float(r.y_bin), Vectors.dense(x)))
    other = LogisticRegression(regParam=0.05, standardization=False, tol=1e-10, maxIter=200).fit(spark.createDataFrame(rows, ["label", "features"]))
    ours = model.fits[0].weights
    assert np.abs(ours[:-1] - other.coefficients.toArray()).max() < 1e-3 and abs(ours[-1] - other.intercept) < 1e-3


def test_trials_share_one_feature_table_and_equal_single_fits(spark, monkeypatch):
    import numpy as np
    frame = labelled_texts(spark, 300).where("binary_labels IS NOT NULL")
    made, real = [], TR.feature_table
    monkeypatch.setattr(TR, "feature_table", lambda *a, **k: made.append(a[1]) or real(*a, **k))
    grid = [{"reg_param": r, "num_features": n, "max_iter": 60} for n in (64, 128) for r in (0.01, 0.1)]
    fits, fit = [], TR.linear.fit_heads
    monkeypatch.setattr(TR.linear, "fit_heads", lambda *a, **k: fits.append(fit(*a, **k)) or fits[-1])
    rows = TR.trial_table(frame, grid, sample=0.5, held_out=0.2).orderBy("rank").collect()
    assert sorted(made) == [64, 128] and [len(f) for f in fits] == [14, 14]  # tokenised once per size; trials in one fit
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and {(r.n_train, r.n_held_out) for r in rows} == {(120, 30)}
    assert [r.f1_weighted for r in rows] == sorted((r.f1_weighted for r in rows), reverse=True)
    # a trial's fit does not depend on its neighbours
    alone = TR.trial_table(frame, [grid[1]], sample=0.5, held_out=0.2).first()
    same = next(r for r in rows if r.num_features == 64 and r.reg_param == 0.1)
    assert abs(alone.f1_weighted - same.f1_weighted) < 1e-9 and abs(alone.f1_binary - same.f1_binary) < 1e-9
    assert np.allclose(fits[-1][0].weights, fits[0][7].weights, atol=1e-9)


def test_training_on_no_rows_and_on_one_class(spark):
    frame = labelled_texts(spark)
    empty = TR.train_two_head(frame.where("false"), num_features=16)
    assert all(f.head.constant for f in empty.fits)
    ones = TR.train_two_head(frame.where("binary_labels[1] = 1"), num_features=16, max_iter=5)
    assert ones.fits[0].head.constant and {r.pred_binary for r in TR.predict_two_head(ones, frame).collect()} == {1}


def test_margins_and_gradients_match_sums_over_tokens(spark):
    import numpy as np

    from labelspark.plans import linear

    rng = np.random.default_rng(5)
    sizes = rng.choice([0, 1, 7, 40, 3000], 700, p=[0.1, 0.2, 0.3, 0.38, 0.02])
    slots = rng.integers(0, 500, sizes.sum()).astype(np.int32)
    table, constants = rng.normal(size=(512, 3)), np.array([0.5, 0.0, -2.0])
    want = np.zeros((len(sizes), 3))
    np.add.at(want, np.repeat(np.arange(len(sizes)), sizes), table[slots])
    want = want / np.sqrt(np.maximum(sizes, 1))[:, None] + constants
    assert np.allclose(linear.margins(slots, sizes, table, constants), want)
    # the blocks a pass works on are small, whatever the batch
    assert all(c.shape[0] <= linear.BLOCK_ROWS for _, _, c in linear._slot_counts(slots, sizes, 512))

    # the gradient of the summed loss is its slope
    cut = np.cumsum(sizes)[:-1]
    rows = [(s.tolist(), float(k % 3 > 0), [float(k % 2), 0.0, 1.0]) for k, s in enumerate(np.split(slots, cut))]
    frame = spark.createDataFrame(rows, "slots array<int>, y_bin double, y_cat array<double>")
    fits = [linear.Fit(linear.Head("b", -1, 1.0, (1.0, 2.0), 1.0, 0.0, 5), None), linear.Fit(linear.Head("c", 0, 2.0, (1.0, 1.0), 1.0, 0.0, 5), None)]
    idf, point, way = rng.random(512), rng.normal(size=(2, 513)), rng.normal(size=(2, 513))
    _, grads = linear._evaluate(frame, idf, fits, list(point))
    ahead, _ = linear._evaluate(frame, idf, fits, list(point + 1e-6 * way))
    behind, _ = linear._evaluate(frame, idf, fits, list(point - 1e-6 * way))
    assert np.allclose((ahead - behind) / 2e-6, (grads * way).sum(axis=1), rtol=1e-4)


def test_a_search_runs_the_plan_of_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, f"word{k % 7} word{k % 3}", [int(k % 2 == 0), int(k % 2)], [int(k % 2 == 0), int(k % 2), 0, 0, 0, 0]) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, binary_labels array<int>, category_labels array<int>")
    out = TR.trial_table(frame.mapInArrow(told, frame.schema), [{"reg_param": 0.1, "num_features": 64, "max_iter": 3}])
    assert out.first()["n_train"] == 36
    assert seen.value == 200


def test_posts_join_their_copies_only_for_the_mark(spark):
    posts = fx.fx_posts(spark, SF_SMALL)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(posts.select("doc_id", "tweet", "split"))
    assert "Join" in plan(posts.select("doc_id", "duplicates"))
    assert posts.count() == fx.documents(spark, SF_SMALL).count()
