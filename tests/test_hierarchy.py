"""ICM over declared label trees, against the definition by lowest common ancestors."""

import math
import random

import pytest

from labelspark.operators import hierarchy as H
from labelspark.operators import metrics as M

TREE = H.LabelTree({"a": None, "b": None, "a1": "a", "a2": "a", "a1x": "a1", "a1y": "a1", "a2x": "a2", "b1": "b"})


def _random_rows(n, seed):
    rnd = random.Random(seed)
    labels = list(TREE.parents)
    return [(i, rnd.sample(labels, rnd.randint(0, 4)), rnd.sample(labels, rnd.randint(0, 4))) for i in range(n)]


def _ic_by_ancestors(labels, ic):
    """IC({c1, ..., cn}) = IC(c1) + IC({c2, ...}) - IC({lca(c1, c2), ...}); a chain counts its deepest node."""
    labels = sorted(set(labels))
    if not labels:
        return 0.0
    first, rest = labels[0], labels[1:]
    if not rest:
        return ic[first]
    mine = TREE.path(first)
    shared = [next((n for n in mine if n in TREE.path(c)), None) for c in rest]
    deepest = max(shared, key=lambda n: len(TREE.path(n)) if n else 0)
    return ic[first] + _ic_by_ancestors(rest, ic) - (ic[deepest] if deepest else 0.0)


def test_tree_icm_matches_definition(spark):
    rows = _random_rows(200, 5)
    df = spark.createDataFrame(rows, "doc_id int, gold array<string>, pred array<string>").repartition(4)
    n = len(rows)
    seen = {v: sum(any(v in TREE.path(c) for c in g) for _, g, _ in rows) for v in TREE.parents}
    ic = {v: -math.log2(seen[v] / n + 1 / n) for v in TREE.parents}
    priors = H.tree_priors(df, TREE, "gold")
    got = {r["node"]: r for r in priors.collect()}
    assert {v: got[v]["g"] for v in TREE.parents} == seen
    assert all(got[v]["ic"] == pytest.approx(ic[v], abs=1e-12) for v in TREE.parents)
    want = sum(2 * _ic_by_ancestors(g, ic) + 2 * _ic_by_ancestors(p, ic) - 3 * _ic_by_ancestors(g + p, ic)
               for _, g, p in rows) / n
    out = {r["prediction"]: r["icm"] for r in H.tree_icm(df, TREE, "gold", {"pred": "pred", "gold": "gold"}).collect()}
    assert out["pred"] == pytest.approx(want, abs=1e-9)
    assert out["gold"] == pytest.approx(sum(_ic_by_ancestors(g, ic) for _, g, _ in rows) / n, abs=1e-9)
    sets = df.withColumn("_d", H.deltas(priors)).select("pred", H.tree_ic("pred", TREE, priors_map()).alias("ic"))
    for r in sets.collect():
        assert r["ic"] == pytest.approx(_ic_by_ancestors(r["pred"], ic), abs=1e-9)


def priors_map():
    from pyspark.sql import functions as F
    return F.col("_d")


def test_two_levels_equal_the_scheme(spark):
    names = ["no", "x", "y", "z"]
    tree = H.LabelTree({"any": None, "no": None, "x": "any", "y": "any", "z": "any"})
    rnd = random.Random(3)
    rows = [([rnd.randint(0, 1) for _ in names], [rnd.randint(0, 1) for _ in names]) for _ in range(60)]
    vec = spark.createDataFrame(rows, "y_cat array<int>, pred_category array<int>")
    named = spark.createDataFrame([tuple([n for n, v in zip(names, side, strict=True) if v] for side in r) for r in rows],
                                  "gold array<string>, pred array<string>")
    assert H.tree_icm(named, tree, "gold", {"p": "pred"}).first()["icm"] == pytest.approx(
        M.icm(vec, n=4).first()["icm"], abs=1e-9)


def test_odd_sets(spark):
    """Null sets, null, repeated and unknown labels add nothing; without rows the figures are null."""
    schema = "gold array<string>, pred array<string>"
    df = spark.createDataFrame([(None, ["a1", None, "a1"]), (["a1", "stranger"], None), ([], [])], schema)
    plain = spark.createDataFrame([([], ["a1"]), (["a1"], []), ([], [])], schema)
    one, two = (H.tree_icm(d, TREE, "gold", {"p": "pred"}).first()["icm"] for d in (df, plain))
    assert one == pytest.approx(two) and one is not None
    empty = spark.createDataFrame([], schema)
    assert H.tree_icm(empty, TREE, "gold", {"p": "pred"}).first()["icm"] is None
    rows = H.tree_priors(empty, TREE, "gold").collect()
    assert len(rows) == len(TREE.parents) and all(r["g"] == 0 and r["ic"] is None for r in rows)


def test_bad_trees():
    for parents in ({}, {"a": "nowhere"}, {"a": "b", "b": "a"}, {"a": "a"}):
        with pytest.raises(ValueError):
            H.LabelTree(parents)


def test_closure_table(spark):
    rows = {tuple(r) for r in TREE.closure_table(spark).collect()}
    assert ("a1x", "a") in rows and ("a1x", "a1x") in rows and ("a", "a1x") not in rows
    assert len(rows) == sum(len(TREE.path(c)) for c in TREE.parents)


def test_counts_need_one_small_shuffle(spark):
    """Closures are built in the row: one exchange, of partial counts by node."""
    df = spark.createDataFrame(_random_rows(20, 1), "doc_id int, gold array<string>, pred array<string>")
    plan = H.node_counts(df, TREE, "gold", {"p": "pred"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(node") == 1 and plan.count("Exchange") == 1
    assert "Join" not in plan
