"""Periodic runs, vector codes and the sparse rule ensemble against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import plain
import pytest
from conftest_llm import LABELS, prose, same
from harness import compare, duck
from pyspark.sql import functions as F

from labelspark.llm import queries, rulefit, runs, vectorcode

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- periodic runs
def plain_runs(words):
    """(start, length, period) of all runs, by start and period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        agree = [a == b for a, b in zip(words, words[q:])] + [False]
        first = None
        for i, same_word in enumerate(agree):
            if same_word and first is None:
                first = i
            elif not same_word and first is not None:
                if i - first + q >= max(24, 3 * q):
                    found.setdefault((first, i - first + q), q)
                first = None
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_result(doc_id, text, plant=True):
    words = plain.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def periodic_texts():
    rng = random.Random(5)
    block = [f"w{rng.randrange(30)}" for _ in range(77)]
    mixed = ["a"] * 50 + [f"x{k}" for k in range(31)]
    return [(30, " ".join(block * 4)), (31, " ".join(mixed * 5 + ["end"])), (32, "go " * 23), (33, "go " * 24), (34, "a b " * 12 + "a"),
            (35, " ".join((["p", "q"] * 20 + block) * 3)), (36, "A a " * 30), (37, "x\x0by\x0cz \t" * 20 + "\n" + prose(3, 40)),
            (38, " ".join(str(bin(i).count("1") % 2) for i in range(600))), (39, " ".join(f"{k % 200}" for k in range(700))), (None, "go " * 40)]


def test_runs_of_random_words_match_plain():
    rng = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(3):
            letters, text = rng.choice([1, 2, 3, 20]), []
            for _ in range(rng.randrange(4)):
                block = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 7, 33, 60, 130]))]
                text += block * rng.randrange(1, 6) + [rng.randrange(letters)] * rng.randrange(3)
            texts.append(text)
        laid, want, at = [], [], 0
        for k, text in enumerate(texts):
            want += [(s + at, s + n + at, q) for s, n, q in plain_runs(text)]
            laid += [x + 1 for x in text] + [10**9 + k]
            at += len(text) + 1
        got = runs.find_runs(runs.tx.mix64(np.array(laid, np.uint64)), np.array([len(t) for t in texts]))
        assert got == sorted(want)


def test_colliding_hashes_change_nothing(monkeypatch):
    """Bisection over hashes may overshoot; the words decide."""
    rng = random.Random(4)
    block = [rng.randrange(9) for _ in range(50)]
    text = [rng.randrange(9) for _ in range(40)] + block * 4 + [rng.randrange(9) for _ in range(40)]
    words = runs.tx.mix64(np.array([*text, 99], np.uint64))
    want = runs.find_runs(words, np.array([len(text)]))
    assert len(want) == 1
    monkeypatch.setattr(runs._Prefixes, "same", lambda self, a, b, length: np.ones(len(a), bool))
    assert runs.find_runs(words, np.array([len(text)])) == want


def test_periodic_runs_of_odd_rows(spark, odd, odd_pairs):
    got = runs.periodic_runs(runs.planted_copies(odd)).drop("runs", "kept_text")
    same(got.collect(), [plain_result(d, t) for d, t in odd_pairs])


def test_periodic_runs_of_periodic_texts(spark, monkeypatch):
    rows = periodic_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = runs.periodic_runs(frame, kept_text=True).collect()
    same([tuple(r)[:8] for r in found], [plain_result(d, t, plant=False) for d, t in rows])
    by_id = {r.doc_id: r for r in found}
    assert by_id[32].n_runs == 0 and by_id[33].n_runs == 1 and by_id[33].kept_text == "go"
    assert [tuple(x) for x in by_id[39].runs] == [(0, 700, 200)]
    same(runs.periodic_runs(runs.planted_copies(frame)).drop("runs", "kept_text").collect(), [plain_result(d, t) for d, t in rows])


def test_periodic_runs_of_nothing(empty):
    assert runs.periodic_runs(runs.planted_copies(empty)).count() == 0


def test_periodic_runs_match_sql(spark):
    assert compare(queries.op11_periodic_runs(spark, SF), duck(SF), runs.ORACLE) == []


# ---------------------------------------------------------------- vector codes
VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, same int, k0 string"


def odd_vectors(n=150, size=32):
    rng = random.Random(8)
    rows = [[k * 3, [rng.gauss(0, 0.2) for _ in range(size)], [1, 1, 2, None][k % 4]] for k in range(n)]
    rows += [[7, None, 1], [8, [float("nan")] + [0.0] * (size - 1), 1], [10, [None] + [0.0] * (size - 1), 2], [11, [float("-inf")] * size, 2],
             [13, [0.5] * 16, 1], [14, [], 1], [None, [0.25] * size, None], [3000, [1e9] * size, 5], [3001, [-1e9] * size, 5]]
    rows += [list(rows[5]), list(rows[5])] + [[4000 + k, [0.125] * size, 9] for k in range(40)]
    return [(*r, "c", 1, 2, "k") for r in rows]


def plain_codes(rows, size=32):
    kept = []
    for vec_id, v, label, *_ in rows:
        v = [None if x is None else float(np.float32(x)) for x in v] if v is not None else None
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            whole = [max(min(math.floor(x * 256), 1 << 24), -(1 << 24)) for x in v]
            kept.append((vec_id, label, [whole[k:k + size // 16] for k in range(0, size, size // 16)]))
    seeds = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2]))[:64]
    books = [[s[2][p] for s in seeds] for p in range(16)]

    def find(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[part]))

    for _ in range(2):
        hits = [[[] for _ in seeds] for _ in range(16)]
        for _, _, parts in kept:
            for p, x in enumerate(parts):
                hits[p][find(p, x)[1]].append(x)
        books = [[[sum(c) // len(got) for c in zip(*got)] if got else books[p][e] for e, got in enumerate(hits[p])] for p in range(16)]
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    coded = []
    for vec_id, label, parts in kept:
        told = [find(p, x) for p, x in enumerate(parts)]
        coded.append((vec_id, label, "".join("%02x" % e for _, e in told), sum(d for d, _ in told)))
    totals = {}
    for _, label, _, error in coded:
        totals[label] = totals.get(label, 0) + error
    return [(i, code, error, totals[label], sha) for i, label, code, error in coded]


@pytest.mark.parametrize("size,high", [(64, 4), (64, 300), (1, 9), (7, 3)])
def test_orchard_search_is_exact_with_ties(size, high):
    rng = np.random.default_rng(size + high)
    books = vectorcode.Codebooks.of(rng.integers(-high, high, (16, size, 4)))
    x, steps = rng.integers(-high, high, (200, 64)), []
    at, far = vectorcode.nearest(books, x, steps)
    d = ((x.reshape(200, 16, 1, 4) - books.entries[None]) ** 2).sum(-1)
    assert (at == d.argmin(2)).all() and (far == d.min(2)).all()
    assert size < 64 or steps[0] < 0.6 * d.size  # the lists spare distances


def test_vector_codes_of_odd_rows(spark):
    rows = odd_vectors()
    got = vectorcode.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same(got.collect(), plain_codes(rows))


def test_vector_codes_of_few_and_no_rows(spark):
    rows = odd_vectors(5)[:9]
    same(vectorcode.compress(spark.createDataFrame(rows, VECTORS)).collect(), plain_codes(rows))
    nothing = vectorcode.compress(spark.createDataFrame([], VECTORS))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_decode_to_their_entries(spark):
    frame = spark.createDataFrame([r for r in odd_vectors() if r[0] is not None and r[0] < 3000], VECTORS)
    books = vectorcode.learn_codebooks(frame)
    coded = vectorcode.encode(frame, books, ("vec_id", "embedding"))
    for r in vectorcode.decode(coded, books, ("embedding", "error")).collect():
        whole = np.floor(np.float32(r.embedding).astype(np.float64) * 256)
        assert ((whole - np.array(r.vector) * 256) ** 2).sum() == r.error


def test_vector_codes_match_sql(spark):
    assert compare(queries.op12_vector_codes(spark, SF), duck(SF), vectorcode.ORACLE) == []


# ---------------------------------------------------------------- rule ensemble
def plain_features(text):
    text = (text or "").encode()
    words = text.split()
    if not words:
        return [0] + [-1] * 13
    chars, n = sum(map(len, words)), len(words)
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    grams = [tuple(lower[i:i + 3]) for i in range(max(n - 2, 1))]

    def letter(b):
        return chr(b).isalpha() and b < 128 or b >= 128

    def count(chars_):
        return sum(text.count(bytes([c])) for c in chars_)

    bare = [not any(letter(b) for b in w) for w in words]
    kinds = [sum(65 <= b <= 90 for b in text), sum(48 <= b <= 57 for b in text), count(b"!?.,;:"), count(b"#*$%&|<>"), sum(b >= 128 for b in text)]
    return [n, 1000 * chars // n, 1000 * sum(len(w) > 12 for w in words) // n, *[1000 * k // chars for k in kinds],
            n // (text.count(b"\n") + 1), 1000 * len(set(lower)) // n, 1000 * (len(grams) - len(set(grams))) // len(grams),
            1000 * sum(a == b for a, b in zip(lower, lower[1:])) // n,
            1000 * sum(not b and not letter(w[-1]) for w, b in zip(words, bare)) // n, 1000 * sum(bare) // n]


def test_statistics_match_plain(odd, odd_pairs):
    same(rulefit.statistics(odd).collect(), [(d, *plain_features(t)) for d, t in odd_pairs])


def test_tree_paths_become_rules():
    text = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 5.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 5.5)
   If (feature 0 <= 1.0E2)
    Predict: 1.0
   Else (feature 0 > 1.0E2)
    Predict: 0.0"""
    found = {str(r) for r in rulefit.tree_rules(text, ("a", "b"))}
    assert found == {"a <= 5.5", "a <= 5.5 and b <= 2", "a <= 5.5 and 2 < b", "5.5 < a", "5.5 < a <= 100", "100 < a"}


def labelled_rows(spark, n=400):
    rng = random.Random(2)
    rows = [(k, *[rng.randrange(1000) for _ in rulefit.FEATURES]) for k in range(n)]
    symbol = rulefit.FEATURES.index("symbol_rate") + 1
    frame = spark.createDataFrame([(*r, int(r[symbol] <= 300 or r[1] > 900)) for r in rows],
                                  "doc_id long, " + ", ".join(f"{f} long" for f in rulefit.FEATURES) + ", label int")
    return frame


def test_rules_are_sparse_and_weighted(spark):
    frame = labelled_rows(spark)
    model = rulefit.learn_rules(frame)
    assert 0 < len(model.weighted) < 60
    scored = frame.withColumn("score", model.score()).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in scored) > 0.95 * len(scored)
    for r in scored[:50]:  # the compiled expression is the sum over the rules that hold
        m = model.constant + sum(w for rule, w in model.weighted
                                 if all((lo is None or r[f] > lo) and (hi is None or r[f] <= hi) for f, lo, hi in rule.bounds))
        assert math.isclose(r.score, 1 / (1 + math.exp(-m)), rel_tol=1e-9)


def test_weights_of_patterns_meet_the_lasso_conditions(spark):
    """At the lasso optimum a used rule's gradient equals the penalty, an unused one's is not above it."""
    frame = labelled_rows(spark).withColumn("label", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    rules = [rulefit.Rule((("symbol_rate", None, 300.5),)), rulefit.Rule((("n_words", 900.5, None),)), rulefit.Rule((("digit_rate", 500.5, None),))]
    holds = F.array(*[r.column().cast("double") for r in rules])
    rows = frame.select(F.col("label").cast("double").alias("y"), holds.alias("holds"))
    patterns = rows.groupBy("y", "holds").agg(F.count("*").cast("double").alias("n"))
    penalty = 0.02
    model = rulefit._fit(patterns.select("y", "n", rulefit.array_to_vector("holds").alias("x")), penalty)
    w, b = model.coefficients.toArray(), model.intercept
    x, y = np.array([r.holds for r in rows.collect()]), np.array([r.y for r in rows.collect()])
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    for g, k in zip(slope, w):
        assert abs(g + penalty * np.sign(k)) < 1e-3 if k else abs(g) <= penalty + 1e-3
    assert (w != 0).sum() == 2


def test_quality_scores_of_odd_rows(spark, odd, odd_pairs):
    labels = spark.createDataFrame([(k, [0, 1, None][k % 3], 0) for k in range(25)] + [(None, 1, 0), (18, 0, 0)], LABELS)
    labels = labels.withColumns({"text": F.lit("t"), "score": F.lit(0.5), "label": F.lit(3), "n_words": F.lit(1)})
    rows = rulefit.judge_documents(odd, labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((d is not None, d or 0) for d, _ in odd_pairs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (plain.fold(r.doc_id, 3) == 1) for r in rows)


def test_quality_without_labels_or_rows(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in rulefit.judge_documents(odd, none).collect()} == {(0.0, 0)}
    ones = spark.createDataFrame([(k, 1, 0) for k in range(25)], LABELS)
    assert {(r.score, r.predicted) for r in rulefit.judge_documents(odd, ones).collect()} == {(1.0, 1)}
    assert rulefit.judge_documents(empty, ones).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    told = queries.op13_quality_rules(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out")
    r = told.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert r[0] >= 0.97
