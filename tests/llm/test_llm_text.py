"""Operators over texts against plain versions, on a table of odd rows and on empty tables."""

import math
import os
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest_llm import same
from pyspark.sql import functions as F

from labelspark.llm import decontam, jaccard, langid, lm, queries, quality, suffixdedup, toxicity
from labelspark.llm import textops as tx

SF = "/root/testdata/sf0.001"
RECALL_ITEMS = int(os.environ.get("RECALL_ITEMS", 400))  # per size class


def test_word_and_shingle_sets_match_words(odd_pairs):
    column = pa.array([t for _, t in odd_pairs], pa.string())
    sizes = {row: len(s) for row, s in tx.text_shingle_sets(column)}
    assert [sizes[k] for k in range(len(odd_pairs))] == [len(plain.shingles(t)) for _, t in odd_pairs]


def test_pack_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (tx.unpack(tx.pack(values)) == values).all()
    assert len(tx.unpack(tx.pack(values[:0]))) == 0


def test_lm_scores_match_plain(odd, odd_pairs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4_000)  # several blocks
    got = lm.score_documents(odd, tx.fold("doc_id", 10) != 0).collect()
    same(got, plain.score(odd_pairs), places=6)


def test_lm_weights_of_a_state_sum_to_one(odd_pairs):
    texts = [[*plain.words(t), "<end>"] for d, t in odd_pairs if plain.fold(d, 10)]
    vocab = {w for t in texts for w in t}
    probe = [(0, "aw1 bw2")] + [(1, t) for _, t in odd_pairs]
    assert vocab and probe
    # p(w | h) over the vocabulary and one unseen word, from scores of two-word texts
    from collections import Counter

    one, two, ctx = Counter(), Counter(), Counter()
    for t in texts:
        one.update(t)
        two.update(zip(t, t[1:]))
        ctx.update(t[:-1])
    n, v = sum(one.values()), len(one)
    h = max(ctx, key=ctx.get)
    kept = {w: c for (a, w), c in two.items() if a == h}
    back = 1 - sum(c - lm.DISCOUNT for c in kept.values()) / ctx[h]
    total = sum((kept[w] - lm.DISCOUNT) / ctx[h] if w in kept else 0 for w in one)
    total += back * (sum((c + lm.ADD) for c in one.values()) + lm.ADD) / (n + lm.ADD * (v + 1))
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_lm_beats_the_base_on_held_out_texts(spark):
    r = queries.op1_lm_score(spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_lm_ranges_follow_the_text_and_change_no_score(odd, odd_pairs, monkeypatch):
    """Whatever the session's partitions, a range is one of a few bytes of text; the number of ranges stays bounded."""
    few = lm.range_count(odd, 0)
    assert few == tx.bucket_count(odd)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 100)
    size = sum(len((t or "").encode()) for _, t in odd_pairs)
    assert lm.range_count(odd, size) >= size / 100 and lm.range_count(odd, size) > few
    assert lm.range_count(odd, 1 << 50) == lm.FINE_RANGES
    monkeypatch.setattr(lm, "FINE_RANGES", 256)
    monkeypatch.setattr(lm, "ROWS", 3)
    same(lm.score_documents(odd, tx.fold("doc_id", 10) != 0).collect(), plain.score(odd_pairs), places=6)


def test_lm_block_takes_few_bytes_a_token():
    import tracemalloc

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 500) % 50_000) for _ in range(400)] * 12
    table = pa.table({"text": texts, "train": [k % 10 > 0 for k in range(4_800)], "block": [0] * 4_800})
    ask = lm._ask(np.array([lm.START], np.uint64), 64)
    ask(table.slice(0, 100))  # tables of powers
    tracemalloc.start()
    asked = ask(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(tx.unpack(c).sum()) for c in asked["counts"].to_pylist() if c) == 4_320 * 501
    assert peak < 50 * 4_800 * 501  # 89 with 64-bit places and all temporaries kept


def test_every_python_step_of_the_lm_gives_memory_back(odd, monkeypatch):
    """A worker is kept from step to step: what a step leaves counts beside all later ones."""
    told, seen, handed = set(), [], []
    for name in ("tidy", "tidy_group"):
        def wrap(run, real=getattr(tx, name)):
            told.add(id(out := real(run)))
            handed.append(out)  # so that no later one gets its id
            return out

        monkeypatch.setattr(tx, name, wrap)
    grouped = odd.groupBy("doc_id")
    for kind, method in ((type(odd), "mapInArrow"), (type(grouped), "applyInArrow"), (type(grouped.cogroup(grouped)), "applyInArrow")):
        def call(self, func, *args, real=getattr(kind, method), **more):
            seen.append(id(func) in told)
            return real(self, func, *args, **more)

        monkeypatch.setattr(kind, method, call)
    lm.score_documents(odd, tx.fold("doc_id", 10) != 0)
    assert seen == [True] * 6


def test_near_duplicates_match_plain(odd, odd_pairs, monkeypatch):
    monkeypatch.setattr(jaccard, "FLUSH", 500)  # several posting blocks
    monkeypatch.setattr(jaccard, "FOLLOWERS", 2)  # several blocks of followers
    same(jaccard.near_duplicates(odd).collect(), plain.near_duplicates(odd_pairs))


@pytest.mark.parametrize("across", [1, 7, 1_000])
def test_mixed_lists_lose_no_link(spark, monkeypatch, across):
    """Groups around several centres that share a frequent passage: lists with many leaders, cut or whole."""
    rng, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(40)]
    for group in range(6):
        base = passage + [f"g{group % 3}w{k}" for k in range(30 + 4 * group)]
        for _ in range(9):
            words = list(base)
            for k in rng.sample(range(40, len(words)), rng.randrange(3)):
                words[k] = f"x{rng.randrange(4)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.randrange(6)])))
    monkeypatch.setattr(jaccard, "ACROSS", across)
    monkeypatch.setattr(jaccard, "FOLLOWERS", 4)
    want = plain.near_duplicates(rows)
    assert len({r[2] for r in want}) < len(rows) and max(r[3] for r in want) > 9
    same(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def _list_entries(sets, leaders):
    return pa.table({"fp": pa.array([k.to_bytes(16, "big") for k in range(len(sets))]), "leader": pa.array(leaders, pa.binary()),
                     "n": [len(s) for s in sets], "pos": [0] * len(sets), "skipped": [0] * len(sets),
                     "parity": pa.array([jaccard._parity(s, len(s)) for s in sets], pa.binary()), "side": [2] * len(sets)})


def test_bitmaps_pass_every_link_and_little_else():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 60, 64, 65, 500, 530, 50_000):  # bitmaps of 8 to 8,192 bytes
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for change in (0, n // 20, n // 8, n):
            fresh = rng.integers(0, 1 << 63, change).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[change:], fresh, fresh[: n // 10] + np.uint64(1)])))
    found = jaccard._across(_list_entries(sets, [bytes([k]) for k in range(len(sets))]))
    got = {(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(*(c.to_pylist() for c in found.columns))}
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    links = {(i, j) for (i, j), c in common.items() if jaccard.linked(c, len(sets[i]), len(sets[j]))}
    assert links <= got
    assert all(common[p] for p in got if len(sets[p[0]]) > 3)


def test_a_block_of_different_sets_emits_nothing():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(jaccard.ACROSS)]
    assert jaccard._across(_list_entries(sets, [k.to_bytes(4, "big") for k in range(len(sets))])).num_rows == 0


def test_long_lists_meet_in_bounded_blocks(spark, monkeypatch):
    """Every pair of one list whose sizes are in reach meets once; a block has few entries, whatever the list's length."""
    monkeypatch.setattr(jaccard, "ACROSS", 50)
    rows = [(7, k.to_bytes(16, "big"), 40 + k % 30) for k in range(600)]
    entries = spark.createDataFrame(rows, "shingle long, fp binary, n long")
    lists = spark.createDataFrame([(7, 600)], "shingle long, size long")
    blocks = {}
    for r in jaccard._blocks_of_lists(entries, lists).collect():
        blocks.setdefault((r.i, r.j), []).append((int.from_bytes(r.fp, "big"), r.side))
    met = [(min(a, b), max(a, b)) for members in blocks.values() for x, (a, s) in enumerate(members)
           for b, t in members[:x] if s == 2 or s != t]
    assert len(met) == len(set(met)) and max(map(len, blocks.values())) < 4 * 50
    near = {(a, b) for b in range(600) for a in range(b) if max(rows[a][2], rows[b][2]) * 80 <= min(rows[a][2], rows[b][2]) * 100}
    assert near <= set(met)


def test_keep_one_keeps_the_smallest_of_each_group(odd, odd_pairs):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    told = plain.near_duplicates(odd_pairs)
    groups = {}
    for (d, t), (_, n, component, _) in zip(odd_pairs, told):
        key = (component, t if d == 18 else None) if n else object()  # two unlinked texts share the id 18
        groups.setdefault(key, []).append(d)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(groups)
    assert {1, 5, 6, 7, 8, 10, 17} <= set(ids) and not {2, 3, 9, 22} & set(ids)


def test_column_order_is_the_suffix_order():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(30)] + [b"aaaa", b"aaaa"]
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    owner, size, common = suffixdedup.collection_order(flat, starts, sizes)
    found = [strings[o][len(strings[o]) - s:] for o, s in zip(owner, size)]
    assert found == sorted(found) and len(found) == sum(sizes) + len(strings)

    def prefix(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert list(common[1:]) == [prefix(a, b) for a, b in zip(found, found[1:])]


def test_places_are_ranked_without_ranking_all():
    rng = np.random.default_rng(8)
    symbol = rng.choice(np.array([3, 97, 98, 255], np.uint8), 500)
    by_symbol = np.argsort(symbol, kind="stable")
    rank = np.empty(500, np.int64)
    rank[by_symbol] = np.arange(500)
    place = np.sort(rng.choice(500, 60, replace=False))
    place = place[np.argsort(symbol[place], kind="stable")]
    assert (suffixdedup._ranks(by_symbol, symbol, symbol[place], place) == rank[place]).all()


@pytest.mark.parametrize("frequent", [suffixdedup.FREQUENT, 1])
def test_repeats_match_plain(odd, odd_pairs, monkeypatch, frequent):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 4_000)
    same(suffixdedup.remove_repeats(odd, frequent=frequent).collect(), plain.remove_repeats(odd_pairs))


def test_repeats_of_short_strings_match_plain(odd, odd_pairs):
    got = suffixdedup.remove_repeats(odd, length=30, gram=12).collect()
    same(got, plain.remove_repeats(odd_pairs, 30))


def test_long_texts_are_read_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 400)
    data = np.frombuffer(random.Random(2).randbytes(2000), np.uint8) % 26 + 97
    offsets = np.array([0, 1500, 1550, 2000])
    doc, first, last, place, _ = suffixdedup.contexts(data, offsets, 100, 40)
    windows = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert windows == [*range(0, 1401), *range(1550, 1901)]
    assert ((place >= last) & (place + 40 <= first + 100)).all()


def test_decontamination_matches_plain(spark, odd, odd_pairs):
    passage = [t for d, t in odd_pairs if d == 14][0].split()
    items = [(1, " ".join(passage[:40])), (2, " ".join([*passage[:36], "a", "b", "c", "d"])), (3, None), (4, ""), (5, "one two"),
             (6, "never seen anywhere in these texts at all"), (None, " ".join(passage[10:30])), (1, " ".join(passage[:40]))]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = []
    for d, t in odd_pairs:
        for i, x in items:
            width = min(5, len(plain.words(x)))
            if width:
                item = plain.shingles(x, width)
                w = plain.words(t)
                common = len(item & {tuple(w[k:k + width]) for k in range(len(w) - width + 1)})
                if 100 * common >= 80 * len(item):
                    want.append((d, i, len(item), common))
    got = decontam.contained_items(odd, frame)
    same(got.select("doc_id", "item_id", "item_shingles", "common_shingles").collect(), want)
    blocks = decontam.contained_items(odd, frame, block_shingles=10)  # an item a block
    same(blocks.select("doc_id", "item_id", "item_shingles", "common_shingles").collect(), want)
    alone = decontam.contained_items(odd, frame.where("item_id IS NULL"))
    assert {r.item_id for r in alone.collect()} == {None}
    clean = decontam.drop_contaminated(odd, frame)
    assert clean.columns == odd.columns
    assert clean.count() == len(odd_pairs) - len([1 for d, t in odd_pairs if d in {w[0] for w in want}])


@pytest.mark.parametrize("size", [9, 16, 17, 32, 33, 64, 120, 300])
def test_recall_of_larger_items(size):
    """Items of ``size`` shingles, whole or with as many words changed as containment 0.8 allows, inside longer texts."""
    draw = random.Random(size)
    items, docs, changes = [], [], size // 5 // 5
    for k in range(RECALL_ITEMS):
        item = [f"w{draw.randrange(3000)}" for _ in range(size + 4)]
        inside = list(item)
        if k % 4 == 1:  # the last words are others: size // 5 shingles less
            inside[len(item) - size // 5:] = [f"new{k}x{c}" for c in range(size // 5)]
        elif k % 4 == 3:
            first = draw.randrange(5)
            for c in range(changes):
                inside[min(first + c * (len(item) // max(changes, 1)), len(item) - 1)] = f"new{k}x{c}"
        before, after = ([f"w{draw.randrange(3000)}" for _ in range(draw.randrange(200))] for _ in range(2))
        items.append(item)
        docs.append([*before, *inside, *after])
    sets = [(k, s, 5) for k, s in tx.text_shingle_sets(pa.array([" ".join(i) for i in items]), 5)]
    index = decontam.ItemIndex(sets)
    sketches = {k: decontam._sketch(v) for k, (v, _) in index.parts.items()}
    found = {f[:2] for f in decontam.find_items(pa.array([" ".join(d) for d in docs]), index, sketches)}
    own = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in items]
    there = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in docs]
    planted = {(k, k) for k in range(len(items)) if 100 * len(own[k] & there[k]) >= 80 * len(own[k])}
    assert len(planted) > 0.99 * len(items) and found >= planted


@pytest.mark.parametrize("counted", [decontam.COUNTED, 3])
def test_small_items_are_never_missed(counted, monkeypatch):
    # a shingle that was not its bin's minimum was no candidate: 12 % of the items of one shingle
    monkeypatch.setattr(decontam, "COUNTED", counted)
    draw = random.Random(5)
    docs = [[f"w{draw.randrange(300)}" for _ in range(draw.randrange(1, 120))] for _ in range(60)] * 2
    items = []
    for k in range(600):
        doc = draw.choice(docs)
        at, n = draw.randrange(len(doc)), 1 + k % 14
        items.append([*doc[at: at + n], *["x"] * (k % 5 == 0)])
    want, sets = set(), []
    for k, item in enumerate(items):
        width = min(5, len(item))
        own = plain.shingles(" ".join(item), width)
        (_, s), = tx.text_shingle_sets(pa.array([" ".join(item)]), width)
        sets.append((k, s, width))
        for d, w in enumerate(docs):
            common = len(own & {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
            if 100 * common >= 80 * len(own):
                want.add((d, k, common))
    index = decontam.ItemIndex(sets)
    sketches = {k: decontam._sketch(v) for k, (v, _) in index.parts.items()}
    found = [f[:3] for f in decontam.find_items(pa.array([" ".join(d) for d in docs]), index, sketches)]
    small = {k for k, s, _ in sets if len(s) <= 8}
    assert len(found) == len(set(found)) and len(want) > 1000
    assert {f for f in found if f[1] in small} == {w for w in want if w[1] in small}


def test_cross_parsing_counts_phrases_of_a_naive_parse():
    references = {"x": b"abracadabra abra cadabra", "y": b"the cat sat on the mat"}
    parser = langid.CrossParser(references)
    for text in (b"abra the cadabra", b"zzz", b"a", b"matmatmat sat abracadabra" * 60):
        got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        for k, name in enumerate(parser.languages):
            count = 0
            for lo in range(0, len(text), langid.BLOCK):
                block, phrase = text[lo:lo + langid.BLOCK], b""
                count += 1
                for c in block:
                    known = bytes([c]) in references[name]
                    if phrase + bytes([c]) in references[name]:
                        phrase += bytes([c])
                    elif not known and not phrase:
                        count += 1  # an unknown symbol is a phrase of its own
                    else:
                        count += 1
                        phrase = bytes([c]) if known else b""
            assert got[k] == count, (text, name)


def test_language_of_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    told = queries.op9_language(spark, d).join(spark.read.parquet(d + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = told.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] <= r[2] <= 1


def test_language_of_odd_texts(odd, odd_pairs):
    model = langid.learn(odd)
    rows = langid.predict(odd, model, keep=("doc_id", "text")).collect()
    assert len(rows) == len(odd_pairs) and set(model) == {"de", "en"}
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    assert {r.lang_pred for r in langid.predict(odd, {}, keep=("doc_id",)).collect()} == {"und"}
    kept = langid.drop_undetermined(odd)
    assert kept.columns == odd.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in odd_pairs)


def test_base_counts_match_plain(spark, odd, odd_pairs):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(odd, labels)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(got.select(*cols).collect(), [(d, *plain.text_counts(t)) for d, t in odd_pairs])
    assert got.where("kept = base_failed").count() == 0  # nothing learned: the base rules decide


def test_decision_list_covers_bad_texts_and_leaves_good_ones(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op7_quality(spark, d)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    told = r.join(spark.read.parquet(d + "/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {x.quality: x.kept for x in told.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.4


def test_toxic_texts_score_higher(spark):
    d = "/root/testdata/sf0.1"
    told = queries.op10_toxicity(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").where("held_out")
    r = told.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))),
                 F.min("score"), F.max("score")).first()
    assert r[0] >= 0.65 and r[1] <= 0.03 and 0 <= r[2] <= r[3] <= 1


def test_toxicity_trains_on_the_whole_bound(spark, monkeypatch):
    def counted(table):
        y = table["toxic"].to_pylist()
        return pa.table([[b"o"], [b"t"], [[float(len(y) - sum(y)), float(sum(y))]]], names=["ordinary", "toxic", "weights"])

    monkeypatch.setattr(toxicity, "_fit", counted)  # the sample had been lowered to 4,000 and 2,000 rows
    docs = spark.range(8_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(8_000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS toxic")
    assert toxicity.learn(docs, labels)[2] == [5_000.0, 2_500.0]


def test_toxicity_of_odd_texts(spark, odd, odd_pairs):
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(1, 23)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge_toxicity(odd, labels).collect()
    assert len(rows) == len(odd_pairs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    one_class = toxicity.judge_toxicity(odd, labels.where("toxic = 1")).collect()
    assert {r.score for r in one_class} == {1.0}


def test_extra_columns_of_labels_change_nothing(spark, odd):
    labels = spark.createDataFrame([(k, int(k % 2), int(k % 3 == 0)) for k in range(1, 23)] + [(None, 1, 1), (3, 1, None), (4, None, 1)],
                                   "doc_id long, quality int, toxic int")
    more = labels.select("*", *[F.lit("x").alias(c) for c in ("text", "lang", "source", "bytes", "h", "one", "n_words", "kept", "rule",
                                                              "score", "predicted", "fp")])
    for judge in (toxicity.judge_toxicity, quality.judge_quality):
        same(judge(odd, more).collect(), [tuple(r) for r in judge(odd, labels).collect()], places=9)


def test_empty_tables(spark, empty, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for frame in (lm.score_documents(empty, tx.fold("doc_id", 10) != 0), jaccard.near_duplicates(empty), jaccard.keep_one(empty),
                  suffixdedup.remove_repeats(empty), decontam.contained_items(empty, items), langid.identify(empty),
                  quality.judge_quality(empty, labels), toxicity.judge_toxicity(empty, labels)):
        assert frame.count() == 0
    assert decontam.contained_items(odd, items).count() == 0
    assert decontam.drop_contaminated(odd, items).count() == odd.count()
    assert {r.score for r in toxicity.judge_toxicity(odd, labels).collect()} == {0.0}


def test_blocks_of_shingles_leave_a_few_ranges_at_a_time(monkeypatch):
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    texts = pa.array([" ".join(f"w{k * 31 + j}" for j in range(200)) for k in range(9)])
    batches = list(jaccard._postings(256)([pa.record_batch([texts], ["text"])]))
    assert max(b.num_rows for b in batches) <= jaccard.RANGES
    rows = [r for b in batches for r in b.to_pylist()]
    told = np.sort(np.concatenate([tx.unpack(r["hashes"]) for r in rows if r["hashes"]]))
    assert (told == np.sort(np.concatenate([s for _, s in tx.text_shingle_sets(texts)]))).all()
    assert sum(len(r["extra"]) for r in rows if r["extra"]) == 9 * 16


def test_a_kept_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    told = langid.predict(docs, {"en": b"some words here"}, keep=("doc_id", "text", "lang"))
    below = told._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert below.count(" AS ") <= 3 and "AS text" not in below
    assert [r.text for r in told.collect()] == ["some words"]


def test_groups_give_memory_back_once_they_have_worked_enough(monkeypatch):
    """Small groups together, and groups of two tables that meet; what a function returns is left alone."""
    calls = []
    monkeypatch.setattr(tx, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(tx, "TIDY_BYTES", 1000)
    table = pa.table({"x": pa.array(range(50), pa.int64())})  # 400 bytes
    one = tx.tidy_group(lambda t: t.slice(1))
    assert [(one(table).num_rows, len(calls)) for _ in range(6)] == [(49, 0), (49, 0), (49, 1), (49, 1), (49, 1), (49, 2)]
    calls.clear()
    two = tx.tidy_group(lambda a, b: pa.concat_tables([a, b]))
    assert [(two(table, table).num_rows, len(calls)) for _ in range(4)] == [(100, 0), (100, 1), (100, 1), (100, 2)]


def test_every_python_step_of_the_pipeline_stages_gives_memory_back(spark, odd, monkeypatch):
    """A worker is kept from stage to stage: what a step leaves counts beside all later ones."""
    told, handed = set(), []
    for name in ("tidy", "tidy_group"):
        def wrap(run, real=getattr(tx, name)):
            told.add(id(out := real(run)))
            handed.append(out)  # so that no later one gets its id
            return out

        monkeypatch.setattr(tx, name, wrap)
    seen = []
    kinds = {type(odd): ("mapInArrow",), type(odd.groupBy("doc_id")): ("applyInArrow",),
             type(odd.groupBy("doc_id").cogroup(odd.groupBy("doc_id"))): ("applyInArrow",)}
    for kind, (method,) in kinds.items():
        def call(self, func, *args, real=getattr(kind, method), **more):
            seen.append((func, id(func) in told))
            return real(self, func, *args, **more)

        monkeypatch.setattr(kind, method, call)
    monkeypatch.setattr(tx, "settle", lambda df, name: df)  # plans only
    docs = odd.select("doc_id", "text")
    prints = jaccard.document_sets(docs).groupBy("fp").count().withColumnRenamed("count", "mult")
    jaccard.link_sets(jaccard.candidate_sets(docs), prints)
    suffixdedup.remove_repeats(docs, keep=("doc_id",), kept_text="text")
    decontam.drop_contaminated(docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))
    assert len(seen) == 14
    assert [func for func, good in seen if not good] == []


def test_cutting_a_block_takes_a_few_bytes_per_byte_of_text():
    import tracemalloc

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(50_000)) for _ in range(8)]
    table = pa.table({"doc_id": pa.array(range(8), pa.int64()), "text": texts, "tie": pa.array(range(8), pa.int64())})
    block = suffixdedup.Block(table, 100, 40)
    lo, hi = np.array([10, 60, 399_800, 120_000]), np.array([40, 70, 399_900, 120_000])
    tracemalloc.start()
    removed, runs, _, rest = block.spans(lo, hi)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert removed.tolist() == [160, 0, 100, 0, 0, 0, 0, 200] and runs.tolist() == [1, 0, 1, 0, 0, 0, 0, 1]
    assert rest[0].tobytes().decode() == texts[0][:10] + texts[0][170:]
    assert peak < 12 * len(block.data)
