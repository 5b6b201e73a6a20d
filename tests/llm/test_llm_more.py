"""URL filter, token files, sampled pieces and the pipeline on odd rows and empty tables."""

import itertools
import math
import os

import duckdb
import numpy as np
import plain
import pytest
from conftest_llm import same
from pyspark.sql import functions as F

import corpus_pipeline
from labelspark.llm import queries, spsample, tokenfile, urlgraph
from labelspark.llm import textops as tx

PAGES = "page_id long, url string, html string, host string, rule string, trust double"


def odd_pages():
    link = '<a class="x" href="{}">t</a>'
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x", "https://a.example.net/de/", "http://net/x", "http://NET",
            "http://b.example.com/de/2#f", "http://b.example.com/fr/", "https://www.site.org/fr/a", "https://www.site.org/x", "ftp://c.d.e.f/p?q#r",
            "http://e.com?next=http://x.net/y", "http://bad.one.com/p", "http://good.one.com/p", "http://far.away.io/", "http://far.away.io/"]
    html = [None, "", link.format("http://a.example.net/z"), link.format("//B.example.com/w?u"), link.format("/local") * 3,
            link.format("https://www.site.org/fr/a") * 2 + link.format("http://net/")]
    return [(k if k != 4 else None, u, html[k % len(html)], "h", "r", 0.5) for k, u in enumerate(urls)]


@pytest.mark.parametrize("rows", [odd_pages(), []])
def test_url_filter_matches_its_sql(spark, tmp_dir, rows):
    frame = spark.createDataFrame(rows, PAGES)
    frame.write.parquet(os.path.join(tmp_dir, "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_dir}/pages/*.parquet')")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    judged = urlgraph.judge_urls(frame)
    assert judged.columns == cols
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    same(judged.collect(), con.sql(f"SELECT {', '.join(cols)} FROM ({urlgraph.oracle()})").fetchall())


def test_url_rules_longest_wins(spark):
    urls = {"http://x.example.net/en/a": ("example.net/en/", "allow"), "http://x.example.net/de/": ("net/", "block"),
            "http://example.com/de/": ("example.com/de/", "block"), "http://a.org/fr/": ("org/fr/", "allow"), "http://notexample.com/de/": (None, None)}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = urlgraph.split_url(F.col("url"))
    got = {r.url: (r.rule, r.verdict) for r in frame.select("url", *[c.alias(n) for c, n in zip(urlgraph.match_rule(host, path), ("rule", "verdict"))]).collect()}
    assert got == urls


def test_trust_and_distrust_follow_links(spark):
    s = 10 ** 6
    edges = spark.createDataFrame([("good", "friend", 1), ("liar", "bad", 3), ("friend", "far", 1)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("good", s, 0), ("bad", 0, s), ("friend", 0, 0), ("liar", 0, 0), ("far", 0, 0)], "host string, t0 long, d0 long")
    rank = {r.host: (r.trust, r.distrust) for r in urlgraph.propagate(nodes, edges).collect()}
    assert rank["friend"][0] > rank["far"][0] > 0 and rank["friend"][1] == 0
    assert rank["liar"][1] > 0 and rank["liar"][0] == 0


def crawl():
    """Pages of a planted crawl (url, html) and the hosts without a rule that propagation should block.

    Seeds: shop*.net (blocked), site*.org/fr (allowed). Farms link mostly to blocked seeds, their
    feeders only to farms; friends are linked from allowed seeds, news link among themselves and a
    few to one blocked shop although allowed seeds link to them; islands link to nobody.
    """
    def links(*hosts):
        return "".join(f'<a href="http://{h}/x">t</a>' for h in hosts)

    pages = [(f"http://shop{k}.net/", links(f"shop{(k + 1) % 10}.net")) for k in range(10)]
    pages += [(f"http://site{k}.org/fr/", links(f"friend{k}.info", f"news{k % 5}.info", f"site{(k + 1) % 10}.org")) for k in range(10)]
    pages += [(f"http://farm{k}.info/", links(*[f"shop{j}.net" for j in range(10)], f"friend{k}.info")) for k in range(6)]
    pages += [(f"http://feeder{k}.info/", links(*[f"farm{j}.info" for j in range(6)])) for k in range(4)]
    pages += [(f"http://friend{k}.info/", links(f"friend{(k + 1) % 10}.info")) for k in range(10)]
    pages += [(f"http://news{k}.info/", links(*[f"news{j}.info" for j in range(5) if j != k], *["shop0.net"] * (k == 0))) for k in range(5)]
    pages += [(f"http://island{k}.info/", None) for k in range(40)]
    return pages, {f"farm{k}.info" for k in range(6)} | {f"feeder{k}.info" for k in range(4)}


def test_propagation_decides_planted_hosts(spark, tmp_dir):
    pages, bad = crawl()
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    frame.write.parquet(os.path.join(tmp_dir, "pages"))
    got = urlgraph.judge_urls(frame).collect()
    assert {r.host for r in got if r.rule is None and r.verdict == "block"} == bad
    assert all(r.verdict == ("block" if r.host.endswith(".net") else "allow") for r in got if r.rule)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_dir}/pages/*.parquet')")
    same(got, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urlgraph.oracle()})").fetchall())


def test_distrust_survives_a_million_seeds(spark):
    # a seed's score was wt * (MASS div total): 0 for every seed beyond 10^6 of them
    blocked = spark.range(0, 1_000_100).selectExpr("id AS page_id", "concat('http://h', id, '.net/') AS url", "CAST(null AS string) AS html")
    link = '<a href="http://h{}.net/">t</a>'
    bad = spark.createDataFrame([(-1, "http://bad.com/", "".join(link.format(k) for k in range(20))), (-2, "http://good.com/", None)],
                                "page_id long, url string, html string")
    got = urlgraph.judge_urls(blocked.unionAll(bad)).where("page_id < 0").collect()
    assert {r.page_id: r.verdict for r in got} == {-1: "block", -2: "allow"}


def test_a_rare_edge_beside_a_heavy_one_gets_its_share(spark):
    # an edge's share was 10^6 * weight div total: 0 here, and for every edge of a hub with more than 10^6
    heavy, mass = 10 ** 8, 10 ** 12
    edges = spark.createDataFrame([("hub", "big", heavy), ("hub", "rare", 1), ("big", "sink", heavy), ("small", "sink", 1)],
                                  "src string, dst string, weight long")
    nodes = spark.createDataFrame([(h, mass * (h == "hub"), mass * (h == "sink")) for h in ("hub", "big", "rare", "small", "sink")],
                                  "host string, t0 long, d0 long")
    rank = {r.host: (int(r.trust), int(r.distrust)) for r in urlgraph.propagate(nodes, edges).collect()}
    start = 15 * mass // 100
    assert rank["rare"][0] == 85 * (start // (heavy + 1)) // 100 and rank["small"][1] == rank["rare"][0]
    assert rank["big"][0] == 85 * (start * heavy // (heavy + 1)) // 100


def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.tokenizer_path(tokenfile.TOKENIZER))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_token_files_match_direct_encoding(odd, odd_pairs):
    # rows with one id come in the order of a hash of their text: compare sums of these apart
    got = tokenfile.encode_documents(odd).collect()
    want = plain.token_files(odd_pairs, direct())
    single = [d for d, _ in odd_pairs if [x for x, _ in odd_pairs].count(d) == 1]
    same([r for r in got if r.doc_id in single], [w for w in want if w[0] in single])
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(w[0], w[2], w[3]) for w in want])
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0] + [r.n_tokens for r in order[:-1]]))


def test_sequences_are_views_of_equal_length(spark, odd, odd_pairs, tmp_dir):
    manifest = tokenfile.write_token_files(odd, tmp_dir, length=64, rows=4).orderBy("first_id", "first_tie").collect()
    ids = []
    for m in manifest:
        part = tokenfile.PartReader(m.path)
        n = -(-m.n_ids // 64)
        for k in reversed(range(n)):
            seq, mask = part.sequence(k)
            assert len(seq) == len(mask) == 64 and seq.dtype == np.uint16 and not seq.flags.owndata
            assert sum(mask.to_pylist()) == min(64, m.n_ids - 64 * k)
        ids += [int(x) for k in range(n) for x in part.sequence(k)[0]][: m.n_ids]
        assert [int(x) for run in part.runs(3, m.n_ids - 3) for x in run] == ids[len(ids) - m.n_ids + 3:]
    assert len(ids) == sum(len(direct()(t or "")) + 1 for _, t in odd_pairs)


def test_token_files_of_an_empty_table(empty):
    assert tokenfile.encode_documents(empty).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return spsample.Pieces(spsample.MODEL)


def run_texts(pieces, texts, seeds, samples=2):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return list(spsample.sample_texts(spsample.Store(pieces), data, offsets, np.array(seeds, np.uint64), samples))


def every_segmentation(pieces, text):
    """Log-weight of every segmentation of a short text, by ids."""
    raw, found = b" " + text.encode(), []
    by_bytes = {}
    for k, b in enumerate(pieces.bytes):
        if b and not (len(b) == 1 and k == pieces.byte_id[b[0]]):
            by_bytes[b] = k
    node = {}
    for key, child in zip(pieces.keys.tolist(), pieces.child.tolist()):
        node[key] = child

    def weight(b):
        state = 0
        for c in b:
            state = node[(state << 8) | c]
        return float(pieces.weight[state])

    def walk(at, ids, w):
        if at == len(raw):
            found.append((tuple(ids), w))
            return
        for end in range(at + 1, len(raw) + 1):
            if b" " in raw[at + 1:end].lstrip(b" ") and raw[at + 1:end].strip(b" "):
                continue
            k = by_bytes.get(raw[at:end])
            if k is not None:
                walk(end, [*ids, k], w + weight(raw[at:end]))

    walk(0, [], 0.0)
    return found


def test_samples_have_the_lattice_distribution(pieces):
    text = "the cat"
    paths = every_segmentation(pieces, text)
    total = np.logaddexp.reduce([w for _, w in paths])
    log_p = {ids: w - total for ids, w in paths}
    n = 4000
    out = run_texts(pieces, [text] * n, range(1, n + 1), samples=2)
    assert len(out) == 2 * n
    first = {}
    for (d, s, ids, lp, value, kappa), (_, s2, ids2, lp2, value2, _) in zip(out[::2], out[1::2]):
        assert (s, s2) == (0, 1) and tuple(ids) != tuple(ids2) and value >= value2 >= kappa
        assert math.isclose(lp, log_p[tuple(ids.tolist())], abs_tol=1e-9) and math.isclose(lp2, log_p[tuple(ids2.tolist())], abs_tol=1e-9)
        first[tuple(ids.tolist())] = first.get(tuple(ids.tolist()), 0) + 1
    for ids, lp in log_p.items():
        p = math.exp(lp)
        assert abs(first.get(ids, 0) / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # both samples together: inclusion of each segmentation in a draw of two without replacement
    top = max(log_p, key=log_p.get)
    p = math.exp(log_p[top])
    want = p + sum(math.exp(q) * p / (1 - math.exp(q)) for ids, q in log_p.items() if ids != top)
    got = sum(tuple(r[2].tolist()) == top for r in out) / n
    assert abs(got - want) < 0.04
    # importance weights with the inclusion scores count all of the mass
    mass = sum(math.exp(lp) / -math.expm1(-math.exp(lp - kappa)) for _, _, _, lp, _, kappa in out) / n
    assert abs(mass - 1) < 0.06


def test_all_segmentations_come_once_when_there_are_few(pieces):
    text = "ab"
    paths = {ids for ids, _ in every_segmentation(pieces, text)}
    out = run_texts(pieces, [text], [7], samples=len(paths) + 3)
    assert len(out) == len(paths) and {tuple(r[2].tolist()) for r in out} == paths
    assert [r[4] for r in out] == sorted((r[4] for r in out), reverse=True)


def test_samples_do_not_depend_on_the_batch(pieces):
    texts = ["one two", "", "naïve ▁ 😀", "three  blanks\n", "the cat sat on the mat again"]
    whole = run_texts(pieces, texts, [3, 4, 5, 6, 7], samples=3)
    for k, t in enumerate(texts):
        alone = run_texts(pieces, [t], [k + 3], samples=3)
        mine = [r for r in whole if r[0] == k]
        assert [r[2].tolist() for r in alone] == [r[2].tolist() for r in mine]
        assert all(pieces.decode(r[2]) == t.encode() for r in mine)


def test_words_without_blanks_are_cut_and_stay_in_proportion(pieces):
    """A word of 200,000 bytes costs about what as many bytes of prose cost, and decodes exactly."""
    import time

    rng = np.random.default_rng(4)
    store, seeds = spsample.Store(pieces), np.array([1], np.uint64)
    long = ["".join(chr(97 + k) for k in rng.integers(0, 26, 200_000)), "é😀漢" * 20_000, "x" * 150_000]
    prose = " ".join("".join(chr(97 + k) for k in rng.integers(0, 26, 6)) for _ in range(30_000))
    cost = []
    for text in [prose, *long]:
        data = np.frombuffer(text.encode(), np.uint8)
        began = time.process_time()
        _, sample, ids, cut, log_prob, value, _, same = spsample.sample_chunk(store, data, np.array([0, len(data)]), seeds, 2)
        cost.append((time.process_time() - began) / len(data))
        assert same.tolist() == [True, True] and sample.tolist() == [0, 1] and value[0] >= value[1]
        assert ids[cut[0]: cut[1]].tolist() != ids[cut[1]: cut[2]].tolist()
    assert max(cost[1:]) < 20 * cost[0]


def test_cuts_fall_where_characters_begin():
    text = ("a" * 1023 + "😀" * 700 + "é" * 900).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = spsample._cut_words(data, np.array([0]), np.array([len(data)]))
    assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= spsample.LONGEST_WORD + 3
    assert all((data[k] & 0xC0) != 0x80 for k in starts)


def test_encode_samples_of_odd_rows(odd, odd_pairs, empty):
    rows = spsample.encode_samples(odd).collect()
    assert all(r.round_trip and 0 < r.inclusion <= 1 for r in rows)
    blank = [r for r in rows if r.n_pieces == 0]
    assert len(blank) == sum(not t for _, t in odd_pairs) and all(r.ids == [] and r.inclusion == 1 for r in blank)
    assert len({(r.doc_id, r.sample, tuple(r.ids)) for r in rows}) >= len(rows) - 4  # equal rows draw alike
    back = spsample.decode_ids(spsample.encode_samples(odd.where("doc_id = 16")).select("doc_id", "ids")).collect()
    assert {r.text for r in back} == {t for d, t in odd_pairs if d == 16}
    assert spsample.encode_samples(empty).count() == 0


def test_pipeline_of_odd_rows(spark, odd, odd_pairs, tmp_dir):
    passage = next(t for d, t in odd_pairs if d == 14)
    leak = next(t for d, t in odd_pairs if d == 16)
    spark.createDataFrame([(1, " ".join(leak.split()[4:20])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs, seen = odd, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tmp_dir).write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
        if k < 4:
            assert docs.columns == odd.columns
        seen[name] = docs
    ids = {n: sorted((r.doc_id for r in f.select("doc_id").collect()), key=repr) for n, f in seen.items()}
    assert not {5, 6, 7, 17} & set(ids["language"]) and len(ids["language"]) == len(odd_pairs) - 5
    assert not {2, 3, 9, 22} & set(ids["near_duplicates"]) and {1, 4, 8, 12, 13, 14, 15, None} - {4} <= set(ids["near_duplicates"])
    texts = {r.doc_id: r.text for r in seen["repeats"].collect()}
    assert texts[12].endswith(passage) and passage not in texts[13] and passage not in texts[14] and texts[15] == dict(odd_pairs)[15]
    assert set(ids["repeats"]) - set(ids["decontamination"]) == {16}
    kept = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    for r in spsample.decode_ids(seen["pieces"].where("doc_id <> 18").select("doc_id", "ids")).collect():
        assert r.text == (kept[r.doc_id] or "")


def test_pipeline_of_an_empty_table(spark, empty, tmp_dir):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    empty.write.parquet(f"{tmp_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0


def test_oracles(spark):
    import harness

    con = harness.duck("/root/testdata/sf0.001")
    for name, sql in queries.ORACLES.items():
        assert harness.compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, sql) == [], name
