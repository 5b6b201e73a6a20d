"""URL filters: rules on host and path, then trust and distrust over the host graph.

DataFrame functions only. A page's rule is the longest one that fits its host
(or a parent of it) and the beginning of its path. Pages without a rule get the
verdict of their host from two propagations over host edges:

* trust: personalised PageRank from hosts with allowed pages, along links;
* distrust: the same from hosts with blocked pages, along reversed links (a host
  that links to distrusted hosts is distrusted).

Host edges are the links of the pages (absolute and protocol-relative ``href``
of anchors; a relative link stays on its host and says nothing) and one edge
either way between a host and its parent domain, down to two labels.

A host is blocked when its distrust is at least ``MIN_DISTRUST`` times the mean
over all hosts and at least ``RATIO`` times its trust. Scores are whole numbers
of 38 digits (a total mass of ``TOTAL``), so sums do not depend on their order and
neither the number of seeds nor the degree of a host matters. Edges and seeds
are aggregated by host before anything is joined, so a host that holds a third
of all pages is one row of each; the verdicts join the pages by host, where
adaptive execution splits a hot one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import textops as tx

TOTAL = 10 ** 24  # mass of the scores: 10^12 a host at 10^12 hosts, and room for weights up to 10^13
SEED = 10 ** 12  # resolution of a seed's weight
SCORE = "decimal(38,0)"
DAMPING = 85  # hundredths
ROUNDS = 10
MIN_DISTRUST = 1
RATIO = 2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _divide(a: str, b: str):
    """Whole quotient of two whole numbers (``div`` of decimals gives a long, ``/`` alone rounds)."""
    return F.expr(f"CAST((({a}) - ({a}) % ({b})) / ({b}) AS {SCORE})")


def _lower(column):
    return F.translate(column, _UPPER, _UPPER.lower())


def split_url(url):
    """(host, path) of a url column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def match_rule(host, path, rules=RULES):
    """(rule name, verdict) of the longest fitting rule, null without one; of equals the first."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"),) * 2


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of links between different hosts. ``pages``: host, html."""
    links = (pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("dst"))
             .select(F.col("host").alias("src"), _lower(F.col("dst")).alias("dst")))
    return (links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst")
            .agg(F.count("*").alias("weight")))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """One edge either way between a host and each next parent domain of at least two labels."""
    label = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(label) - 1, F.lit(1))),
                        lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    steps = (hosts.where(F.size(label) > 2).select(F.explode(F.arrays_zip(
        F.slice(chain, 1, F.size(label) - 2).alias("a"), F.slice(chain, 2, F.size(label) - 2).alias("b"))).alias("e"))
        .select("e.a", "e.b").distinct())
    return steps.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("long").alias("weight")).unionAll(
        steps.select(F.col("b"), F.col("a"), F.lit(1).cast("long")))


def _totals(edges: DataFrame, end: str) -> DataFrame:
    total = edges.groupBy(end).agg(F.sum("weight").alias("total"))
    return edges.join(total, end)


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust). ``nodes``: host, t0, d0; ``edges``: src, dst, weight."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    forward = _totals(edges, "src").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("tw"),
                                           F.col("total").alias("tt"), none.alias("dw"), one.alias("dt"))
    backward = _totals(edges, "dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), none.alias("tw"),
                                            one.alias("tt"), F.col("weight").alias("dw"), F.col("total").alias("dt"))
    flow = tx.settle(forward.unionByName(backward).groupBy("u", "v").agg(
        F.sum("tw").alias("tw"), F.max("tt").alias("tt"), F.sum("dw").alias("dw"), F.max("dt").alias("dt")), "url-flow")
    nodes = nodes.select("host", F.col("t0").cast(SCORE).alias("t0"), F.col("d0").cast(SCORE).alias("d0"))
    state = nodes.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for k in range(1, rounds + 1):
        inward = (state.join(flow, state.host == flow.u).groupBy(F.col("v").alias("host"))
                  .agg(F.sum(_divide("trust * tw", "tt")).alias("t"), F.sum(_divide("distrust * dw", "dt")).alias("d")))
        state = nodes.join(inward, "host", "left").select(
            "host", *[_divide(f"(100 - {DAMPING}) * {seed} + {DAMPING} * coalesce({now}, 0)", "100").alias(name)
                      for seed, now, name in (("t0", "t", "trust"), ("d0", "d", "distrust"))])
        if k % 5 == 0:
            state = tx.settle(state, "url-ranks")
    return state


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    Null urls and urls without ``://`` have empty host and path and are allowed;
    null html has no links; without seeds every page without a rule is allowed.
    Repeated rows are judged alike and count again as seeds and links. Other
    columns are ignored; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url))
    named = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    per_host = tx.settle(ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked")), "url-hosts")
    links = tx.settle(host_edges(named.select("host", "html")), "url-links")
    hosts = per_host.select("host").unionAll(links.select("dst")).distinct()
    edges = (links.unionByName(parent_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    every = hosts.unionAll(edges.select("src")).distinct()
    weights = tx.settle(every.join(per_host, "host", "left").select("host", *[
        F.coalesce(_divide(f"{SEED}BD * {count}", "pages"), F.lit(0).cast(SCORE)).alias(name)
        for count, name in (("allowed", "wt"), ("blocked", "wd"))]), "url-seeds")
    total = weights.agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd"), F.count("*").alias("n")).first()
    nodes = weights.select("host", *[_divide(f"{name} * {TOTAL}BD", f"{max(int(all_ or 0), 1)}BD").alias(seed)
                                     for name, all_, seed in (("wt", total.wt, "t0"), ("wd", total.wd, "d0"))])
    ranks = propagate(nodes, edges)
    bad = ranks.where(F.expr(f"distrust >= {MIN_DISTRUST * TOTAL // max(total.n, 1)}BD AND distrust >= {RATIO} * trust")
                      ).select("host", F.lit("block").alias("spread"))
    return ruled.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def oracle(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same computation, in whole numbers of as many digits, as chained DuckDB queries."""
    low = f"'{_UPPER}', '{_UPPER.lower()}'"
    cases = {k: "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{v(r)}'"
        for r in sorted(rules, key=lambda r: -len(r.name))) + " END" for k, v in (("rule", lambda r: r.name), ("ruled", lambda r: r.verdict))}
    sql = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {low}), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
ruled AS MATERIALIZED (SELECT page_id, host, path, {cases['rule']} AS rule, {cases['ruled']} AS ruled FROM named),
per_host AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
             FROM ruled WHERE host <> '' GROUP BY host),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_HREF.replace("'", "''")}', 1)), {low}) AS dst FROM named),
links AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host FROM per_host UNION SELECT dst FROM links),
steps AS (SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b
          FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts))),
edges AS MATERIALIZED (SELECT src, dst, sum(weight)::BIGINT AS weight FROM
  (FROM links UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) GROUP BY src, dst),
weights AS MATERIALIZED (SELECT host, coalesce({SEED}::HUGEINT * allowed // pages, 0) AS wt, coalesce({SEED}::HUGEINT * blocked // pages, 0) AS wd
  FROM (SELECT host FROM hosts UNION SELECT src FROM edges) LEFT JOIN per_host USING (host)),
total AS (SELECT greatest(coalesce(sum(wt), 0), 1)::HUGEINT AS wt, greatest(coalesce(sum(wd), 0), 1)::HUGEINT AS wd, greatest(count(*), 1)::HUGEINT AS n FROM weights),
r0 AS MATERIALIZED (SELECT host, w.wt * {TOTAL}::HUGEINT // t.wt AS t0, w.wd * {TOTAL}::HUGEINT // t.wd AS d0,
  w.wt * {TOTAL}::HUGEINT // t.wt AS trust, w.wd * {TOTAL}::HUGEINT // t.wd AS distrust FROM weights w, total t),
fwd AS (SELECT src AS u, dst AS v, weight AS tw, sum(weight) OVER (PARTITION BY src) AS tt, 0 AS dw, 1 AS dt FROM edges),
bwd AS (SELECT dst AS u, src AS v, 0 AS tw, 1 AS tt, weight AS dw, sum(weight) OVER (PARTITION BY dst) AS dt FROM edges),
flow AS MATERIALIZED (SELECT u, v, sum(tw)::HUGEINT AS tw, max(tt)::HUGEINT AS tt, sum(dw)::HUGEINT AS dw, max(dt)::HUGEINT AS dt
  FROM (FROM fwd UNION ALL FROM bwd) GROUP BY u, v)"""
    for k in range(1, rounds + 1):
        sql += f""",
r{k} AS MATERIALIZED (SELECT n.host, t0, d0, ({100 - DAMPING} * t0 + {DAMPING} * coalesce(t, 0)) // 100 AS trust,
  ({100 - DAMPING} * d0 + {DAMPING} * coalesce(d, 0)) // 100 AS distrust FROM r{k - 1} n LEFT JOIN
  (SELECT v AS host, sum(trust * tw // tt)::HUGEINT AS t, sum(distrust * dw // dt)::HUGEINT AS d FROM r{k - 1} r JOIN flow ON flow.u = r.host GROUP BY v) i ON i.host = n.host)"""
    return sql + f""",
bad AS (SELECT host FROM r{rounds}, total WHERE distrust >= {MIN_DISTRUST * TOTAL}::HUGEINT // total.n AND distrust >= {RATIO} * trust)
SELECT page_id, ruled.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN bad ON bad.host = ruled.host
"""
