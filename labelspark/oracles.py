"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: the fixture views are the SQL of
FIXTURES.md, and each oracle states the rule directly in SQL (for example,
ICM by exploding label sets rather than by the closed form). Only the base
tables are registered in the oracle engine, so every oracle starts with the
fixture views it needs as CTEs.
"""

from __future__ import annotations

FX_SQL: dict[str, str] = {
    "fx_posts": """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS item_id, text AS cleaned_text, lang, source,
  CASE doc_id % 8
    WHEN 0 THEN concat('RT @user', CAST(doc_id AS VARCHAR), ' ', text)
    WHEN 1 THEN concat('@ab_', CAST(doc_id AS VARCHAR), '-x ', text, ' https://t.co/a', CAST(doc_id AS VARCHAR))
    WHEN 2 THEN concat(text, ' &amp; &#39;x bit.ly/z', CAST(doc_id AS VARCHAR), ' end')
    WHEN 3 THEN concat('<MENTION_1> <MENTION_0> ', text, ' <URL>')
    WHEN 4 THEN NULL
    ELSE text END AS tweet,
  CASE WHEN lang = 'en' AND doc_id % 5 = 0 THEN 'DEV_EN' WHEN lang = 'en' THEN 'TRAIN_EN'
       WHEN lang = 'es' AND doc_id % 5 = 0 THEN 'DEV_ES' WHEN lang = 'es' THEN 'TRAIN_ES' ELSE 'OTHER' END AS split,
  CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'reply' END AS item_type,
  CASE WHEN doc_id % 4 = 0 THEN 'by_politician' ELSE 'by_public' END AS author_type,
  CASE WHEN doc_id % 5 IN (0, 1) THEN 'Female' WHEN doc_id % 5 IN (2, 3) THEN 'Male' END AS gender,
  CASE WHEN count(*) OVER (PARTITION BY text) = 1 THEN 'no duplicates'
       WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'first duplicate'
       ELSE 'duplicate' END AS duplicates
FROM documents""",
    "fx_votes1": """
SELECT doc_id, a AS annotator,
  CASE WHEN (a + doc_id) % 6 < doc_id % 7 THEN 'NO' ELSE 'YES' END AS label
FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(a)
WHERE doc_id % 29 <> 0""",
    "fx_votes2": """
SELECT doc_id, annotator, CASE WHEN label = 'NO' AND doc_id % 10 <> 9 THEN '-' ELSE CASE (doc_id * 3 + annotator % 3 * (doc_id % 4)) % 6 WHEN 0 THEN 'IDEOLOGICAL-INEQUALITY' WHEN 1 THEN 'STEREOTYPING-DOMINANCE' WHEN 2 THEN 'OBJECTIFICATION' WHEN 3 THEN 'SEXUAL-VIOLENCE' WHEN 4 THEN 'MISOGYNY-NON-SEXUAL-VIOLENCE' ELSE 'UNKNOWN' END END AS label
FROM fx_votes1
UNION ALL
SELECT doc_id, annotator, CASE (doc_id + 2) % 6 WHEN 0 THEN 'IDEOLOGICAL-INEQUALITY' WHEN 1 THEN 'STEREOTYPING-DOMINANCE' WHEN 2 THEN 'OBJECTIFICATION' WHEN 3 THEN 'SEXUAL-VIOLENCE' WHEN 4 THEN 'MISOGYNY-NON-SEXUAL-VIOLENCE' ELSE 'UNKNOWN' END AS label
FROM fx_votes1 WHERE label = 'YES' AND (doc_id + annotator) % 3 = 0""",
    "fx_scores": """
SELECT doc_id, ((doc_id * 37) % 101 - 50) / CAST(20 AS DOUBLE) AS b0,
  CASE WHEN doc_id % 50 = 7 THEN ((doc_id * 37) % 101 - 50) / CAST(20 AS DOUBLE)
       ELSE ((doc_id * 59 + 11) % 101 - 50) / CAST(20 AS DOUBLE) END AS b1,
  ((doc_id * 41 + 0) % 101 - 50) / CAST(20 AS DOUBLE) AS c0, ((doc_id * 55 + 7) % 101 - 50) / CAST(20 AS DOUBLE) AS c1, ((doc_id * 69 + 14) % 101 - 50) / CAST(20 AS DOUBLE) AS c2, ((doc_id * 83 + 21) % 101 - 50) / CAST(20 AS DOUBLE) AS c3, ((doc_id * 97 + 28) % 101 - 50) / CAST(20 AS DOUBLE) AS c4, ((doc_id * 111 + 35) % 101 - 50) / CAST(20 AS DOUBLE) AS c5
FROM documents""",
    "fx_scored_log": """
SELECT doc_id, batch_id, (doc_id * 7 + batch_id) % 2 AS pred_binary
FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS t(batch_id)
WHERE (batch_id = 0 AND doc_id % 3 = 0) OR (batch_id = 1 AND doc_id % 3 = 1) OR (batch_id = 2 AND doc_id % 12 = 0)""",
    "fx_metric_log": """
SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS check_no, value AS val_loss
FROM events""",
}

_FX_DEPS = {"fx_votes2": ["fx_votes1"]}


def with_fx(fx: list[str], body: str, ctes: dict[str, str] | None = None) -> str:
    """``WITH <fixtures>, <ctes> <body>``; fixture dependencies come first."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _FX_DEPS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for name in fx:
        add(name)
    parts = [f"{n} AS ({FX_SQL[n]}\n)" for n in order]
    parts += [f"{n} AS ({q}\n)" for n, q in (ctes or {}).items()]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ------------------------------------------------------------ shared pieces
def clean_sql(expr: str) -> str:
    """The seven cleaning substitutions, in order, as nested regexp_replace."""
    # fixed values: the cleaning patterns, in order
    pats = [r"(RT\s@[A-Za-z]+[A-Za-z0-9-_]+)", r"(@[A-Za-z0-9-_]+)", r"https?\S+",
            r"bit.ly/\S+", r"&[\S]+?;", r"<MENTION_[1-9]>", r"<URL>"]
    out = expr
    for p in pats:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return out


# fixed values: category names
CATS = ["IDEOLOGICAL-INEQUALITY", "STEREOTYPING-DOMINANCE", "OBJECTIFICATION",
        "SEXUAL-VIOLENCE", "MISOGYNY-NON-SEXUAL-VIOLENCE"]

L1_COUNTS = """SELECT doc_id, count(*) FILTER (WHERE label = 'NO') AS n_no,
  count(*) FILTER (WHERE label = 'YES') AS n_yes, count(*) AS n_votes FROM fx_votes1 GROUP BY doc_id"""

L2_COUNTS = ("SELECT doc_id, count(*) FILTER (WHERE label = '-') AS dash, "
             + ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS k{i + 1}" for i, c in enumerate(CATS))
             + ", count(*) AS n_votes FROM fx_votes2 GROUP BY doc_id")

ANY_K = "greatest(k1, k2, k3, k4, k5) >= 2"
L2_STRING = ("CASE WHEN dash = 3 THEN NULL WHEN dash > 3 THEN '1,0,0,0,0,0' "
             f"WHEN {ANY_K} THEN concat_ws(',', '0', "
             + ", ".join(f"CAST(CAST(k{i} >= 2 AS INTEGER) AS VARCHAR)" for i in range(1, 6))
             + ") END")
L2_STATUS = (f"CASE WHEN dash = 3 THEN 'tie' WHEN dash > 3 THEN 'ok' WHEN {ANY_K} THEN 'ok' "
             "ELSE 'no_majority' END")
L1_STRING = "CASE WHEN n_no = 3 THEN NULL WHEN n_no > 3 THEN '1,0' ELSE '0,1' END"
L1_STATUS = "CASE WHEN n_no = 3 THEN 'tie' ELSE 'ok' END"

# gold labels of every item voted at both levels, with both statuses
GOLD_CTES = {
    "l1": L1_COUNTS,
    "l2": L2_COUNTS,
    "gold": f"""SELECT doc_id, {L1_STATUS} AS b_status, {L2_STATUS} AS c_status,
  CASE WHEN n_no > 3 THEN 0 ELSE 1 END AS y_bin,
  CASE WHEN dash > 3 THEN 1 ELSE 0 END AS g0,
  CASE WHEN dash < 3 AND k1 >= 2 THEN 1 ELSE 0 END AS g1,
  CASE WHEN dash < 3 AND k2 >= 2 THEN 1 ELSE 0 END AS g2,
  CASE WHEN dash < 3 AND k3 >= 2 THEN 1 ELSE 0 END AS g3,
  CASE WHEN dash < 3 AND k4 >= 2 THEN 1 ELSE 0 END AS g4,
  CASE WHEN dash < 3 AND k5 >= 2 THEN 1 ELSE 0 END AS g5
FROM l1 JOIN l2 USING (doc_id)""",
}

# ---------------------------------------------------------------- consensus
oracle("vote_counts", with_fx(["fx_votes1", "fx_votes2"], """
SELECT doc_id,
  count(*) FILTER (WHERE lvl = 1 AND label = 'NO') AS n1_0,
  count(*) FILTER (WHERE lvl = 1 AND label = 'YES') AS n1_1,
  count(*) FILTER (WHERE lvl = 2 AND label = '-') AS n2_0,
""" + ",\n".join(f"  count(*) FILTER (WHERE lvl = 2 AND label = '{c}') AS n2_{i + 1}"
                 for i, c in enumerate(CATS)) + """,
  count(*) FILTER (WHERE lvl = 1) AS votes1,
  count(*) FILTER (WHERE lvl = 2) AS votes2
FROM (SELECT doc_id, 1 AS lvl, label FROM fx_votes1
      UNION ALL SELECT doc_id, 2 AS lvl, label FROM fx_votes2) v
GROUP BY doc_id"""))

oracle("consensus_l1", with_fx(["fx_votes1"], f"""
SELECT doc_id, {L1_STRING} AS binary_labels, {L1_STATUS} AS binary_status FROM l1""",
                               {"l1": L1_COUNTS}))

oracle("consensus_l2", with_fx(["fx_votes2"], f"""
SELECT doc_id, {L2_STRING} AS category_labels, {L2_STATUS} AS category_status FROM l2""",
                               {"l2": L2_COUNTS}))

oracle("flatten_votes", with_fx(["fx_votes2"], """
SELECT doc_id, label, count(*) AS n_votes FROM fx_votes2 GROUP BY doc_id, label"""))

oracle("filter_split", with_fx(["fx_posts"], """
SELECT doc_id, split FROM fx_posts WHERE split IN ('TRAIN_EN', 'TRAIN_ES')"""))

oracle("drop_missing", with_fx(["fx_posts"], """
SELECT doc_id, item_id, gender FROM fx_posts WHERE tweet IS NOT NULL"""))

_PREP = {
    "l1": L1_COUNTS, "l2": L2_COUNTS,
    "j": f"""SELECT p.doc_id, {clean_sql('p.tweet')} AS text,
  {L1_STRING} AS binary_labels, {L2_STRING} AS category_labels,
  n_no <> 3 AS b_ok, dash <> 3 AND (dash > 3 OR {ANY_K}) AS c_ok
FROM fx_posts p JOIN l1 USING (doc_id) JOIN l2 USING (doc_id)
WHERE p.split IN ('TRAIN_EN', 'TRAIN_ES')""",
}

oracle("drop_undecided_report", with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT b_ok) AS binary_ties,
  count(*) FILTER (WHERE b_ok AND NOT c_ok) AS category_ties,
  count(*) FILTER (WHERE b_ok AND c_ok) AS rows_kept FROM j""", _PREP))

oracle("prepare_labels", with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT doc_id, text, binary_labels, category_labels FROM j WHERE b_ok AND c_ok""", _PREP))


# ------------------------------------------------------------- text, posts
oracle("clean_text", with_fx(["fx_posts"], f"""
SELECT doc_id, {clean_sql('tweet')} AS text FROM fx_posts"""))

_RAW_ID = """CASE WHEN doc_id % 4 = 0 THEN 'tensor(' || CAST(doc_id AS VARCHAR) || ')'
  WHEN doc_id % 4 = 1 THEN ' tensor(' || CAST(doc_id AS VARCHAR) || ') '
  WHEN doc_id % 4 = 2 THEN 'x' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END"""

oracle("normalise_id", f"""
SELECT doc_id, TRY_CAST(t AS BIGINT) AS id_num, t AS id_text
FROM (SELECT doc_id, trim(replace(replace({_RAW_ID}, 'tensor(', ''), ')', '')) AS t FROM documents)""")

oracle("harmonise_posts", with_fx(["fx_posts"], """
SELECT doc_id, item_id, cleaned_text AS text FROM fx_posts"""))

oracle("filter_posts", with_fx(["fx_posts"], """
SELECT doc_id, item_id, duplicates FROM fx_posts
WHERE item_type = 'reply' AND author_type = 'by_public'
  AND (duplicates = 'no duplicates' OR duplicates = 'first duplicate')"""))

oracle("surrogate_ids", with_fx(["fx_posts"], """
SELECT doc_id, item_id, row_number() OVER (ORDER BY md5('51:' || item_id), item_id) AS data_id
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'x' || item_id ELSE item_id END AS item_id
      FROM fx_posts)"""))

_SIG = "1 / (1 + exp(-({x})))"
_THR = [f"CAST({_SIG.format(x=f'c{i}')} >= 0.5 AS INTEGER)" for i in range(6)]

oracle("parse_label_list", with_fx(["fx_scores"], f"""
SELECT doc_id, CAST(len(arr) AS INTEGER) AS n, CAST(list_sum(arr) AS INTEGER) AS n_pos,
  array_to_string(arr, ',') AS pred_category
FROM (SELECT doc_id, CAST(json('[' || concat_ws(', ', {', '.join(_THR)}) || ']') AS INTEGER[]) AS arr
      FROM fx_scores)"""))

# ---------------------------------------------------------------- predict
_PROB = "1 / (1 + exp(b0 - b1))"
_PRED = (f"SELECT doc_id, b0, b1, {', '.join(f'c{i}' for i in range(6))}, {_PROB} AS prob, "
         f"CASE WHEN {_PROB} >= 0.5 THEN 1 ELSE 0 END AS pb, "
         + ", ".join(f"CASE WHEN {_PROB} >= 0.5 THEN {_THR[i]} ELSE {1 if i == 0 else 0} END AS p{i}"
                     for i in range(6))
         + " FROM fx_scores")
_PCAT = "concat_ws(',', " + ", ".join(f"CAST(p{i} AS VARCHAR)" for i in range(6)) + ")"

oracle("binary_prob", with_fx(["fx_scores"], f"""
SELECT doc_id, round({_PROB}, 6) AS pred_binary_prob FROM fx_scores"""))

oracle("category_conf", with_fx(["fx_scores"], "SELECT doc_id, " + ", ".join(
    f"round({_SIG.format(x=f'c{i}')}, 6) AS conf_{i}" for i in range(6)) + " FROM fx_scores"))

oracle("threshold_labels", with_fx(["fx_scores"], "SELECT doc_id, concat_ws(',', " + ", ".join(
    f"CAST({t} AS VARCHAR)" for t in _THR) + ") AS labels FROM fx_scores"))

_ARGMAX_C = ("CASE " + " ".join(
    f"WHEN c{i} = greatest(c0, c1, c2, c3, c4, c5) THEN {i}" for i in range(6)) + " END")
oracle("argmax_label", with_fx(["fx_scores"], f"""
SELECT doc_id, CASE WHEN b1 > b0 THEN 1 ELSE 0 END AS binary_argmax,
  {_ARGMAX_C} AS category_argmax FROM fx_scores"""))

oracle("gate_predictions", with_fx(["fx_scores"], f"""
SELECT doc_id, pb AS pred_binary, {_PCAT} AS pred_category FROM pr""", {"pr": _PRED}))

oracle("gate_logits", with_fx(["fx_scores"], "SELECT doc_id, " + ", ".join(
    f"CASE WHEN b1 > b0 THEN c{i} ELSE {'1.0' if i == 0 else '-1.0'} END AS g{i}" for i in range(6))
    + " FROM fx_scores"))

_NAMES = ["-"] + CATS
_PIPE = ("coalesce(nullif(concat_ws('|', " + ", ".join(
    f"CASE WHEN p{i} = 1 THEN '{n}' END" for i, n in enumerate(_NAMES)) + "), ''), '-')")
oracle("label_names", with_fx(["fx_scores"], f"""
SELECT doc_id, CAST(p0 + p1 + p2 + p3 + p4 + p5 AS INTEGER) AS n_labels,
  {_PIPE} AS pred_category_pipe FROM pr""", {"pr": _PRED}))

# fixed values: labels of the group study
_GS = ["Profanity", "Insults", "Char. Assassination", "Outrage", "Discrimination", "Hostility",
       "Incivility", "Intolerance"]
_GS_LOGITS = ["b0", "b1"] + [f"c{i}" for i in range(6)]
_STRICT = ("coalesce(nullif(concat_ws(', ', " + ", ".join(
    f"CASE WHEN 100 * {_SIG.format(x=x)} > 50 THEN '{n}' END" for x, n in zip(_GS_LOGITS, _GS))
    + "), ''), 'none')")
oracle("strict_label_names", with_fx(["fx_scores"], f"""
SELECT doc_id, {_STRICT} AS predicted_label FROM fx_scores"""))

oracle("contradictions", with_fx(["fx_scores"], f"""
SELECT doc_id, {_PCAT} AS pred_category FROM pr
WHERE p0 = 1 AND (p1 = 1 OR p2 = 1 OR p3 = 1 OR p4 = 1 OR p5 = 1)""", {"pr": _PRED}))

oracle("predict_labels", with_fx(["fx_scores"], f"""
SELECT doc_id, pb AS pred_binary, round(prob, 6) AS pred_binary_prob, {_PCAT} AS pred_category
FROM pr""", {"pr": _PRED}))


# ----------------------------------------------------------------- metrics
# evaluation rows: decided gold joined to fixture logits, with predictions
EV_CTES = dict(GOLD_CTES)
EV_CTES["pr"] = _PRED
EV_CTES["ev"] = """SELECT g.doc_id, g.y_bin, g.g0, g.g1, g.g2, g.g3, g.g4, g.g5, pr.*
FROM gold g JOIN pr USING (doc_id) WHERE g.b_status = 'ok' AND g.c_status = 'ok'"""
EV_FX = ["fx_votes1", "fx_votes2", "fx_scores"]

_TRAIN = dict(GOLD_CTES)
_TRAIN["tr"] = """SELECT g.* FROM gold g JOIN fx_posts p USING (doc_id)
WHERE p.split IN ('TRAIN_EN', 'TRAIN_ES') AND g.b_status = 'ok' AND g.c_status = 'ok'"""
_cw = [(1, 0, "NO", "1 - y_bin"), (1, 1, "YES", "y_bin")] + [
    (2, i, n, f"g{i}") for i, n in enumerate(_NAMES)]
_TRAIN["cw"] = "\nUNION ALL ".join(
    f"SELECT {lv} AS level, {i} AS label_index, '{n}' AS label, CAST(sum({e}) AS BIGINT) AS pos, "
    f"count(*) AS n FROM tr" for lv, i, n, e in _cw)
oracle("class_weights", with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT level, label_index, label, pos,
  round(CASE WHEN pos > 0 THEN (n - pos) / pos ELSE CAST(n - pos AS DOUBLE) END, 6) AS weight
FROM cw""", _TRAIN))


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0001), 0.9999)"


# binary focal loss written as -log softmax = ln(1 + exp(b_other - b_y))
_B_Y = "CASE WHEN y_bin = 1 THEN b1 ELSE b0 END"
_B_O = "CASE WHEN y_bin = 1 THEN b0 ELSE b1 END"
_CE = f"ln(1 + exp(({_B_O}) - ({_B_Y})))"
_PT = _clamp(f"1 / (1 + exp(({_B_O}) - ({_B_Y})))")


def _bce(i: int, weight: str = "1") -> str:
    x, y = f"c{i}", f"g{i}"
    p = f"1 / (1 + exp(-{x}))"
    pt = _clamp(f"CASE WHEN {y} = 1 THEN {p} ELSE 1 - {p} END")
    return f"pow(1 - {pt}, 2) * ({weight}) * (greatest({x}, 0) - {x} * {y} + ln(1 + exp(-abs({x}))))"


_W = dict(EV_CTES)
_W["wb"] = """SELECT CASE WHEN sum(1 - y_bin) > 0 THEN sum(y_bin) / sum(1 - y_bin) ELSE sum(y_bin) END AS w0,
  CASE WHEN sum(y_bin) > 0 THEN sum(1 - y_bin) / sum(y_bin) ELSE sum(1 - y_bin) END AS w1 FROM ev"""
_W["wc"] = "SELECT " + ", ".join(
    f"CASE WHEN sum(g{i}) > 0 THEN (count(*) - sum(g{i})) / sum(g{i}) "
    f"ELSE count(*) - sum(g{i}) END AS w{i}" for i in range(6)) + " FROM ev"
oracle("focal_ce", with_fx(EV_FX, f"""
SELECT doc_id, round((1 - {_PT}) * (CASE WHEN y_bin = 1 THEN w1 ELSE w0 END) * {_CE}, 6) AS loss
FROM ev, wb""", _W))

oracle("focal_bce", with_fx(EV_FX, "SELECT doc_id, " + ", ".join(
    f"round({_bce(i, f'wc.w{i}')}, 6) AS loss_{i}" for i in range(6)) + " FROM ev, wc", _W))

_ROWLOSS = dict(EV_CTES)
_ROWLOSS["rl"] = (f"SELECT doc_id, y_bin, (1 - {_PT}) * {_CE} AS lb, ("
                  + " + ".join(_bce(i) for i in range(6)) + ") / 6 AS lc FROM ev")
_LOSS_AGG = """sum(lc * y_bin) / greatest(sum(y_bin), 1)"""
oracle("loss_summary", with_fx(EV_FX, f"""
SELECT round(avg(lb) + {_LOSS_AGG}, 6) AS loss, round(avg(lb), 6) AS loss_binary,
  round({_LOSS_AGG}, 6) AS loss_category FROM rl""", _ROWLOSS))

_BATCH = dict(_ROWLOSS)
_BATCH["rb"] = """SELECT *, (row_number() OVER (ORDER BY md5('51:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // 16 AS batch_id FROM rl"""
_BATCH["pb"] = f"""SELECT batch_id, avg(lb) + {_LOSS_AGG} AS loss, avg(lb) AS loss_binary,
  {_LOSS_AGG} AS loss_category FROM rb GROUP BY batch_id"""
oracle("loss_by_batch", with_fx(EV_FX, """
SELECT round(avg(loss), 6) AS loss, round(avg(loss_binary), 6) AS loss_binary,
  round(avg(loss_category), 6) AS loss_category, count(*) AS n_batches FROM pb""", _BATCH))

oracle("f1_binary", with_fx(EV_FX, """
SELECT tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT count(*) FILTER (WHERE pb = 1 AND y_bin = 1) AS tp,
             count(*) FILTER (WHERE pb = 1 AND y_bin = 0) AS fp,
             count(*) FILTER (WHERE pb = 0 AND y_bin = 1) AS fn FROM ev)""", EV_CTES))

# per-label confusion by exploding labels to (row, label) pairs
_PL = dict(EV_CTES)
_PL["lab"] = """SELECT doc_id, unnest(range(6)) AS i, unnest([g0, g1, g2, g3, g4, g5]) AS g,
  unnest([p0, p1, p2, p3, p4, p5]) AS p FROM ev"""
_PL["names"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") AS t(i, label)"
_PL["pl"] = """SELECT CAST(lab.i AS INTEGER) AS label_index, names.label,
  count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g <> 1 AND p = 1) AS fp,
  count(*) FILTER (WHERE g = 1 AND p <> 1) AS fn FROM lab JOIN names ON lab.i = names.i
GROUP BY lab.i, names.label"""
_PL["plf"] = """SELECT *, tp + fn AS support,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM pl"""
oracle("f1_per_label", with_fx(EV_FX, """
SELECT label_index, label, tp, fp, fn, support, round(f1, 6) AS f1 FROM plf""", _PL))
oracle("f1_macro", with_fx(EV_FX, "SELECT round(avg(f1), 6) AS f1_macro FROM plf", _PL))
oracle("f1_weighted", with_fx(EV_FX, """
SELECT round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1 * support) / sum(support) END, 6)
  AS f1_weighted FROM plf""", _PL))

# ICM priors and information content, by exploding label sets
_IC = dict(_PL)
_IC["pri"] = ("SELECT " + ", ".join(f"sum(g{i}) / count(*) + 1 / count(*) AS p{i}" for i in range(6))
              + ", count(*) FILTER (WHERE g1 + g2 + g3 + g4 + g5 > 0) / count(*) + 1 / count(*) AS p_parent, "
              "CAST(1.0 AS DOUBLE) AS p_root, count(*) AS n_rows FROM ev")
_IC["node_ic"] = ("SELECT i, -log2(p) AS ic FROM (SELECT unnest(range(6)) AS i, unnest(["
                  + ", ".join(f"p{i}" for i in range(6)) + "]) AS p FROM pri)")
_IC["parent_ic"] = "SELECT -log2(p_parent) AS icp FROM pri"


def _set_ic_cte(flag_expr: str) -> str:
    """IC per row of the set {i : flag_expr = 1}, flags read from ``lab``."""
    return f"""SELECT lab.doc_id,
  coalesce(sum(node_ic.ic) FILTER (WHERE {flag_expr} = 1), 0)
  - greatest(count(*) FILTER (WHERE {flag_expr} = 1 AND lab.i > 0) - 1, 0) * max(parent_ic.icp) AS ic
FROM lab JOIN node_ic ON lab.i = node_ic.i, parent_ic GROUP BY lab.doc_id"""


_IC["ic_g"] = _set_ic_cte("g")
_IC["ic_p"] = _set_ic_cte("p")
_IC["ic_u"] = _set_ic_cte("greatest(g, p)")

oracle("icm_priors", with_fx(EV_FX, "SELECT " + ", ".join(
    f"round(p{i}, 6) AS p{i}" for i in range(6))
    + ", round(p_parent, 6) AS p_parent, round(p_root, 6) AS p_root, n_rows FROM pri", _IC))

oracle("label_set_ic", with_fx(EV_FX, """
SELECT ic_g.doc_id, round(ic_g.ic, 6) AS ic_gold, round(ic_p.ic, 6) AS ic_pred
FROM ic_g JOIN ic_p USING (doc_id)""", _IC))

_ICM = dict(_IC)
_ICM["icm"] = """SELECT avg(2 * ic_g.ic + 2 * ic_p.ic - 3 * ic_u.ic) AS icm
FROM ic_g JOIN ic_p USING (doc_id) JOIN ic_u USING (doc_id)"""
oracle("icm_score", with_fx(EV_FX, "SELECT round(icm, 6) AS icm FROM icm", _ICM))

# ICM over declared trees: closure by recursion, information content by closure rows
_TREE = dict(_PL)
_TREE["declared"] = """SELECT tree, label, CASE WHEN i = 0 THEN NULL WHEN tree = 'scheme' THEN 'YES'
    WHEN label LIKE '%VIOLENCE%' THEN 'VIOLENCE' ELSE 'ATTITUDE' END AS parent
  FROM names, (VALUES ('scheme'), ('grouped')) t(tree)
  UNION ALL SELECT * FROM (VALUES ('scheme', 'YES', NULL), ('grouped', 'YES', NULL),
    ('grouped', 'VIOLENCE', 'YES'), ('grouped', 'ATTITUDE', 'YES')) v(tree, label, parent)"""
_TREE["clo"] = """SELECT tree, label, label AS node FROM declared
  UNION ALL SELECT tree, label, parent FROM declared WHERE parent IS NOT NULL
  UNION ALL SELECT a.tree, a.label, b.parent FROM declared a JOIN declared b ON a.tree = b.tree AND a.parent = b.label
    WHERE b.parent IS NOT NULL"""
_TREE["has"] = """SELECT tree, doc_id, node, max(g) AS g, max(p) AS p, max(greatest(g, p)) AS u
  FROM lab JOIN names ON lab.i = names.i JOIN clo USING (label) GROUP BY tree, doc_id, node"""
_TREE["tp"] = """SELECT d.tree, d.label AS node, d.parent, CAST(coalesce(sum(h.g), 0) AS BIGINT) AS g,
    (SELECT count(*) FROM ev) AS n_rows FROM declared d LEFT JOIN has h ON d.tree = h.tree AND d.label = h.node
  GROUP BY d.tree, d.label, d.parent"""
_TREE["ti"] = "SELECT *, g / n_rows + 1 / n_rows AS prior, -log2(g / n_rows + 1 / n_rows) AS ic FROM tp"
_TREE["td"] = """SELECT a.*, a.ic - coalesce(b.ic, 0) AS delta
  FROM ti a LEFT JOIN ti b ON a.tree = b.tree AND a.parent = b.node"""
_TREE["tset"] = """SELECT e.tree, e.doc_id, coalesce(sum(g * delta), 0) AS ic_g, coalesce(sum(p * delta), 0) AS ic_p,
    coalesce(sum(u * delta), 0) AS ic_u
  FROM (SELECT doc_id, tree FROM ev, (VALUES ('scheme'), ('grouped')) t(tree)) e
  LEFT JOIN (SELECT has.*, td.delta FROM has JOIN td USING (tree, node)) h ON e.tree = h.tree AND e.doc_id = h.doc_id
  GROUP BY e.tree, e.doc_id"""
oracle("tree_priors", with_fx(EV_FX, """
SELECT node, parent, CAST(g AS BIGINT) AS g, n_rows, round(prior, 6) AS prior, round(ic, 6) AS ic, round(delta, 6) AS delta
FROM td WHERE tree = 'grouped'""", _TREE))
oracle("tree_set_ic", with_fx(EV_FX, """
SELECT doc_id, round(ic_g, 6) AS ic_gold, round(ic_p, 6) AS ic_pred FROM tset WHERE tree = 'grouped'""", _TREE))
oracle("tree_icm", with_fx(EV_FX, """
SELECT tree, 'gold' AS prediction, round(avg(ic_g), 6) AS icm FROM tset GROUP BY tree
UNION ALL SELECT tree, 'predicted', round(avg(2 * ic_g + 2 * ic_p - 3 * ic_u), 6) FROM tset GROUP BY tree""", _TREE))

# baselines: the same set IC over constant prediction vectors
_BASE = dict(_ICM)
_BASE["ic_gold_u"] = _set_ic_cte("g")
_BASE["ic_maj"] = _set_ic_cte("CASE WHEN lab.i = 0 THEN 1 ELSE 0 END")
_BASE["ic_maj_u"] = _set_ic_cte("greatest(g, CASE WHEN lab.i = 0 THEN 1 ELSE 0 END)")
_BASE["ic_min"] = _set_ic_cte("CASE WHEN lab.i = 4 THEN 1 ELSE 0 END")
_BASE["ic_min_u"] = _set_ic_cte("greatest(g, CASE WHEN lab.i = 4 THEN 1 ELSE 0 END)")
_BASE["bl"] = """
SELECT 'gold' AS prediction, avg(2 * a.ic + 2 * a.ic - 3 * a.ic) AS icm FROM ic_g a
UNION ALL SELECT 'majority', avg(2 * a.ic + 2 * b.ic - 3 * c.ic)
  FROM ic_g a JOIN ic_maj b USING (doc_id) JOIN ic_maj_u c USING (doc_id)
UNION ALL SELECT 'minority', avg(2 * a.ic + 2 * b.ic - 3 * c.ic)
  FROM ic_g a JOIN ic_min b USING (doc_id) JOIN ic_min_u c USING (doc_id)
UNION ALL SELECT 'predicted', icm FROM icm"""
oracle("icm_baselines", with_fx(EV_FX, "SELECT prediction, round(icm, 6) AS icm FROM bl", _BASE))

_REP = dict(_BASE)
_REP.update({k: v for k, v in _ROWLOSS.items() if k == "rl"})
_REP["f1b"] = """SELECT CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM (SELECT count(*) FILTER (WHERE pb = 1 AND y_bin = 1) AS tp,
             count(*) FILTER (WHERE pb = 1 AND y_bin = 0) AS fp,
             count(*) FILTER (WHERE pb = 0 AND y_bin = 1) AS fn FROM ev)"""
oracle("evaluation_report", with_fx(EV_FX, f"""
SELECT metric, label, round(value, 6) AS value FROM (
  SELECT 'loss' AS metric, 'all' AS label, avg(lb) + {_LOSS_AGG} AS value FROM rl
  UNION ALL SELECT 'loss_binary', 'all', avg(lb) FROM rl
  UNION ALL SELECT 'loss_category', 'all', {_LOSS_AGG} FROM rl
  UNION ALL SELECT 'f1_binary', 'YES', f1 FROM f1b
  UNION ALL SELECT 'f1', label, f1 FROM plf
  UNION ALL SELECT 'f1_macro', 'all', avg(f1) FROM plf
  UNION ALL SELECT 'f1_weighted', 'all', CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1 * support) / sum(support) END FROM plf
  UNION ALL SELECT 'icm_' || prediction, 'all', icm FROM bl)""", _REP))


# ---------------------------------------------------------------- sampling
def _md5(seed: int | str, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


oracle("dedup_first", with_fx(["fx_scored_log"], """
SELECT doc_id, min(batch_id) AS batch_id, arg_min(pred_binary, batch_id) AS pred_binary
FROM fx_scored_log GROUP BY doc_id"""))

_FILTERED = """SELECT doc_id, item_id FROM fx_posts WHERE item_type = 'reply'
  AND author_type = 'by_public' AND duplicates IN ('no duplicates', 'first duplicate')
  AND cleaned_text IS NOT NULL"""
oracle("sample_n", with_fx(["fx_posts"], f"""
SELECT doc_id, item_id FROM ({_FILTERED}) ORDER BY {_md5('42:sample_n', 'item_id')}, item_id LIMIT 100"""))

_TR = dict(_PREP)
_TR["t"] = "SELECT doc_id, CAST(binary_labels = '0,1' AS INTEGER) AS y_bin FROM j WHERE b_ok AND c_ok"
_TRFX = ["fx_posts", "fx_votes1", "fx_votes2"]
oracle("sample_frac", with_fx(_TRFX, f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_md5('42:sample_frac', 'doc_id')}, doc_id) AS rn,
  count(*) OVER () AS n FROM t) WHERE rn <= round_even(CAST(0.2 AS DOUBLE) * n, 0)""", _TR))

_SPLIT = dict(_TR)
_SPLIT["c"] = "SELECT y_bin, CAST(count(*) AS DOUBLE) AS cnt FROM t GROUP BY y_bin"
_SPLIT["tot"] = "SELECT sum(cnt) AS n, sum(cnt) - ceil(CAST(0.05 AS DOUBLE) * sum(cnt)) AS n_train FROM c"
_SPLIT["al"] = "SELECT y_bin, cnt, cnt / n * n_train AS cont, floor(cnt / n * n_train) AS fl, n_train FROM c, tot"
_SPLIT["al2"] = """SELECT *, row_number() OVER (ORDER BY cont - fl DESC, y_bin) AS rk,
  n_train - sum(fl) OVER () AS extra FROM al"""
_SPLIT["held"] = "SELECT y_bin, cnt - fl - CASE WHEN rk <= extra THEN 1 ELSE 0 END AS n_held FROM al2"
_SPLIT["r"] = f"""SELECT doc_id, y_bin, row_number() OVER (PARTITION BY y_bin
  ORDER BY {_md5('42:stratified_split', 'doc_id')}, doc_id) AS rn FROM t"""
oracle("stratified_split", with_fx(_TRFX, """
SELECT doc_id, y_bin, CASE WHEN rn <= n_held THEN 'held_out' ELSE 'train' END AS part
FROM r JOIN held USING (y_bin)""", _SPLIT))

oracle("sample_per_group", with_fx(["fx_scores"], f"""
SELECT doc_id, pred_binary FROM (SELECT doc_id, pb AS pred_binary, row_number() OVER (
  PARTITION BY pb ORDER BY {_md5(51, 'doc_id')}, doc_id) AS rn FROM pr) WHERE rn <= 10""",
                                   {"pr": _PRED}))

oracle("shuffle_rows", with_fx(_TRFX, f"""
SELECT doc_id, row_number() OVER (ORDER BY {_md5(42, 'doc_id')}, doc_id) - 1 AS pos FROM t""", _TR))

oracle("batch_ids", with_fx(_TRFX, f"""
SELECT doc_id, (row_number() OVER (ORDER BY {_md5(42, 'doc_id')}, doc_id) - 1) // 32 AS batch_id
FROM t""", _TR))


# ------------------------------------------------------------- training
_HEADS = ["-", *CATS]
_FIT = dict(_PREP)
_FIT["t"] = """SELECT doc_id, CAST(binary_labels = '0,1' AS INTEGER) AS y, string_split(category_labels, ',') AS c
FROM j WHERE b_ok AND c_ok"""
_FIT["heads"] = " UNION ALL ".join(
    ["SELECT 'binary' AS head, count(*) AS n_rows, sum(y) AS positives, count(*) AS n, sum(y) AS pos FROM t"]
    + [f"SELECT '{name}', count(*) FILTER (WHERE y = 1), count(*) FILTER (WHERE y = 1 AND c[{j + 1}] = '1'), "
       f"count(*), count(*) FILTER (WHERE c[{j + 1}] = '1') FROM t" for j, name in enumerate(_HEADS)])

oracle("train_two_head", with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT head, n_rows, CAST(positives AS BIGINT) AS positives,
  round(CASE WHEN pos = 0 THEN n ELSE (n - pos) / pos END, 6) AS class_weight,
  positives IN (0, n_rows) AS constant, true AS converged, true AS loss_fell FROM heads""", _FIT))

oracle("trial_ranks", with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT unnest([1, 2, 3])::BIGINT AS rank, CAST(n - ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS n_train,
  CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS n_held_out, true AS converged, true AS in_order
FROM (SELECT round_even(CAST(0.2 AS DOUBLE) * count(*), 0) AS n FROM t)""", _FIT))


# ------------------------------------------------------- scoring and jobs
def _length_logits(text: str, k: int) -> str:
    """The stand-in scorer's logits from the text length, as SQL."""
    n = f"length({text})"
    cols = ["CAST(0 AS DOUBLE) AS b0", f"(({n} * 37) % 101 - 50) / 20 AS b1"]
    cols += [f"(({n} * {41 + 14 * j} + {7 * j}) % 101 - 50) / 20 AS c{j}" for j in range(k)]
    return ", ".join(cols)


def _pred_from(src: str, extra: str) -> str:
    return (f"SELECT {extra}, {_PROB} AS prob, CASE WHEN {_PROB} >= 0.5 THEN 1 ELSE 0 END AS pb, "
            + ", ".join(f"CASE WHEN {_PROB} >= 0.5 THEN {_THR[i]} ELSE {1 if i == 0 else 0} END AS p{i}"
                        for i in range(6)) + f" FROM {src}")


oracle("score_posts", with_fx(["fx_posts"], f"""
SELECT doc_id, {_length_logits('cleaned_text', 6)} FROM fx_posts"""))

_JOB = {
    "jp": """SELECT CASE WHEN doc_id % 7 = 3 THEN 'x' || item_id ELSE item_id END AS item_id,
  tweet AS text, gender FROM fx_posts WHERE tweet IS NOT NULL""",
}
_JOB["lg"] = f"SELECT item_id, text, gender, {_length_logits('text', 6)} FROM jp"
_JOB["jpr"] = _pred_from("lg", "item_id, text, gender")
_JOB["lab"] = f"""SELECT item_id AS data_id, text, pb AS pred_binary, round(prob, 6) AS pred_binary_prob,
  {_PCAT} AS pred_category, {_PIPE} AS pred_category_pipe,
  (p0 = 1 AND (p1 = 1 OR p2 = 1 OR p3 = 1 OR p4 = 1 OR p5 = 1)) AS contradiction, gender FROM jpr"""

oracle("scoring_job", with_fx(["fx_posts"], """
SELECT data_id, text, pred_binary, pred_binary_prob, pred_category, pred_category_pipe, contradiction
FROM lab""", _JOB))

_DIRTY = {"dp": "SELECT doc_id, CAST(doc_id // 2 AS VARCHAR) AS item_id, tweet AS text FROM fx_posts WHERE tweet IS NOT NULL",
          "np": "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN item_id END AS item_id, text FROM dp"}
_DIRTY["dl"] = f"SELECT doc_id, item_id, text, {_length_logits('text', 6)} FROM dp"
_DIRTY["df"] = "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rn FROM dl"
_DIRTY["dr"] = _pred_from("df", "item_id, rn")
_DIRTY["nl"] = f"SELECT item_id, text, {_length_logits('text', 6)} FROM np"
_DIRTY["nr"] = _pred_from("nl", "item_id, text")
_DIRTY_COLS = f"pb AS pred_binary, round(prob, 6) AS pred_binary_prob, {_PCAT} AS pred_category"
oracle("scoring_job_repeated_ids", with_fx(["fx_posts"], f"""
SELECT p.item_id AS data_id, p.text, {_DIRTY_COLS} FROM dp p JOIN dr ON dr.item_id = p.item_id AND rn = 1""", _DIRTY))
oracle("scoring_job_null_ids", with_fx(["fx_posts"], f"""
SELECT item_id AS data_id, text, {_DIRTY_COLS} FROM nr""", _DIRTY))

oracle("prediction_checks", with_fx(["fx_posts"], """
SELECT n_predictions, binary_sentinels, category_sentinels, n_inputs,
  binary_sentinels = 0 AND category_sentinels = 0 AND n_predictions <= n_inputs AS ok
FROM (SELECT count(DISTINCT data_id) AS n_predictions, count(*) FILTER (WHERE pred_binary = 99) AS binary_sentinels,
  count(*) FILTER (WHERE contains(pred_category, '99')) AS category_sentinels,
  (SELECT count(*) FROM jp) AS n_inputs FROM lab)""", _JOB))

oracle("funnel", with_fx(["fx_posts"], """
SELECT 0 AS stage_no, 'input' AS stage, count(*) AS n_rows FROM fx_posts
UNION ALL SELECT 1, 'with_text', count(*) FROM jp
UNION ALL SELECT 2, 'predictions', count(*) FROM jp
UNION ALL SELECT 3, 'deduplicated', count(DISTINCT item_id) FROM jp
UNION ALL SELECT 4, 'labelled', count(*) FROM jp""", _JOB))

oracle("positive_rate", with_fx(["fx_posts"], """
SELECT gender, round(100 * avg(pred_binary), 6) AS pct_positive FROM lab
WHERE gender IS NOT NULL GROUP BY gender""", _JOB))

_STREAM = {"slg": f"SELECT item_id, {_length_logits('cleaned_text', 6)} FROM fx_posts"}
_STREAM["spr"] = _pred_from("slg", "item_id")
oracle("stream_scoring", with_fx(["fx_posts"], f"""
SELECT item_id, pb AS pred_binary, round(prob, 6) AS pred_binary_prob, {_PCAT} AS pred_category
FROM spr""", _STREAM))

_GS_LIST = ["none"] + _GS


def _prevalence(src: str, where: str = "gender IS NOT NULL") -> str:
    """Percent per gender of rows whose label string contains each label."""
    return "\nUNION ALL ".join(
        f"SELECT gender, '{lab}' AS label, round(100 * count(*) FILTER "
        f"(WHERE contains(predicted_label, '{lab}')) / count(*), 6) AS pct FROM {src} "
        f"WHERE {where} GROUP BY gender" for lab in _GS_LIST)


_STRICT8 = ("coalesce(nullif(concat_ws(', ', " + ", ".join(
    f"CASE WHEN 100 * {_SIG.format(x=f'c{j}')} > 50 THEN '{n}' END" for j, n in enumerate(_GS))
    + "), ''), 'none')")
_GROUP = {
    "chosen": f"""SELECT item_id, cleaned_text AS text FROM fx_posts WHERE item_type = 'reply'
  AND author_type = 'by_public' AND duplicates IN ('no duplicates', 'first duplicate')
  AND cleaned_text IS NOT NULL ORDER BY {_md5('42:sample_n', 'item_id')}, item_id LIMIT 10000""",
}
_GROUP["glg"] = f"SELECT item_id, {_length_logits('text', 8)} FROM chosen"
_GROUP["gpred"] = f"SELECT item_id, {_STRICT8} AS predicted_label FROM glg"
_GROUP["gj"] = "SELECT g.item_id, g.predicted_label, p.gender FROM gpred g LEFT JOIN fx_posts p USING (item_id)"
oracle("group_study", with_fx(["fx_posts"], _prevalence("gj", "gender IN ('Female', 'Male')"),
                              _GROUP))
oracle("value_counts", with_fx(["fx_posts"], """
SELECT predicted_label, count(*) AS count FROM gpred GROUP BY predicted_label""", _GROUP))
oracle("join_demographics", with_fx(["fx_posts"], "SELECT item_id, predicted_label, gender FROM gj",
                                    _GROUP))

_STORED = {"st": f"""SELECT CAST(doc_id AS VARCHAR) AS item_id, {_STRICT} AS predicted_label FROM fx_scores""",
           "sj": "SELECT s.item_id, s.predicted_label, p.gender FROM st s LEFT JOIN fx_posts p USING (item_id)"}
oracle("prevalence_by_group", with_fx(["fx_posts", "fx_scores"], _prevalence("sj"), _STORED))

oracle("join_predictions", with_fx(["fx_posts", "fx_scored_log"], """
SELECT p.doc_id, p.item_id, d.batch_id, d.pred_binary FROM fx_posts p JOIN (
  SELECT doc_id, min(batch_id) AS batch_id, arg_min(pred_binary, batch_id) AS pred_binary
  FROM fx_scored_log GROUP BY doc_id) d USING (doc_id)"""))

oracle("remaining_rows", with_fx(["fx_posts", "fx_scored_log"], """
SELECT doc_id, item_id FROM fx_posts WHERE doc_id NOT IN (SELECT doc_id FROM fx_scored_log)"""))

_GATED = [f"CASE WHEN b1 > b0 THEN c{i} ELSE {'1.0' if i == 0 else '-1.0'} END" for i in range(6)]
_DRIFT = "SELECT doc_id, round(greatest(" + ", ".join(
    f"abs(({g}) - round(({g}) * 8) / 8)" for g in _GATED) + "), 6) AS max_abs_diff FROM fx_scores"
oracle("score_drift", with_fx(["fx_scores"], _DRIFT))
oracle("overall_drift", with_fx(["fx_scores"], f"SELECT max(max_abs_diff) AS max_abs_diff FROM ({_DRIFT})"))


_SRC = {"l1": L1_COUNTS, "l2": L2_COUNTS,
        "src": f"""SELECT p.item_id AS id, p.tweet AS text, {L1_STRING} AS binary_labels,
  {L2_STRING} AS category_labels, n_no <> 3 AS b_ok, dash <> 3 AND (dash > 3 OR {ANY_K}) AS c_ok
FROM fx_posts p JOIN l1 USING (doc_id) JOIN l2 USING (doc_id)"""}
_SRC_SQL = with_fx(["fx_posts", "fx_votes1", "fx_votes2"], """
SELECT id, text, binary_labels, category_labels FROM src WHERE b_ok AND c_ok""", _SRC)
oracle("src_json", _SRC_SQL)
oracle("src_csv", _SRC_SQL)
oracle("src_json_whole", _SRC_SQL)

oracle("read_posts", with_fx(["fx_posts"], """
SELECT lpad(item_id, 9, '0') AS item_id, md5(concat(cleaned_text, ' "q",', chr(10), chr(10), 'end')) AS text_md5, lang FROM fx_posts"""))

oracle("row_ids", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents")

oracle("write_labelled", with_fx(["fx_posts"], """
SELECT data_id, pred_binary, pred_category, pred_category_pipe FROM lab""", _JOB))

_CACHE = {"clg": f"SELECT doc_id, {_length_logits('cleaned_text', 6)} FROM fx_posts"}
_CACHE["cpr"] = _pred_from("clg", "doc_id")
oracle("cached_scores", with_fx(["fx_posts"], "SELECT doc_id, pb AS pred_binary, 1 AS times_computed FROM cpr", _CACHE))

oracle("scored_steps", with_fx(["fx_scored_log"], "SELECT doc_id, batch_id, pred_binary FROM fx_scored_log"))


# ---------------------------------------------------------------- training
_LOG = {"lg": "SELECT run_id, (check_no - 1) * 20 + 1 AS step, val_loss FROM fx_metric_log"}
oracle("best_check", with_fx(["fx_metric_log"], """
SELECT run_id, count(*) AS n_checks, first(step ORDER BY val_loss, step) AS best_step,
  round(min(val_loss), 6) AS best_score FROM lg GROUP BY run_id""", _LOG))

# early stopping as the plain sequential rule, one recursive step per check
_ES_IMPROVED = "c.val_loss < st.best - CAST(0.001 AS DOUBLE)"
oracle("early_stop", "WITH RECURSIVE fx_metric_log AS (" + FX_SQL["fx_metric_log"] + f"""
),
lg AS (SELECT run_id, (check_no - 1) * 20 + 1 AS step, val_loss FROM fx_metric_log),
c AS (SELECT run_id, step, val_loss,
        row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS k FROM lg WHERE step >= 100),
st AS (
  SELECT run_id, k, val_loss AS best, CAST(0 AS BIGINT) AS best_step, 0 AS counter,
    false AS stop, CAST(NULL AS BIGINT) AS stop_step FROM c WHERE k = 0
  UNION ALL
  SELECT c.run_id, c.k,
    CASE WHEN {_ES_IMPROVED} THEN c.val_loss ELSE st.best END,
    CASE WHEN {_ES_IMPROVED} THEN c.step ELSE st.best_step END,
    CASE WHEN {_ES_IMPROVED} THEN 0 ELSE st.counter + 1 END,
    CASE WHEN {_ES_IMPROVED} THEN false ELSE st.counter + 1 >= 10 END,
    CASE WHEN NOT ({_ES_IMPROVED}) AND st.counter + 1 >= 10 THEN c.step END
  FROM st JOIN c ON c.run_id = st.run_id AND c.k = st.k + 1
  WHERE NOT st.stop),
fin AS (SELECT run_id, arg_max(best, k) AS best, arg_max(best_step, k) AS best_step,
          arg_max(stop_step, k) AS stop_step, bool_or(stop) AS stopped FROM st GROUP BY run_id)
SELECT fin.run_id, n.n_checks, fin.best_step, round(fin.best, 6) AS best_score,
  fin.stop_step, fin.stopped
FROM fin JOIN (SELECT run_id, count(*) AS n_checks FROM c GROUP BY run_id) n USING (run_id)""")

# decided on the growing log: the rule itself does not change
oracle("live_early_stop", ORACLES["early_stop"])
