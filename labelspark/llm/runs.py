"""Periodic runs of words, found through multi-scale minimizers.

A run is a longest stretch of words with smallest period q and at least
``max(MIN_WORDS, 3 q)`` words. Periods below ``FIRST`` are found by scanning each
lag. A scale Q covers the periods [Q, 2 Q): every stretch of ``3 Q / 4`` words (a
gram) has a hash, grams inside runs of a period of at most ``Q / 4`` are left out
(these runs are known by then), and the least hashes of all windows of ``Q / 2``
grams are the scale's minimizers. Which grams are least depends on the words of a
window alone, so inside a run they come back one period later: equal minimizers
at a distance in [Q, 2 Q) seed an extension. At least one window of a run has a gram
that is not left out (else the run's period would be smaller), and equal grams
that stay are more than Q / 4 apart, so a minimizer has at most eight partners,
however repetitive the text.

Seeds of all texts of a chunk are extended together, by bisection over prefix
hashes, which never falls short of the true extension; stretches long enough for a
run are then compared word by word. A text is worked on where it lies: there is
no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

MIN_WORDS = 24
TIMES = 3  # a run holds its period this many times
FIRST = 32  # shorter periods are scanned lag by lag; a multiple of 4, at least 4/3 of MIN_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_KEY = np.uint64(0x8CB92BA72F3D8DD7)
_KEY_INV = np.uint64(pow(int(_KEY), -1, 1 << 64))
_GONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(period):
    return np.maximum(MIN_WORDS, TIMES * period)


def _windows(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every window of ``width`` values."""
    n = len(values)
    fill = _GONE if pick is np.minimum else np.uint64(0)
    padded = np.full(-(-n // width) * width, fill)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1: n])


class _Prefixes:
    """Hashes of all stretches of a word sequence, comparable between places."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        up, down = np.full(n, _KEY), np.full(n, _KEY_INV)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        self.sums, self.down, self.n = np.zeros(n, np.uint64), down, len(words)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: self.n - width + 1]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether stretches of ``length`` words at a and b have equal hashes."""
        return ((self.sums[a + length] - self.sums[a]) * self.down[a] == (self.sums[b + length] - self.sums[b]) * self.down[b])

    def stretch(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place x around ``at`` where words x and x + lag agree."""
        low, high = np.zeros_like(at), self.n - at - lag + 1  # ahead: low fits, high does not
        while (open_ := high - low > 1).any():
            mid = (low + high) // 2
            fits = self.same(at, at + lag, np.where(open_, mid, 0))
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid, high)
        end = at + low
        low, high = np.zeros_like(at), at + 1
        while (open_ := high - low > 1).any():
            mid = np.where(open_, (low + high) // 2, 0)
            fits = self.same(at - mid, at + lag - mid, mid)
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid, high)
        return at - low, end


def _walk(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` by comparing words (where hashes were not to be trusted)."""
    first, last = at, at
    while first > 0 and words[first - 1] == words[first - 1 + lag]:
        first -= 1
    while last + lag < len(words) and words[last] == words[last + lag]:
        last += 1
    return first, last


def _short(words: np.ndarray, found: dict) -> None:
    """Runs of periods below FIRST, lag by lag."""
    for q in range(1, min(FIRST, len(words) // TIMES + 1)):
        cuts = np.flatnonzero(words[:-q] != words[q:])
        edges = np.concatenate([[-1], cuts, [len(words) - q]])
        for k in np.flatnonzero(np.diff(edges) - 1 + q >= _least(q)):
            found.setdefault((int(edges[k]) + 1, int(edges[k + 1]) + q), q)


def _seeds(words: np.ndarray, prefixes: _Prefixes, found: dict, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal minimizers at distances in [scale, 2 scale)."""
    gram, window = 3 * scale // 4, scale // 2
    values = tx.mix64(prefixes.grams(gram))
    values[values == _GONE] = 0
    delta = np.zeros(len(words) + 1, np.int64)
    for (s, e), q in found.items():
        if q <= scale // 4 and e - s >= gram:
            delta[s] += 1
            delta[e - gram + 1] -= 1
    values[np.cumsum(delta)[: len(values)] > 0] = _GONE
    if len(values) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _windows(values, window, np.minimum)
    around = np.concatenate([np.zeros(window - 1, np.uint64), np.where(least == _GONE, 0, least), np.zeros(window - 1, np.uint64)])
    chosen = np.flatnonzero((values == _windows(around, window, np.maximum)) & (values != _GONE))
    order = chosen[np.argsort(values[chosen], kind="stable")]
    ranked = values[order]
    places, lags, k = [], [], 1
    while k < len(order):
        lag = order[k:] - order[:-k]
        near = (ranked[k:] == ranked[:-k]) & (lag < 2 * scale)
        if not near.any():
            break
        take = near & (lag >= scale)
        places.append(order[:-k][take])
        lags.append(lag[take])
        k += 1
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(places or empty), np.concatenate(lags or empty)


def _long(words: np.ndarray, prefixes: _Prefixes, found: dict, scale: int) -> None:
    """Runs of periods in [scale, 2 scale)."""
    at, lag = _seeds(words, prefixes, found, scale)
    if not len(at):
        return
    first, last = prefixes.stretch(at, lag)
    enough = last - first + lag >= _least(lag)
    rows = np.unique(np.stack([lag[enough], first[enough], last[enough], at[enough]]), axis=1)
    done: dict[tuple[int, int], int] = {}
    for q, s, e, seed in rows.T.tolist():
        if done.get((q, s)) == e:
            continue
        done[q, s] = e
        if not np.array_equal(words[s:e], words[s + q: e + q]):
            s, e = _walk(words, seed, q)
            if e - s + q < _least(q):
                continue
        found.setdefault((s, e + q), q)  # lags come in ascending order: the smallest period stays


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of texts laid end to end, by start and period.

    ``words`` holds 64-bit hashes of equal-sized meaning: equal hash, equal word.
    Between texts a word that equals no other must stand; ``sizes`` are the words
    of each text without it.
    """
    found: dict[tuple[int, int], int] = {}
    if len(words) >= MIN_WORDS:
        _short(words, found)
    scale, longest = FIRST, int(sizes.max(initial=0))
    if TIMES * scale <= longest:
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    while TIMES * scale <= longest:
        stay = sizes[owner] >= TIMES * scale
        place = np.flatnonzero(stay)  # texts too short for the scale are left out
        back = np.cumsum(stay) - 1
        part = words[place]
        known = {(int(back[s]), int(back[e - 1]) + 1): q for (s, e), q in found.items() if stay[s]}
        before = set(known)
        _long(part, _Prefixes(part), known, scale)
        for (s, e), q in known.items():
            if (s, e) not in before:
                found.setdefault((int(place[s]), int(place[e - 1]) + 1), q)
        scale *= 2
    return sorted((s, e, q) for (s, e), q in found.items())


RESULT = tx.schema(n_runs=tx.LONG, start=tx.LONG, length=tx.LONG, period=tx.LONG, exponent_milli=tx.LONG,
                   runs_sha256=T.StringType(), collapsed_sha256=T.StringType(), kept_text=T.StringType(),
                   runs=T.ArrayType(tx.schema(start=tx.LONG, length=tx.LONG, period=tx.LONG)))


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for s, n, q in runs[1:]:
        if n * best[2] > best[1] * q:  # exact; runs come by start, then period
            best = (s, n, q)
    return best


def _describe(data: bytes, runs: list[tuple[int, int, int]], want_text: bool) -> tuple:
    """The result of one text, whose words ``data.split()`` gives (same blanks)."""
    words = data.split()
    listed = [(s, e - s, q) for s, e, q in runs]
    if runs:
        keep = np.ones(len(words), bool)
        for s, e, q in runs:
            keep[s + q: e] = False
        words = [w for w, k in zip(words, keep.tolist()) if k]
    text = b" ".join(words)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
    best = _greatest(listed) if listed else (None, None, None)
    milli = 1000 * best[1] // best[2] if listed else None
    return (len(listed), *best, milli, digest, hashlib.sha256(text).hexdigest(), text.decode() if want_text else None, listed)


def _batch(column: pa.Array, want_text: bool) -> list[tuple]:
    data, offsets = tx.text_buffers(column)
    out = []
    for i, j in tx.doc_chunks(offsets):
        part, sub = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        starts, ends, first = tx.word_bounds(part, sub)
        hashes = tx.span_hashes(part, starts, ends, lower=False)
        sizes = np.diff(first)
        texts = np.arange(j - i)
        between = np.zeros(len(hashes) + len(texts), bool)
        between[first[1:] + texts] = True
        words = np.empty(len(between), np.uint64)
        words[~between] = hashes
        # a fresh value per text: no word of the chunk has it, or it is changed until none has
        words[between] = tx.mix64(texts.astype(np.uint64) * _KEY + np.uint64(1))
        while np.isin(words[between], hashes).any():
            words[between] = tx.mix64(words[between] + np.uint64(1))
        at = first[:-1] + texts
        per: list[list] = [[] for _ in texts]
        runs = find_runs(words, sizes)
        if runs:
            owner = np.searchsorted(at, [s for s, _, _ in runs], "right") - 1
            for (s, e, q), d in zip(runs, owner.tolist()):
                per[d].append((s - int(at[d]), e - int(at[d]), q))
        raw = part.tobytes()
        out.extend(_describe(raw[sub[k]: sub[k + 1]], per[k], want_text) for k in range(j - i))
    return out


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", kept_text: bool = False) -> DataFrame:
    """``keep`` columns of every row with its runs of words and what stays without their repeats.

    ``runs`` lists all runs (start, length, period) by start, then period;
    ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with
    the greatest length / period (ties: smallest start, then period). A word goes
    if a run contains it after that run's first period; the others, joined by
    blanks, are hashed (``collapsed_sha256``) and, with ``kept_text``, returned.
    Words are compared as they stand, by 64-bit hashes. Null and empty texts have
    no words and no runs (four nulls); null ids and repeated rows give one result a row;
    an empty table gives an empty result. Other columns are ignored.
    """
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, *RESULT.fields])
    types = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]

    def run(batches):
        for batch in batches:
            rows = _batch(batch.column(len(keep)), kept_text)
            columns = list(zip(*rows)) if rows else [()] * len(types)
            told = [pa.array(list(c), t) for c, t in zip(columns[:-1], types[:-1])]
            lists = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *told, pa.array(lists, types[-1])], schema.names)

    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    return narrow.mapInArrow(run, schema).toDF(*keep, *RESULT.names)


def planted_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, one text in ten (by crc32 of its id) turned periodic from some word on.

    With h the crc32 of the id (a null id counts as the empty text), g = h div 10 and n
    words, such a text becomes its words 0 to a - 1 and then, from a = g mod n, its next
    1 + (n - a) div (3 + g mod 8) words over and over up to n words, joined by blanks.
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(_WORD), F.regexp_extract_all("text", F.lit(_WORD), 0)))
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("words").isNotNull(), F.expr("g % n")))
    rows = rows.withColumn("p", F.when(F.col("words").isNotNull(), F.expr("1 + (n - a) div (3 + g % 8)")))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


ORACLE = r"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
bits AS (
  SELECT s, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(substr(s, CAST(k AS INTEGER), 1)) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(z AS BIGINT) FOR z IN range(8)]),
                             lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS c FROM ids),
crc AS (SELECT s, xor(CASE WHEN s = '' THEN 4294967295 ELSE c END, 4294967295) AS h FROM bits),
d1 AS (SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g FROM d0 JOIN crc ON s = coalesce(CAST(doc_id AS VARCHAR), '')),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
docs AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM d2),
words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
lagged AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y
           ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM lagged),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS told FROM runs GROUP BY r),
best AS (SELECT x.* FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (
    y.length * x.period > x.length * y.period
    OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period)))))),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
