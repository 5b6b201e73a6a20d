"""Vector codes: product quantisation in whole numbers, nearest entries by Orchard's search.

A vector is cut into ``PARTS`` equal parts, each coded by the index of its nearest
entry in that part's codebook. Codebooks start from the vectors of the smallest
ids and are refined in rounds: tasks assign their vectors and add them up by part
and entry, one aggregate adds the tasks' sums, and the driver, which never holds
more than the codebooks (``ENTRIES`` x dimension numbers), takes the floors of
the means.

Orchard's search keeps for every entry the list of all other entries by their
distance from it. A query starts at an entry, goes down that entry's list, and
jumps to the list of each nearer entry it meets, skipping entries already seen; it
stops where the list's distance is beyond twice its own distance, since no farther
entry can be nearer (triangle inequality; in squares, beyond four times). All parts
of a batch step together. Arithmetic is in whole numbers, so ties are exact: the
lower index wins.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

PARTS = 16
ENTRIES = 64  # of a codebook; at most 64, so that one word marks the entries seen
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24  # components beyond this, once scaled, count as this: distances fit 64 bits
GROUP = 2048  # vectors that step together


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, position) and the neighbour lists of every entry."""

    entries: np.ndarray
    lists: np.ndarray  # (part, entry, rank): entry at that rank, itself left out
    apart: np.ndarray  # its squared distance
    starts: np.ndarray  # (part, rank): entries by their first component

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        d = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        k = entries.shape[1]
        own = d.copy()
        own[:, np.arange(k), np.arange(k)] = -1  # first in its own list, then cut off
        lists = np.argsort(own, axis=2, kind="stable")[:, :, 1:]
        return cls(entries, lists, np.take_along_axis(d, lists, axis=2), np.argsort(entries[:, :, 0], axis=1, kind="stable"))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(books: Codebooks, vectors: np.ndarray, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every part of whole-number vectors (n, dimension).

    ``steps``, if given, gets the number of distances computed.
    """
    parts, k, width = books.entries.shape
    n = len(vectors)
    x = vectors.reshape(n * parts, width)
    part = np.tile(np.arange(parts), n)
    at = np.zeros(n * parts, np.int64)
    for p in range(parts):  # start: an entry whose first component is about the query's
        order = books.starts[p]
        ranked = books.entries[p, order, 0]
        at[p::parts] = order[np.minimum(np.searchsorted(ranked, x[p::parts, 0]), k - 1)]
    flat = books.entries.reshape(parts * k, width)
    lists, apart = books.lists.reshape(parts * k, -1), books.apart.reshape(parts * k, -1)
    best = ((x - flat[part * k + at]) ** 2).sum(1)
    seen = np.uint64(1) << at.astype(np.uint64)
    rank = np.zeros(n * parts, np.int64)
    live = np.arange(n * parts)
    computed = len(live)
    while k > 1 and len(live):
        row = part[live] * k + at[live]
        r = rank[live]
        go = apart[row, r] <= 4 * best[live]  # a list ends at rank k - 1: see below
        live, row, r = live[go], row[go], r[go]
        e = lists[row, r]
        bit = np.uint64(1) << e.astype(np.uint64)
        rank[live] = r + 1
        fresh = (seen[live] & bit) == 0
        new, e_new = live[fresh], e[fresh]
        seen[new] |= bit[fresh]
        d = ((x[new] - flat[part[new] * k + e_new]) ** 2).sum(1)
        computed += len(new)
        nearer = (d < best[new]) | ((d == best[new]) & (e_new < at[new]))
        won = new[nearer]
        at[won], best[won], rank[won] = e_new[nearer], d[nearer], 0
        live = live[rank[live] < k - 1]
    if steps is not None:
        steps.append(computed)
    return at.reshape(n, parts), best.reshape(n, parts)


def _integers(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(-1, size)


def usable(rows: DataFrame, vector: str, size: int | None = None):
    """Whether a vector is there, has finite components only, and the length ``size``
    (without it: any positive multiple of ``PARTS``)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fits = F.size(v) == size if size else (F.size(v) > 0) & (F.size(v) % PARTS == 0)
    return F.coalesce(v.isNotNull() & fits & ~bad, F.lit(False))


SUMS = tx.schema(part=tx.INT, entry=tx.INT, n=tx.LONG, sums=T.ArrayType(tx.LONG))


def _refine(rows: DataFrame, books: Codebooks, size: int) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused entries stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        books = shared.value
        parts, k, width = books.entries.shape
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            vectors = _integers(batch.column(0), size)
            for i in range(0, len(vectors), GROUP):
                x = vectors[i: i + GROUP]
                at = (nearest(books, x)[0] + np.arange(parts) * k).ravel()
                count += np.bincount(at, minlength=parts * k)
                np.add.at(total, at, x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // k).astype(np.int32)), pa.array((used % k).astype(np.int32)), pa.array(count[used]),
             pa.array(total[used].tolist(), pa.list_(pa.int64()))], SUMS.names)

    width = books.entries.shape[2]
    told = (rows.select("vector").mapInArrow(add, SUMS).groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]))
    entries = books.entries.copy()
    for r in told.collect():  # at most PARTS x ENTRIES rows
        entries[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    shared.unpersist()
    return Codebooks.of(entries)


def learn_codebooks(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from all usable rows; None if no usable row has an id.

    The entries start from the rows of the ``ENTRIES`` smallest ids (of repeated
    ids the smaller vector first); the length of the very first vector is that of
    all vectors that count.
    """
    first = (rows.where(F.col(vec_id).isNotNull() & usable(rows, vector)).select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v")))
    lead = first.orderBy("i", "v").limit(1).collect()
    if not lead:
        return None
    size = len(lead[0]["v"])
    seeds = first.where(F.size("v") == size).orderBy("i", "v").limit(ENTRIES).collect()
    whole = _integers(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), size)
    books = Codebooks.of(np.ascontiguousarray(whole.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2)))
    kept = rows.where(usable(rows, vector, size)).select(F.col(vector).alias("vector"))
    for _ in range(rounds):
        books = _refine(kept, books, size)
    return books


def encode(rows: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """``keep`` columns, code (two hex digits a part) and error of every usable row."""
    size = books.entries.shape[0] * books.entries.shape[2]
    narrow = rows.where(usable(rows, vector, size)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(vector).alias("vector"))
    out = T.StructType([*narrow.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", tx.LONG)])
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            vectors = _integers(batch.column(len(keep)), size)
            codes, errors = [], [np.zeros(0, np.int64)]
            for i in range(0, len(vectors), GROUP):
                at, far = nearest(shared.value, vectors[i: i + GROUP])
                codes += [r.tobytes().hex() for r in at.astype(np.uint8)]
                errors.append(far.sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], out.names)

    return narrow.mapInArrow(run, out).toDF(*keep, "code", "error")


def decode(coded: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` columns and the vector each code stands for (entries, scaled back)."""
    parts, _, width = books.entries.shape
    table = F.lit((books.entries / SCALE).reshape(-1).tolist())
    k = books.entries.shape[1]
    entry = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * k for p in range(parts)]
    return coded.select(*keep, F.concat(*[F.slice(table, e * width + 1, width) for e in entry]).alias("vector"))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row.

    Rows whose vector is null, holds null or non-finite components, or has not
    the length of the vectors the codebooks start from go. Null ids are coded but
    start no entry; repeated rows are coded alike; equal distances go to the lower
    index; null labels count together. Components beyond +-65,536 count as that.
    Other columns are ignored; without a usable row with an id the result is empty.
    """
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    books = learn_codebooks(named)
    if books is None:
        return named.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                                F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = tx.settle(encode(named, books, ("vec_id", "label")), "vector-codes")
    # written first: its size is known when the join is planned (broadcast below the session's
    # threshold, else a shuffle whose hot labels adaptive execution splits)
    totals = tx.settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "vector-label-errors")
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("same")))
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))


def _assign(books: str, name: str) -> str:
    """SQL: the nearest entry of every part (ties to the lower index)."""
    return f"""{name} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS hit, any_value(x) AS x
  FROM parts JOIN {books} USING (p) GROUP BY r, p)"""


def _means(before: str, hits: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b.p, b.e, CASE WHEN max(s.n) IS NULL THEN any_value(b.y) ELSE list(CAST(floor(s.t / s.n) AS BIGINT) ORDER BY s.j) END AS y
  FROM {before} b LEFT JOIN (
    SELECT p, hit.e AS e, j, sum(x[j])::BIGINT AS t, count(*) AS n FROM {hits}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j)
    GROUP BY ALL) s ON s.p = b.p AND s.e = b.e GROUP BY b.p, b.e)"""


ORACLE = f"""
WITH whole AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and([c IS NOT NULL AND isfinite(c) FOR c IN embedding])),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
  FROM whole, (SELECT unnest(range(16)) AS p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, x AS y FROM parts JOIN seeds USING (r)),
{_assign("b0", "a0")},
{_means("b0", "a0", "b1")},
{_assign("b1", "a1")},
{_means("b1", "a1", "b2")},
{_assign("b2", "a2")},
coded AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', hit.e), '' ORDER BY p) AS code, sum(hit.d)::BIGINT AS error FROM a2 GROUP BY r),
told AS (SELECT vec_id, label, code, error FROM coded JOIN whole USING (r)),
book AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS sha FROM (SELECT p, e, array_to_string(y, ',') AS c FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha FROM book) AS codebooks_sha256 FROM told
"""
