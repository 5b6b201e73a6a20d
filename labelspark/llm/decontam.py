"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are cut into word shingles (five words; an item of fewer words uses
its own length) and partitioned by set size into classes with upper bound U =
8, 16, 32, ... Each item is signed by one-permutation MinHash with 4 U bins, the
minimum hash of every bin. A document is read as windows of 2 U shingle
positions that advance by U, so any run of an item's length lies whole in a
window of comparable size, whatever the document's length: that is what makes
the resemblance of item and window high where the containment is. A window whose
minimum in a bin equals an item's is a candidate. With four bins per position
almost every shared shingle is its bin's minimum, so an item with containment
0.8 is missed only if all its shared minima are shadowed (for 30 shingles below
1e-9). Items of at most ``SMALL`` shingles have too few minima for that: all their
shingles are looked up and counted, and none is missed. Candidates are verified by
exact containment of the item's shingle set in the whole document.

The items are worked through in blocks of bounded shingle count (the driver
holds one block at a time, which is what the tasks receive), each in one pass
over the documents without a shuffle. Nothing grows with a hot item, source or
group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labelspark.llm import textops as tx

WIDTH = 5
CONTAINMENT = (80, 100)
BLOCK_SHINGLES = 2_000_000
SMALL = 8  # items of so many shingles are found by all of them; the smallest class bound
COUNTED = 4_000_000  # (text, item) hits of small items counted at a time


class ItemIndex:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, items: list[tuple[object, np.ndarray, int]]):
        """``items``: (id, sorted distinct shingle hashes, shingle width)."""
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.parts = {}  # (width, class bound) -> (sorted signature values, item of each)
        rows: dict[tuple[int, int], list] = {}
        for k, (_, s, width) in enumerate(items):
            if len(s):
                bound = max(SMALL, 1 << (len(s) - 1).bit_length())
                rows.setdefault((width, bound), []).append((k, s if bound == SMALL else _bin_minima(s, 4 * bound)))
        for key, found in rows.items():
            values = np.concatenate([v for _, v in found])
            owner = np.concatenate([np.full(len(v), k) for k, v in found])
            order = np.argsort(values, kind="stable")
            self.parts[key] = (values[order], owner[order])
        self.widths = sorted({w for w, _ in self.parts})
        self.sizes = np.array([len(s) for s in self.sets], np.int64)


def _bin(values: np.ndarray, bins: int) -> np.ndarray:
    return values >> np.uint64(64 - (bins.bit_length() - 1))


def _bin_minima(s: np.ndarray, bins: int) -> np.ndarray:
    """The smallest value of every bin of a sorted set (bins are ranges of the hash)."""
    b = _bin(s, bins)
    return s[np.concatenate([[True], b[1:] != b[:-1]])]


def _sketch(values: np.ndarray) -> np.ndarray:
    """Bitmap over 20 bits of the hash: most shingles are ruled out by one look-up."""
    seen = np.zeros(1 << 20, bool)
    seen[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return seen


def find_items(texts: pa.Array, index: ItemIndex, sketches: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, common shingles, first word, end word) of every contained item of a batch."""
    data, offsets = tx.text_buffers(texts)
    num, den = CONTAINMENT
    for i, j in tx.doc_chunks(offsets):
        words, first = tx.word_hashes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        for width in index.widths:
            shingles, at = tx.shingle_hashes(words, first, width)
            pairs = set()
            for (w, bound), (values, owner) in index.parts.items():
                if w != width:
                    continue
                seen = sketches[w, bound]
                hit = np.flatnonzero(seen[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
                lo = np.searchsorted(values, shingles[hit], "left")
                hi = np.searchsorted(values, shingles[hit], "right")
                hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
                docs = np.searchsorted(at, hit, "right") - 1
                if bound == SMALL:
                    pairs.update(_counted(docs, lo, hi, owner, index.sizes))
                    continue
                for p, d, a, b in zip(hit.tolist(), docs.tolist(), lo.tolist(), hi.tolist()):
                    fresh = [k for k in owner[a:b].tolist() if (d, k) not in pairs]
                    if fresh and _is_minimum(shingles, p, int(at[d]), int(at[d + 1]), bound):
                        pairs.update((d, k) for k in fresh)
            for d, k in sorted(pairs):
                doc, item = shingles[at[d]: at[d + 1]], index.sets[k]
                where = np.searchsorted(item, doc)
                where[where == len(item)] = 0
                places = np.flatnonzero(item[where] == doc)
                common = len(np.unique(doc[places]))
                if den * common >= num * len(item):
                    yield i + d, k, common, int(places[0]), int(places[-1]) + width


def _counted(docs: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, item) whose share of the item's shingles is reached. ``lo``, ``hi``: the
    places in ``owner`` of the shingle at each hit; ``docs`` ascends."""
    num, den = CONTAINMENT
    span = np.int64(len(owner) + 1)
    _, once = np.unique(docs * span + lo, return_index=True)  # a shingle once a text
    docs, lo, hi = docs[once], lo[once], hi[once]
    ends = np.flatnonzero(np.append(docs[1:] != docs[:-1], True)) + 1 if len(docs) else docs
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    i = 0
    while i < len(docs):  # whole texts
        e = min(int(np.searchsorted(total[ends], total[i] + COUNTED, "right")), len(ends) - 1)
        j = int(ends[e - 1]) if e and total[ends[e]] > total[i] + COUNTED and ends[e - 1] > i else int(ends[e])
        n = hi[i:j] - lo[i:j]
        place = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n) + np.repeat(lo[i:j], n)
        codes, common = np.unique(np.repeat(docs[i:j], n) * np.int64(len(sizes)) + owner[place], return_counts=True)
        d, k = np.divmod(codes, np.int64(len(sizes)))
        enough = den * common >= num * sizes[k]
        yield from zip(d[enough].tolist(), k[enough].tolist())
        i = j


def _is_minimum(shingles: np.ndarray, p: int, lo: int, hi: int, bound: int) -> bool:
    """Whether position p holds its bin's minimum in one of the two windows over it."""
    block, mine = (p - lo) // bound, shingles[p]
    for start in (block - 1, block):
        if start >= 0:
            window = shingles[lo + start * bound: min(hi, lo + (start + 2) * bound)]
            window = window[_bin(window, 4 * bound) == _bin(mine[None], 4 * bound)[0]]
            if mine == window.min():
                return True
    return False


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_shingles: int) -> Iterator[list]:
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        text = pa.array([row["t"]], pa.string())
        words = len(tx.word_hashes(*tx.text_buffers(text))[0])
        width = min(WIDTH, words)
        if not width:
            continue
        (_, s), = tx.text_shingle_sets(text, width)
        block.append((row["i"], s, width))
        size += len(s)
        if size >= block_shingles:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text",
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Every (document row, item) whose containment is at least 0.8.

    Columns: doc_id, item_id, item_shingles, common_shingles (long),
    containment (double), first_word and end_word (span of the shared shingles,
    in words). Null or word-less texts contain and match nothing; repeated rows
    and repeated items give a row each; ids may be null; other columns of either
    input are ignored. Empty inputs give an empty result.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    out = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("item_id", item_type),
        T.StructField("item_shingles", T.LongType()), T.StructField("common_shingles", T.LongType()),
        T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType())])
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for block in _item_blocks(items, item_id, item_text, block_shingles):
        parts.append(narrow.mapInArrow(_matcher(spark, block, to_arrow_type(item_type)), out))
        if len(parts) > 1:  # an earlier block's rows are settled before the next pass
            parts = [tx.settle(parts[0].unionAll(parts[1]), "leaks")]
    return parts[0] if parts else spark.createDataFrame([], out)


def _matcher(spark: SparkSession, block: list, item_type: pa.DataType):
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        index = ItemIndex(shared.value)
        sketches = {k: _sketch(v) for k, (v, _) in index.parts.items()}
        for batch in batches:
            found = list(find_items(batch.column(1), index, sketches))
            if found:
                rows, items, common, first, end = zip(*found)
                n = [len(index.sets[k]) for k in items]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array([index.ids[k] for k in items], item_type),
                    pa.array(n, pa.int64()), pa.array(common, pa.int64()),
                    pa.array([c / m for c, m in zip(common, n)], pa.float64()),
                    pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "item_shingles", "common_shingles", "containment", "first_word", "end_word"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns, that contain none of the items (see ``contained_items``).

    Null and empty texts contain nothing and stay; null, empty and word-less items
    are in no text. Repeated rows stay or go together; repeated items count as
    one. Without items every row stays; an empty table gives an empty result.
    """
    spark, place = docs.sparkSession, docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    left = docs.toDF(*names)

    def cleaner(block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            index = ItemIndex(shared.value)
            sketches = {k: _sketch(v) for k, (v, _) in index.parts.items()}
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[r for r, *_ in find_items(batch.column(place), index, sketches)]] = False
                yield batch.filter(pa.array(stays))

        return run

    for k, block in enumerate(_item_blocks(items, item_id, item_text, block_shingles)):
        left = (tx.settle(left, "uncontaminated") if k else left).mapInArrow(tx.tidy(cleaner(block)), left.schema)
    return left.toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT r, doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
bs AS (SELECT DISTINCT q, item_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT q, item_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM b)),
n AS (SELECT q, count(*) AS item_shingles FROM bs GROUP BY q),
m AS (SELECT r, any_value(doc_id) AS doc_id, q, any_value(item_id) AS item_id, count(DISTINCT ds.s) AS common_shingles,
             min(p) AS first_word, max(p) + 5 AS end_word
      FROM ds JOIN bs ON ds.s = bs.s GROUP BY r, q)
SELECT doc_id, item_id, item_shingles, common_shingles, common_shingles / item_shingles AS containment,
       first_word, end_word
FROM m JOIN n USING (q) WHERE 100 * common_shingles >= 80 * item_shingles
"""
