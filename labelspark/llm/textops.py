"""Vectorised helpers over the UTF-8 bytes of Arrow text batches.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; A-Z is
lowered, other letters are left alone (byte-wise, as the contracts say).
A word or shingle is identified by a 64-bit hash.
"""

from __future__ import annotations

import contextlib
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20  # texts are worked on in runs of about this many bytes
TIDY_BYTES = 1 << 20  # groups of this many bytes in all give memory back

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Tables(dict):
    """Tables by key, built where they are used: a pickled copy is empty."""

    def __reduce__(self):
        return _Tables, ()


_powers = _Tables()


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of whole texts with about ``limit`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (n + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    start = ~space
    end = ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = ~space[inner]
    end[inner - 1] = ~space[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; spans are disjoint and ascending."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    term = ((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, hi - lo)
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2] = starts - lo
    cuts[1::2] = ends - lo
    if cuts[-1] == hi - lo:
        cuts = cuts[:-1]
    sums = np.add.reduceat(term, cuts)[0::2]
    if len(starts) > 1:  # reduceat yields the single element where a cut equals the next one
        empty = ends == starts
        sums[empty] = 0
    return mix64(sums * _power_table(_BASE_INV, hi - lo)[starts - lo] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a run of texts, and the first word of each text (n + 1)."""
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a text, in text order, and
    the first shingle of each text; a text of fewer words gives its whole
    sequence as one, a text without words none."""
    counts = np.diff(first)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(out_first[-1]), np.uint64)
    if len(out) == 0:
        return out, out_first
    key = np.uint64(0xD6E8FEB86659FD93)
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            rolled = rolled * key + words[j: n - width + 1 + j]
        rolled = mix64(rolled)
        doc = np.repeat(np.arange(len(counts)), per)
        at = np.arange(len(out)) - out_first[doc] + first[doc]
        full = counts[doc] >= width
        out[full] = rolled[at[full]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[d])
        for w in words[first[d]: first[d + 1]]:
            h = np.uint64((int(h) * int(key) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_first[d]] = mix64(np.array([h ^ np.uint64(0xA5A5A5A5)], np.uint64))[0]
    return out, out_first


def text_shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    data, offsets = text_buffers(column)
    for i, j in doc_chunks(offsets):
        sub = offsets[i: j + 1] - offsets[i]
        words, first = word_hashes(data[offsets[i]: offsets[j]], sub)
        shingles, at = shingle_hashes(words, first, width)
        for k in range(j - i):
            s = np.sort(shingles[at[k]: at[k + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield i + k, s


def pack(values: np.ndarray) -> bytes:
    """Bytes of a sorted uint64 array, one plane per byte: neighbours share
    their high bytes, so the shuffle's compression removes these planes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def bucket_count(df: DataFrame, least: int = 64) -> int:
    """Power of two of hash ranges, in proportion to the shuffle partitions of the session."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(least - 1, 2 * parts - 1).bit_length()


def bucket_cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each hash range of a sorted array begins (buckets + 1)."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    tops = np.arange(1, buckets, dtype=np.uint64) << shift
    return np.concatenate([[0], np.searchsorted(hashes, tops), [len(hashes)]])


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once in the shared folder and read it back, then let the
    driver drop what only the written plan needed (its shuffle files)."""
    import gc

    from labelspark.session import materialise

    out = materialise(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def give_back() -> None:
    """Return memory that a Python worker has freed to the system, where the C library can: workers are
    kept for later tasks, beside which it would count."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """The ``mapInArrow`` function ``run``, giving memory back when a task is done."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def tidy_group(run):
    """``tidy`` for a function of one group or of two that meet (``applyInArrow``); small groups give back together."""
    worked = [0]  # bytes since memory was given back

    def done(tables, out):
        worked[0] += sum(t.nbytes for t in tables)
        if worked[0] >= TIDY_BYTES:
            worked[0] = 0
            give_back()
        return out

    def one(table):
        return done([table], run(table))

    def two(table, other):
        return done([table, other], run(table, other))

    return two if len(inspect.signature(run).parameters) == 2 else one


BINARY, LONG, INT = T.BinaryType(), T.LongType(), T.IntegerType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)
