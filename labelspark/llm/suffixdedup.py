"""Exact substring deduplication with a collection suffix order built column by column.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier
(smaller id, or earlier in the same document) is removed; matches stay inside
documents.

Dealing. A window of ``LENGTH`` bytes is represented by its anchor, the run of
``GRAM`` bytes in it with the smallest hash (of equals the last), so equal windows
have equal anchors at equal places. Consecutive windows with one anchor are kept
as one context, the bytes they cover. Anchors are counted over all documents;
contexts whose anchor occurs once are done. The others meet in the hash range of
their anchor, equal contexts combined per block of documents before the shuffle
and again after it (the earliest stays, the copies are removed whole). Windows of
an anchor that is very frequent are dealt one by one by their own hash, so a line
or passage that a large part of all documents share is spread out and combined.

Construction. The distinct contexts of a range are the documents of a collection
whose Burrows-Wheeler transform and common prefixes grow by columns: round j
inserts, for every context at once, its suffix of j symbols. Where the suffix goes
is read off the transform (symbols smaller than its first one, and equal ones
before its place in the round before); its common prefix with its neighbours is
one more than the least common prefix between equal symbols. The columns lie in
files that a round reads and writes once in order. Contexts are at most
``2 * LENGTH - GRAM`` bytes, so rounds do not grow with the texts. In the final
order the windows with a common prefix of ``LENGTH`` are equal; all but the
earliest are removed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

LENGTH = 100
GRAM = 40
BLOCK_BYTES = 4 << 20
FREQUENT = 2_000  # occurrences of an anchor beyond which its windows are dealt one by one
PIECE = 1 << 20  # window starts hashed at once
COLLECTION_BYTES = 512 << 10  # contexts of a range are ordered in collections of about this size
NO_SYMBOL = 255  # no byte of UTF-8
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)  # anchors are small hashes: their keys are hashed again to spread over the ranges


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tx._power_table(tx._BASE, len(data)), out=sums[1:])
    return tx.mix64((sums[gram:] - sums[:-gram]) * tx._power_table(tx._BASE_INV, n))


def _span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Hash of spans that may overlap (starts ascend), mixed with ``extra``."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(data), PIECE // 2):
        some = slice(*np.searchsorted(starts, [lo, lo + PIECE // 2]))
        if some.stop > some.start:
            part = data[lo: int(ends[some].max())]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * tx._power_table(tx._BASE, len(part)), out=sums[1:])
            a, b = starts[some] - lo, ends[some] - lo
            raw = (sums[b] - sums[a]) * tx._power_table(tx._BASE_INV, len(part) + 1)[a]
            out[some] = tx.mix64(raw + (b - a).astype(np.uint64))
    return tx.mix64(out ^ (extra.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: (text, first window, last window, anchor place, anchor hash)."""
    span = length - gram + 1
    out = [[] for _ in range(5)]
    low = np.uint64((1 << 20) - 1)
    for lo, hi in _pieces(offsets, length):
        part = data[lo:hi]
        n = len(part) - length + 1
        if n <= 0:
            continue
        h = _gram_hashes(part, gram)
        v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # smallest hash, then last place
        width = 1
        while 2 * width <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: n], v[span - width: span - width + n])
        place = (low - (v & low)).astype(np.int64)
        new, ok = np.ones(n, bool), np.ones(n, bool)
        new[1:] = place[1:] != place[:-1]
        ends = offsets[slice(*np.searchsorted(offsets, [lo + 1, hi]))] - lo  # where texts end inside the piece
        new[ends[ends < n]] = True
        for end in ends.tolist():
            ok[max(end - length + 1, 0): end] = False
        new[1:] |= ok[1:] != ok[:-1]
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], n) - 1
        edge, last = edge[ok[edge]], last[ok[edge]]
        doc = np.searchsorted(offsets, lo + edge, "right") - 1
        for k, x in enumerate((doc, lo + edge, lo + last, lo + place[edge], tx.mix64(h[place[edge]] ^ _SPREAD))):
            out[k].append(x)
    if not out[0]:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in out)


def _pieces(offsets: np.ndarray, length: int):
    """Byte ranges of at most ``PIECE`` window starts; ranges of one text overlap by a window."""
    for i, j in tx.doc_chunks(offsets, PIECE // 2):
        lo, end = int(offsets[i]), int(offsets[j])
        while True:
            hi = min(end, lo + PIECE // 2 + length - 1)
            yield lo, hi
            if hi == end:
                break
            lo = hi - length + 1


class Block:
    """A block of documents in order, its contexts, and those that repeat one of its own."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids = np.array([-(1 << 63) if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        ties = table["tie"].to_numpy()
        order = np.lexsort((ties, ids))
        self.table = table.take(pa.array(order)).combine_chunks()
        self.ids, self.ties, self.length = ids[order], ties[order], length
        self.data, self.offsets = tx.text_buffers(self.table["text"])
        self.doc, self.first, self.last, self.place, self.anchor = contexts(self.data, self.offsets, length, gram)
        self.anchors, self.anchor_of = np.unique(self.anchor, return_inverse=True)

    def dealt(self, state: np.ndarray):
        """(key, first window, last window, anchor place, text, hot) of what is dealt, and of what
        repeats an earlier one of this block. ``state`` of each anchor: 0 single, 1 shared, 2 frequent."""
        s = state[self.anchor_of]
        plain, hot = np.flatnonzero(s == 1), np.flatnonzero(s == 2)
        many = self.last[hot] - self.first[hot] + 1
        run = np.repeat(hot, many)
        window = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + self.first[run]
        first = np.concatenate([self.first[plain], window])
        last = np.concatenate([self.last[plain], window])
        place = np.concatenate([self.place[plain], self.place[run]])
        doc = np.concatenate([self.doc[plain], self.doc[run]])
        is_hot = np.arange(len(first)) >= len(plain)
        content = np.concatenate([_span_keys(self.data, first[x], last[x] + self.length, place[x] - first[x])
                                  for x in (slice(0, len(plain)), slice(len(plain), None))])
        key = np.where(is_hot, content, np.concatenate([self.anchor[plain], self.anchor[run]]))
        order = np.lexsort((place, content))  # places ascend with the order of documents
        new = np.ones(len(order), bool)
        new[1:] = content[order][1:] != content[order][:-1]
        rows = (key, first, last, place, doc, is_hot)
        sent = order[new]
        sent = sent[np.argsort(key[sent], kind="stable")]
        return tuple(x[sent] for x in rows), tuple(x[order[~new]] for x in rows)

    def spans(self, lo: np.ndarray, hi: np.ndarray):
        """Per document: removed bytes, removed runs, digest of the rest, for window ranges lo .. hi."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, lo, 1)
        np.add.at(change, np.minimum(hi + self.length, len(self.data)), -1)
        gone = np.cumsum(change[:-1], out=change[:-1]) > 0
        del change
        n = len(self.ids)
        removed, runs, digests, kept_bytes = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for d in range(n):
            a, b = self.offsets[d], self.offsets[d + 1]
            g = gone[a:b]
            removed[d] = np.count_nonzero(g)
            rest = self.data[a:b]
            if removed[d]:
                runs[d] = int(g[0]) + np.count_nonzero(g[1:] & ~g[:-1])
                rest = rest[~g]
            kept_bytes.append(rest)
            digests.append(hashlib.sha256(rest).hexdigest())
        return removed, runs, digests, kept_bytes


class Columns:
    """The growing transform (the symbol before each suffix) and the common prefix of each suffix with
    the one before it. A round reads the files of the last one in order and writes new ones."""

    def __init__(self, folder: str, symbol: np.ndarray, longest: int):
        self.folder, self.round = folder, 0
        self.kinds = {"symbol": np.uint8, "common": np.uint8 if longest < 256 else np.uint32}
        self._write({"symbol": symbol, "common": np.zeros(len(symbol))})

    def _write(self, columns: dict) -> None:
        for name, kind in self.kinds.items():
            path = os.path.join(self.folder, f"{name}-{self.round}")
            columns[name].astype(kind, copy=False).tofile(path)
            setattr(self, name, np.memmap(path, kind, "r"))

    def insert(self, at: np.ndarray, fixes: tuple[np.ndarray, np.ndarray], **new: np.ndarray) -> None:
        """Put new entries at the places ``at`` (of the longer column), then set common prefixes ``fixes``."""
        old = np.ones(len(self.symbol) + len(at), bool)
        old[at] = False
        columns = {}
        for name, kind in self.kinds.items():
            out = np.empty(len(old), kind)
            out[old] = getattr(self, name)
            out[at] = new[name]
            columns[name] = out
        columns["common"][fixes[0]] = fixes[1]
        last = self.round
        self.round += 1
        self._write(columns)
        for name in self.kinds:
            os.unlink(os.path.join(self.folder, f"{name}-{last}"))


def _ranks(by_symbol: np.ndarray, symbol: np.ndarray, mine: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rank, in the order of (symbol, place), of some places and their symbols ``mine``, which are in that order."""
    kinds, first = np.unique(mine, return_index=True)
    lo = np.searchsorted(symbol, kinds, sorter=by_symbol)
    hi = np.searchsorted(symbol, kinds, "right", sorter=by_symbol)
    out = np.empty(len(place), np.int64)
    for a, b, x, y in zip(first.tolist(), [*first[1:].tolist(), len(place)], lo.tolist(), hi.tolist()):
        out[a:b] = x + np.searchsorted(by_symbol[x:y], place[a:b])
    return out


def _least(common: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(common[lo:hi]) of every pair, lo < hi."""
    if not len(lo):
        return np.zeros(0, common.dtype)
    cuts = np.empty(2 * len(lo), np.int64)
    cuts[0::2], cuts[1::2] = lo, hi
    return np.minimum.reduceat(np.append(common, common.dtype.type(0)), cuts)[0::2]


def collection_order(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(owner, suffix length, common prefix) of all suffixes of all strings, in order, column by column."""
    m, longest = len(starts), int(sizes.max(initial=0))
    ends = starts + sizes
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        cols = Columns(folder, np.where(sizes > 0, flat[np.maximum(ends - 1, 0)], NO_SYMBOL), longest)
        active = np.flatnonzero(sizes > 0)
        place = active
        for j in range(1, longest + 1):
            symbol, common = np.asarray(cols.symbol), np.asarray(cols.common)
            by_symbol = np.argsort(symbol, kind="stable")
            mine = symbol[place]
            order = np.argsort(mine, kind="stable")  # places ascend
            active, place, mine = active[order], place[order], mine[order]
            lf = _ranks(by_symbol, symbol, mine, place)
            before, after = by_symbol[np.maximum(lf - 1, 0)], by_symbol[np.minimum(lf + 1, len(symbol) - 1)]
            has_before = (lf > 0) & (symbol[before] == mine)
            has_after = (lf + 1 < len(symbol)) & (symbol[after] == mine)
            shared = np.zeros(len(active), np.int64)
            shared[has_before] = 1 + _least(common, before[has_before] + 1, place[has_before] + 1).astype(np.int64)
            following = 1 + _least(common, place[has_after] + 1, after[has_after] + 1).astype(np.int64)
            at = m + lf  # the m empty suffixes come first, then every suffix in the order of its symbol and rest
            more = sizes[active] > j
            symbols = np.where(more, flat[np.maximum(ends[active] - 1 - j, 0)], NO_SYMBOL)
            cols.insert(at, (at[has_after] + 1, following), symbol=symbols, common=shared)
            place, active = at[more], active[more]
        # whose suffix each entry is: follow every string through the finished transform
        symbol, common = np.array(cols.symbol), np.array(cols.common)
        owner, size = np.empty(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
        owner[:m] = active = np.arange(m)
        place, rank = active, np.empty(len(symbol), np.int64)
        rank[np.argsort(symbol, kind="stable")] = np.arange(len(symbol))
        for j in range(1, longest + 1):
            more = sizes[active] >= j
            active = active[more]
            place = m + rank[place[more]]
            owner[place], size[place] = active, j
    return owner, size, common


def repeated_windows(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rank: np.ndarray, length: int):
    """(string, window offset) of every window of ``length`` bytes that an earlier string (smaller rank) has too."""
    owner, size, common = collection_order(flat, starts, sizes)
    group = np.cumsum(common < length)
    whole = np.flatnonzero(size >= length)
    group, owner, size = group[whole], owner[whole], size[whole]
    order = np.lexsort((rank[owner], group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    got = order[later]
    return owner[got], sizes[owner[got]] - size[got]


COUNT = tx.schema(bucket=tx.INT, block=tx.LONG, anchors=tx.BINARY, counts=tx.BINARY)
STATE = tx.schema(block=tx.LONG, bucket=tx.INT, state=tx.BINARY)
SENT = tx.schema(bucket=tx.INT, block=tx.LONG, keys=tx.BINARY, sizes=tx.BINARY, places=tx.BINARY, ids=tx.BINARY, ties=tx.BINARY,
                 starts=tx.BINARY, bytes=tx.BINARY)
GONE = tx.schema(block=tx.LONG, bucket=tx.INT, item=tx.BINARY, lo=tx.BINARY, hi=tx.BINARY)


def _table(rows: list, names: list[str], types: list) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _raw(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i8")


def _anchor_counts(buckets: int, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, length, gram)
        counts = np.bincount(block.anchor_of, minlength=len(block.anchors))
        cuts = tx.bucket_cuts(block.anchors, buckets)
        rows = [(b, table["block"][0].as_py(), tx.pack(block.anchors[cuts[b]: cuts[b + 1]]), tx.pack(counts[cuts[b]: cuts[b + 1]]))
                for b in range(buckets) if cuts[b + 1] > cuts[b]]
        return _table(rows, COUNT.names, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _anchor_states(frequent: int):
    def run(table: pa.Table) -> pa.Table:
        rows = [(r["bucket"], r["block"], tx.unpack(r["anchors"]), tx.unpack(r["counts"]).astype(np.int64)) for r in table.to_pylist()]
        every, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        total = np.bincount(at.ravel(), weights=np.concatenate([r[3] for r in rows]))
        state = (total > 1).astype(np.uint8) + (total > frequent)
        parts = np.split(state[at.ravel()], np.cumsum([len(r[2]) for r in rows])[:-1])
        return _table([(r[1], r[0], s.tobytes()) for r, s in zip(rows, parts)], STATE.names, [pa.int64(), pa.int32(), pa.binary()])

    return run


def _states_of(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    state = np.zeros(len(block.anchors), np.uint8)
    cuts = tx.bucket_cuts(block.anchors, buckets)
    for b, s in zip(answers["bucket"].to_pylist(), answers["state"].to_pylist()):
        if s is not None:
            state[cuts[b]: cuts[b + 1]] = np.frombuffer(s, np.uint8)
    return state


def _send(buckets: int, length: int, gram: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            block = Block(docs, length, gram)
            (key, first, last, place, doc, _), _ = block.dealt(_states_of(block, answers, buckets))
            cuts = tx.bucket_cuts(key, buckets)
            raw = block.data
            for b in range(buckets):
                s = slice(cuts[b], cuts[b + 1])
                if cuts[b + 1] > cuts[b]:
                    lo, hi = first[s], last[s] + length
                    rows.append((b, docs["block"][0].as_py(), tx.pack(key[s]), _raw(hi - lo), _raw(place[s] - first[s]),
                                 _raw(block.ids[doc[s]]), _raw(block.ties[doc[s]]), _raw(lo - block.offsets[doc[s]]),
                                 b"".join(raw[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist()))))
        return _table(rows, SENT.names, [pa.int32(), pa.int64(), *[pa.binary()] * 7])

    return run


def _collections(key: np.ndarray, sizes: np.ndarray):
    """Slices of contexts, ordered by key, of about ``COLLECTION_BYTES`` with no key in two of them."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(key):
        hi = int(np.searchsorted(total, total[lo] - sizes[lo] + COLLECTION_BYTES, "right"))
        hi = int(np.searchsorted(key, key[max(hi - 1, lo)], "right"))
        yield slice(lo, hi)
        lo = hi


def _find_repeats(length: int):
    """Of one range: which windows of which sent contexts also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        counts = [len(r["sizes"]) // 8 for r in sent]
        row = np.repeat(np.arange(len(sent)), counts)
        item = np.concatenate([np.arange(c) for c in counts])
        key = np.concatenate([tx.unpack(r["keys"]) for r in sent])
        sizes, places, ids, ties, starts = (np.concatenate([_ints(r[k]) for r in sent]) for k in ("sizes", "places", "ids", "ties", "starts"))
        raw = b"".join(r.pop("bytes") for r in sent)
        flat = np.frombuffer(raw, np.uint8)
        begin = np.cumsum(sizes) - sizes
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((starts + places, ties, ids))] = np.arange(len(key))
        gone_at, gone_lo, gone_hi = [], [], []
        # equal contexts: the earliest stays
        kept: dict[tuple, int] = {}
        for k in np.argsort(rank).tolist():
            same = (int(key[k]), int(places[k]), raw[begin[k]: begin[k] + sizes[k]])
            if same in kept:
                gone_at.append(k)
                gone_lo.append(0)
                gone_hi.append(int(sizes[k]) - length)
            else:
                kept[same] = k
        some = np.array(sorted(kept.values()), np.int64)
        # contexts that share an anchor with a different one
        _, of, times = np.unique(key[some], return_inverse=True, return_counts=True)
        some = some[(times[of.ravel()] > 1) & (sizes[some] >= length)]
        some = some[np.argsort(key[some], kind="stable")]
        for part in _collections(key[some], sizes[some]):
            part = some[part]
            owner, offset = repeated_windows(flat, begin[part], sizes[part], rank[part], length)
            if len(owner):
                order = np.lexsort((offset, owner))
                owner, offset = owner[order], offset[order]
                edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
                gone_at += part[owner[edge]].tolist()
                gone_lo += offset[edge].tolist()
                gone_hi += offset[np.append(edge[1:], len(owner)) - 1].tolist()
        at, lo, hi = (np.array(x, np.int64) for x in (gone_at, gone_lo, gone_hi))
        out = []
        for k, r in enumerate(sent):
            mine = np.flatnonzero(row[at] == k)
            if len(mine):
                out.append((r["block"], r["bucket"], _raw(item[at[mine]]), _raw(lo[mine]), _raw(hi[mine])))
        return _table(out, GONE.names, [pa.int64(), pa.int32(), *[pa.binary()] * 3])

    return run


def _finish(buckets: int, length: int, gram: int, kept: int, texts: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs, length, gram)
        state = answers.filter(pc.is_valid(answers["state"]))
        sent, repeats = block.dealt(_states_of(block, state, buckets))
        cuts = tx.bucket_cuts(sent[0], buckets)
        lo, hi = [repeats[1]], [repeats[2]]
        for r in answers.filter(pc.is_valid(answers["item"])).to_pylist():
            at = cuts[r["bucket"]] + _ints(r["item"])
            lo.append(sent[1][at] + _ints(r["lo"]))
            hi.append(sent[1][at] + _ints(r["hi"]))
        removed, runs, digests, rest = block.spans(np.concatenate(lo), np.concatenate(hi))
        if not texts:
            return pa.table([block.table["doc_id"], pa.array(np.diff(block.offsets)), pa.array(removed), pa.array(runs), pa.array(digests)],
                            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        left = pa.array([None if gone else x.tobytes().decode("utf-8", "ignore")
                         for x, gone in zip(rest, block.table["no_text"].to_pylist())], pa.string())
        return pa.table([*[block.table[f"k{i}"] for i in range(kept)], left], names=[*[f"k{i}" for i in range(kept)], "kept"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   frequent: int = FREQUENT, keep: tuple[str, ...] = (), kept_text: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; or the columns ``keep`` and,
    under the name ``kept_text``, what is left of the text.

    The id must be an integer; null ids come first. Rows with one id are ordered
    by a hash of their text; of rows equal in both, one keeps what its text
    keeps, and in the others every byte also starts earlier. Null text is empty
    (and stays null in ``kept_text``). kept_text leaves out the stray bytes of a
    character that a cut divides; kept_sha256 is over the exact bytes. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(text).isNull().alias("no_text"),
                       *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = tx.bucket_count(docs)
    every = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks)))
    dealt = every.select("doc_id", "text", "tie", "block")
    states = tx.settle(dealt.groupBy("block").applyInArrow(tx.tidy_group(_anchor_counts(buckets, length, gram)), COUNT)
                       .groupBy("bucket").applyInArrow(tx.tidy_group(_anchor_states(frequent)), STATE), "repeats-anchors")
    sent = dealt.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(tx.tidy_group(_send(buckets, length, gram)), SENT)
    gone = tx.settle(sent.groupBy("bucket").applyInArrow(tx.tidy_group(_find_repeats(length)), GONE), "repeats-windows")
    blank = F.lit(None).cast("binary")
    answers = states.select("block", "bucket", "state", blank.alias("item"), blank.alias("lo"), blank.alias("hi")).unionByName(
        gone.select("block", "bucket", blank.alias("state"), "item", "lo", "hi"))
    if kept_text is None:
        fields = [("doc_id", tx.LONG), ("n_bytes", tx.LONG), ("n_removed", tx.LONG), ("n_spans", tx.LONG), ("kept_sha256", T.StringType())]
    else:
        fields = [*[(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], ("kept", T.StringType())]
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    done = every.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        tx.tidy_group(_finish(buckets, length, gram, len(keep), kept_text is not None)), out)
    return done if kept_text is None else done.toDF(*keep, kept_text)
