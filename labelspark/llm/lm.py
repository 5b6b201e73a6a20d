"""Language-model scoring with a weighted backoff automaton of smoothed bigrams.

Tokens are the words of a text (A-Z lowered) and one end token. The automaton has
a root state, a start state and a state for every training word. The state of h
has an arc for every w that followed h in training, and a failure arc to the
root; the root has an arc for every word:

* root:      p(w) = (c(w) + A) / (N + A (V + 1)), with one share for unseen words
* failure:   f(h) = 1 - sum over w that followed h of (c(h w) - D) / c(h)
* arc:       p(w | h) = (c(h w) - D) / c(h) + f(h) p(w)

so the weights of every state sum to one. A text is traversed once from the start
state: a token takes its arc, or the failure arc and the root's, and the log
weights add up; the next state is the token's own, or the root's if training has
not seen it.

No table of n-grams is sent whole to any task. Documents are dealt into blocks of
about ``BLOCK_BYTES``; a block asks for its distinct words and bigrams, combined
before the shuffle, in ranges of the word's or context's hash; each range counts,
smooths, and answers every block in the order it asked. Contexts that
hold more than a range's share of tokens, or a quarter of the share of one of the
session's ranges (at most four per range, so their list is bounded), and the start
state are dealt by the following word instead, and their failure weights summed over
the ranges. A range is one of about ``RANGE_BYTES`` of text, so that what a task holds
of it stays small whatever the session's partitions; beyond ``FINE_RANGES`` of them,
where every block's request to every range would cost more than it saves, there are
no more than those partitions ask for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

ADD = 0.1  # added to every count at the root
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 2 << 20
FINE_RANGES = 2048
ROWS = 256  # rows that wait outside Arrow while a table is made
START = np.uint64(0x51A27B0C5EED0001)
END = np.uint64(0x0E0D0E0D5EED0002)


def range_count(docs: DataFrame, size: int) -> int:
    """Power of two of hash ranges for ``size`` bytes of text."""
    fine = min(FINE_RANGES, -(-size // RANGE_BYTES))
    return max(tx.bucket_count(docs), 1 << max(0, fine - 1).bit_length())


def _token_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of runs of texts, end tokens included, and where each text of the run ends."""
    data, offsets = tx.text_buffers(texts)
    for i, j in tx.doc_chunks(offsets):
        words, first = tx.word_hashes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        yield np.insert(words, first[1:], END), first[1:] + np.arange(1, j - i + 1)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end tokens included, and the first token of each text."""
    parts, firsts, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for tokens, ends in _token_runs(texts):
        parts.append(tokens)
        firsts.append(base + ends)
        base += len(tokens)
    return np.concatenate(parts), np.concatenate(firsts)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of every value among them in 32 bits."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    distinct = ordered[new]
    del ordered
    place = np.cumsum(new, dtype=np.uint32)
    place -= np.uint32(1)
    out = np.empty(len(values), np.uint32)
    out[order] = place
    return distinct, out


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of several lists with the sums of their counts."""
    distinct, at = _distinct(np.concatenate([np.zeros(0, np.uint64), *words]))
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))
    return distinct, sums


def _table(rows: Iterable[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    rows, batches, schema = iter(rows), [], pa.schema(list(zip(names, types)))
    while some := list(islice(rows, ROWS)):
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], schema=schema))
    return pa.Table.from_batches(batches, schema)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    out = np.full(len(wanted), default, values.dtype)
    if len(keys):
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        out[hit] = values[at[hit]]
    return out


VOCABULARY = tx.schema(bucket=tx.INT, words=tx.BINARY, counts=tx.BINARY, distinct=tx.LONG, total=tx.LONG)


def vocabulary(docs: DataFrame, buckets: int) -> DataFrame:
    """Training counts of all tokens, a row per hash range. ``docs``: text, train."""

    def count(batches):
        for batch in batches:
            runs = [np.unique(tokens, return_counts=True) for tokens, _ in _token_runs(batch.column(0).filter(batch.column(1)))]
            words, counts = _summed([w for w, _ in runs], [c for _, c in runs])
            cuts = tx.bucket_cuts(words, buckets)
            full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([tx.pack(words[cuts[b]: cuts[b + 1]]) for b in full], pa.binary()),
                 pa.array([tx.pack(counts[cuts[b]: cuts[b + 1]]) for b in full], pa.binary())], ["bucket", "words", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        distinct, sums = _summed(*[[tx.unpack(x) for x in table[c].to_pylist()] for c in ("words", "counts")])
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([tx.pack(distinct)], pa.binary()),
                         pa.array([tx.pack(sums)], pa.binary()), pa.array([len(distinct)], pa.int64()),
                         pa.array([int(sums.sum())], pa.int64())], names=VOCABULARY.names)

    counted = docs.select("text", "train").mapInArrow(tx.tidy(count), tx.schema(bucket=tx.INT, words=tx.BINARY, counts=tx.BINARY))
    return tx.settle(counted.groupBy("bucket").applyInArrow(tx.tidy_group(merge), VOCABULARY), "lm-vocabulary")


def _frequent(vocab: DataFrame, least: int) -> dict[int, int]:
    """Words with at least ``least`` training tokens: at most total / least of them."""

    def pick(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, c = tx.unpack(words), tx.unpack(counts).astype(np.int64)
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(w[keep])), pa.array(c[keep])], ["word", "count"])

    found = vocab.select("words", "counts").mapInArrow(tx.tidy(pick), tx.schema(word=tx.LONG, count=tx.LONG)).collect()
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["count"] for r in found}


class Block:
    """The distinct words and bigrams of a block of texts, in the order they are asked for."""

    def __init__(self, texts: pa.Array, train: np.ndarray, frequent: np.ndarray, buckets: int):
        tokens, self.first = _tokens(texts)
        self.words, place = _distinct(np.append(tokens, START))
        del tokens
        self.token, start = place[:-1], place[-1]
        pairs = np.empty(len(self.token), np.uint64)  # first every token's pair, then the distinct ones
        pairs[1:] = self.token[:-1]
        pairs[self.first[:-1]] = start
        pairs <<= np.uint64(32)
        pairs |= self.token
        pairs, self.pair = _distinct(pairs)
        self.context = (pairs >> np.uint64(32)).astype(np.uint32)
        self.word = pairs.astype(np.uint32)
        trained = np.repeat(train, np.diff(self.first))
        self.count = np.bincount(self.pair[trained], minlength=len(pairs))
        del pairs, trained
        spread = np.isin(self.words, frequent)[self.context]
        self.word_cuts = tx.bucket_cuts(self.words, buckets)
        # pairs by the range of their context; those of frequent contexts by the range of their word
        plain, hot = np.flatnonzero(~spread), np.flatnonzero(spread)
        hot = hot[np.argsort(self.word[hot], kind="stable")]
        self.order = {"b": plain, "h": hot}
        self.cuts = {"b": np.searchsorted(self.context[plain], self.word_cuts),
                     "h": np.searchsorted(self.word[hot], self.word_cuts)}

    def requests(self, block: int, buckets: int):
        for b in range(buckets):
            lo, hi = self.word_cuts[b: b + 2]
            if hi > lo:
                yield b, "u", block, tx.pack(self.words[lo:hi]), None, None, None
            for kind in "bh":
                some = self.order[kind][self.cuts[kind][b]: self.cuts[kind][b + 1]]
                if len(some):
                    if kind == "h":  # contexts are few here: bring each one's pairs together
                        some = some[np.lexsort((self.word[some], self.context[some]))]
                    edge = np.flatnonzero(np.concatenate([[True], np.diff(self.context[some]) != 0]))
                    yield (b, kind, block, tx.pack(self.words[self.context[some[edge]]]),
                           tx.pack(np.diff(np.append(edge, len(some)))), tx.pack(self.words[self.word[some]]), tx.pack(self.count[some]))

    def place(self, kind: str, bucket: int, values: np.ndarray, out: np.ndarray) -> None:
        """Put a range's answer where it was asked for."""
        if kind == "u":
            out[self.word_cuts[bucket]: self.word_cuts[bucket + 1]] = values
            return
        some = self.order[kind][self.cuts[kind][bucket]: self.cuts[kind][bucket + 1]]
        if kind == "h":
            some = some[np.lexsort((self.word[some], self.context[some]))]
        out[some] = values


REQUEST = tx.schema(bucket=tx.INT, kind=T.StringType(), block=tx.LONG, keys=tx.BINARY, runs=tx.BINARY, words=tx.BINARY,
                    counts=tx.BINARY)
ANSWER = tx.schema(block=tx.LONG, bucket=tx.INT, kind=T.StringType(), counts=tx.BINARY, failure=tx.BINARY,
                   context=tx.LONG, kept=T.DoubleType())


def _ask(frequent: np.ndarray, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table["text"], table["train"].to_numpy().astype(bool), frequent, buckets)
        types = [pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4]
        return _table(block.requests(table["block"][0].as_py(), buckets), types, REQUEST.names)

    return run


def _count_pairs(rows: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Total count of every pair of every row (0: never in training); contexts and their discounted sums."""
    if not rows:
        return [], np.zeros(0, np.uint64), np.zeros(0)
    context = np.concatenate([np.repeat(tx.unpack(r["keys"]), tx.unpack(r["runs"]).astype(np.int64)) for r in rows])
    parts = [tx.unpack(r["words"]) for r in rows]
    word, count = np.concatenate(parts), np.concatenate([tx.unpack(r["counts"]) for r in rows]).astype(np.int64)
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    edge = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
    total = np.add.reduceat(count[order], edge)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(edge, len(order))))
    of = c[edge]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    kept = np.add.reduceat(np.where(total > 0, total - DISCOUNT, 0.0), first)
    bounds = np.cumsum([len(p) for p in parts])[:-1]
    return np.split(out, bounds), of[first], kept


def _answer(table: pa.Table) -> pa.Table:
    """Of one range: counts and failure weights of the words asked for, counts of the bigrams."""
    rows = table.to_pylist()
    bucket = rows[0]["bucket"]
    vocab = [r for r in rows if r["kind"] == "v"]
    words = tx.unpack(vocab[0]["keys"]) if vocab else np.zeros(0, np.uint64)
    counts = tx.unpack(vocab[0]["counts"]).astype(np.int64) if vocab else np.zeros(0, np.int64)
    out = []
    plain, hot = [r for r in rows if r["kind"] == "b"], [r for r in rows if r["kind"] == "h"]
    found, contexts, kept = _count_pairs(plain)
    out += [(r["block"], bucket, "b", tx.pack(v), None, None, None) for r, v in zip(plain, found)]
    seen = _lookup(words, counts, contexts, 0)
    failure = 1.0 - np.divide(kept, seen, out=np.zeros(len(kept)), where=seen > 0)
    for r in rows:
        if r["kind"] == "u":
            asked = tx.unpack(r["keys"])
            out.append((r["block"], bucket, "u", tx.pack(_lookup(words, counts, asked, 0)),
                        _lookup(contexts, failure, asked, 1.0).astype("<f8").tobytes(), None, None))
    found, contexts, kept = _count_pairs(hot)
    out += [(r["block"], bucket, "h", tx.pack(v), None, None, None) for r, v in zip(hot, found)]
    out += [(None, bucket, "s", None, None, c, k) for c, k in zip(tx.signed(contexts).tolist(), kept.tolist())]
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.float64()]
    return _table(out, types, ANSWER.names)


def _traverse(frequent: dict[int, tuple[int, float]], buckets: int, total: int, distinct: int, names: list[str]):
    keys = np.sort(np.array(list(frequent), np.uint64))
    floor = ADD / (total + ADD * (distinct + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs["text"], docs["train"].to_numpy().astype(bool), keys, buckets)
        count, failure = np.zeros(len(block.words), np.int64), np.ones(len(block.words))
        arcs = np.zeros(len(block.context), np.int64)
        for r in (r for some in answers.to_batches(ROWS) for r in some.to_pylist()):
            if r["kind"] == "u":
                block.place("u", r["bucket"], tx.unpack(r["counts"]).astype(np.int64), count)
                block.place("u", r["bucket"], np.frombuffer(r["failure"], "<f8"), failure)
            else:
                block.place(r["kind"], r["bucket"], tx.unpack(r["counts"]).astype(np.int64), arcs)
        state_count = count.copy()
        for k in np.flatnonzero(np.isin(block.words, keys)):
            state_count[k], failure[k] = frequent[int(block.words[k])]
        unigram = (count + ADD) / (total + ADD * (distinct + 1))
        # weight of every transition the block takes, then one pass over its tokens in order
        c, w = block.context, block.word
        weight = failure[c] * unigram[w]
        has = (arcs > 0) & (state_count[c] > 0)
        weight[has] += (arcs[has] - DISCOUNT) / state_count[c][has]
        first, token = block.first[:-1], block.token
        base = np.add.reduceat(np.log10(unigram)[token], first)
        score = np.add.reduceat(np.log10(np.maximum(weight, floor * 1e-9))[block.pair], first)
        known = np.add.reduceat((count > 0)[token].astype(np.int64), first)
        return pa.table([docs["doc_id"].combine_chunks() if docs["doc_id"].num_chunks != 1 else docs["doc_id"].chunk(0),
                         pa.array(~docs["train"].to_numpy().astype(bool)), pa.array(np.diff(block.first)), pa.array(known),
                         pa.array(np.full(len(known), total, np.int64)), pa.array(base), pa.array(score)], names=names)

    return run


def score_documents(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train``: boolean column of the rows to learn from. Null text is empty: its
    one token is the end. Null ids are kept; repeated rows count again and score
    alike; without training rows every token is unseen. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
                    F.count_if("train").alias("train")).first()
    buckets = range_count(docs, size.bytes)
    vocab = vocabulary(rows, buckets)
    sums = vocab.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    hot = _frequent(vocab, max(1, sums.n // max(buckets, 4 * tx.bucket_count(docs))))
    hot.pop(int(END), None)
    hot[int(START)] = size.train
    keys = np.sort(np.array(list(hot), np.uint64))
    blocks = max(1, -(-size.bytes // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(tx.tidy_group(_ask(keys, buckets)), REQUEST)
    known = vocab.select("bucket", F.lit("v").alias("kind"), F.lit(None).cast("long").alias("block"), F.col("words").alias("keys"),
                         F.lit(None).cast("binary").alias("runs"), F.lit(None).cast("binary").alias("words"), "counts")
    answers = tx.settle(asked.unionByName(known).groupBy("bucket").applyInArrow(tx.tidy_group(_answer), ANSWER), "lm-answers")
    kept = {r["context"] & 0xFFFFFFFFFFFFFFFF: r["kept"]
            for r in answers.where("kind = 's'").groupBy("context").agg(F.sum("kept").alias("kept")).collect()}
    states = {w: (c, 1.0 - kept.get(w, 0.0) / c if c else 1.0) for w, c in hot.items()}
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()),
                        T.StructField("n_tokens", tx.LONG), T.StructField("n_known", tx.LONG),
                        T.StructField("train_tokens", tx.LONG), T.StructField("base_score", T.DoubleType()),
                        T.StructField("score", T.DoubleType())])
    replies = answers.where("kind <> 's'").select("block", "bucket", "kind", "counts", "failure")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        tx.tidy_group(_traverse(states, buckets, sums.n, sums.v, out.names)), out)
