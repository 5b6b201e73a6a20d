"""Toxicity by compression distance between two zstandard dictionaries.

Text is compressed as word codes: every word (a run of letters, lowered) becomes
32 bytes, 16 that depend on its first ``STEM`` bytes and 16 on all of it. A word
or stem that a dictionary knows is one long match, any other is incompressible,
so compressed lengths count unknown words instead of letters.

One dictionary is trained on ordinary texts. The other is trained on toxic texts,
on the words that the first one cannot shorten, and is used in front of the
first: common words then cost the same under both. A text is compressed in windows
of ``WINDOW`` words by both; the bytes that the toxic dictionary saves, summed
over the windows and divided by their number, and the largest saving of a window
give the score through a logistic curve calibrated on labelled texts that trained
neither dictionary. The size of the toxic dictionary is the one of ``SIZES`` that
fits these texts best.

Training takes a bounded sample of labelled rows: per class at most
``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes in order of a hash of the id (a
text that passes the bound alone is left out). The sample meets in one task,
which returns the dictionaries and the curve. Scoring has no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx
from labelspark.llm.langid import normalise

STEM = 4
CODE = 16
WINDOW = 8
ORDINARY_BYTES = 131_072  # size of the ordinary dictionary
SIZES = (512, 1024, 2048, 4096)  # of the toxic one
SAMPLE_ROWS = {0: 5_000, 1: 2_500}
SAMPLE_BYTES = {0: 16 << 20, 1: 8 << 20}
THRESHOLD = 0.3
_PAD = bytes(range(1, 33))  # the last bytes of a window are never matched


def word_codes(texts: pa.Array) -> list[np.ndarray]:
    """Codes (words x 4 uint64) of every text."""
    data, offsets = tx.text_buffers(pc.utf8_lower(texts))
    folded, at = normalise(data, offsets)
    out = []
    for i, j in tx.doc_chunks(at):
        part = folded[at[i]: at[j]]
        starts, ends, first = tx.word_bounds(part, at[i: j + 1] - at[i])
        stem = tx.mix64(tx.span_hashes(part, starts, np.minimum(starts + STEM, ends)) ^ np.uint64(0x57E3))
        word = tx.span_hashes(part, starts, ends)
        codes = np.stack([stem, tx.mix64(stem + np.uint64(1)), word, tx.mix64(word + np.uint64(1))], axis=1) if len(starts) else np.zeros((0, 4), np.uint64)
        out += [codes[first[k]: first[k + 1]] for k in range(j - i)]
    return out


def _train(codes: np.ndarray, size: int) -> bytes:
    """A dictionary trained on single codes (n x 2 uint64); all of them if they are too few to train on."""
    import zstandard

    raw = codes.astype("<u8").tobytes()
    samples = [raw[i: i + CODE] for i in range(0, len(raw), CODE)]
    try:
        return zstandard.train_dictionary(size, samples, k=CODE, d=8).as_bytes()[-size:]
    except zstandard.ZstdError:
        return np.unique(codes, axis=0).astype("<u8").tobytes()[-size:]


def compressor(content: bytes):
    """Compressor that finds every match of a code in the dictionary."""
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=18, chain_log=18, search_log=3, min_match=6, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_dict_id=False, write_checksum=False)
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=shared)


class Distance:
    """Compression lengths under the ordinary dictionary alone and behind the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic + ordinary)

    def features(self, codes: np.ndarray) -> tuple[float, float, float]:
        """Mean saving of a window, largest saving, log of the number of windows."""
        raw, step = codes.astype("<u8").tobytes(), 2 * CODE * WINDOW
        saved = [len(self.ordinary.compress(w)) - len(self.toxic.compress(w))
                 for w in (raw[i: i + step] + _PAD for i in range(0, len(raw), step))]
        saved = [max(x, 0) for x in saved] or [0]
        return sum(saved) / len(saved), max(saved) / CODE, math.log(len(saved))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights (constant first) by Newton steps, and the mean log loss."""
    z = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])

    def loss(w):
        m = z @ w
        return float(np.mean(np.logaddexp(0, m) - y * m) + 0.5 * (w @ keep @ w) / len(y))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w, loss(w)


MODEL = tx.schema(ordinary=tx.BINARY, toxic=tx.BINARY, weights=T.ArrayType(T.DoubleType()))


def _fit(table: pa.Table) -> pa.Table:
    """Dictionaries and curve from the sample (text, toxic, calibrate, h)."""
    table = table.sort_by("h")
    y, calibrate = table["toxic"].to_numpy().astype(np.float64), table["calibrate"].to_numpy()
    codes = word_codes(table["text"])
    none = np.zeros((0, 4), np.uint64)
    plain = np.concatenate([none, *[c for c, t, k in zip(codes, y, calibrate) if not t and not k]])
    bad = np.concatenate([none, *[c for c, t, k in zip(codes, y, calibrate) if t and not k]])
    bad = bad.reshape(-1, 2)
    ordinary = _train(plain.reshape(-1, 2), ORDINARY_BYTES) if len(plain) else b""
    distinct, at = np.unique(bad[:, 0], return_inverse=True)
    full = np.stack([distinct, np.zeros_like(distinct)], axis=1)
    full[at.ravel(), 1] = bad[:, 1]
    alone = compressor(ordinary)
    unknown = len(alone.compress(tx.mix64(np.arange(2, dtype=np.uint64)).tobytes() + _PAD))
    known = np.array([len(alone.compress(c.astype("<u8").tobytes() + _PAD)) < unknown for c in full], bool)
    rest = bad[~known[at.ravel()]] if len(bad) else bad
    best = None
    check = np.flatnonzero(calibrate)
    for size in SIZES:
        toxic = _train(rest, size) if len(rest) else b""
        distance = Distance(ordinary, toxic)
        x = np.array([distance.features(codes[k]) for k in check]).reshape(-1, 3)
        weights, loss = _logistic(x, y[check])
        if best is None or loss < best[0]:
            best = (loss, toxic, weights.tolist())
    return pa.table([pa.array([ordinary], pa.binary()), pa.array([best[1]], pa.binary()), pa.array([best[2]], pa.list_(pa.float64()))],
                    names=MODEL.names)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(ordinary dictionary, toxic dictionary, weights) from labelled rows, or the constant share of
    label 1 if one class is missing (no labels: 0)."""
    told = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"))
    counts = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(counts.get(1, 0) > 0)
    limit = F.when(F.col("toxic") == 1, SAMPLE_ROWS[1]).otherwise(SAMPLE_ROWS[0])
    share = F.when(F.col("toxic") == 1, 4 * SAMPLE_ROWS[1] / counts[1]).otherwise(4 * SAMPLE_ROWS[0] / counts[0])
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    drawn = tx.settle(told.where(F.pmod("h", F.lit(1 << 30)) < F.least(share, F.lit(1.0)) * (1 << 30)).distinct()
                      .withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k"), "toxicity-drawn")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    sample = rows.join(F.broadcast(drawn), "doc_id").withColumn("bytes", F.octet_length("text"))
    room = F.when(F.col("toxic") == 1, SAMPLE_BYTES[1]).otherwise(SAMPLE_BYTES[0])
    sample = (sample.where(F.col("bytes") <= room).withColumn("sum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .where(F.col("sum") <= room).select("text", "toxic", (F.pmod("h", F.lit(4)) == 0).alias("calibrate"), "h", F.lit(0).alias("one")))
    fitted = sample.groupBy("one").applyInArrow(_fit, MODEL).first()
    return (bytes(fitted.ordinary), bytes(fitted.toxic), list(fitted.weights)) if fitted else 0.0


def score_texts(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of every row with score and predicted.

    Null, empty and letterless texts save nothing and get the curve's value
    there. Every row gets one result; other columns are ignored.
    """
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    if isinstance(model, float):
        told = narrow.drop("text").withColumn("score", F.lit(model))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            ordinary, toxic, weights = shared.value
            distance = None
            for batch in batches:
                distance = distance or Distance(ordinary, toxic)
                texts = batch.column(len(keep))
                x = np.array([distance.features(c) for i, j in tx.doc_chunks(tx.text_buffers(texts)[1])
                              for c in word_codes(texts.slice(i, j - i))]).reshape(-1, 3)
                z = weights[0] + x @ np.array(weights[1:])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], out.names)

        told = narrow.mapInArrow(run, out)
    return told.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).toDF(*keep, "score", "predicted")


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels in the folds 0, 1 and 3 and score every row of ``docs``.

    Null and empty texts are scored like any other. Null ids are scored and join
    no label; repeated rows are scored alike, repeated labels count once, an id with
    both labels teaches both. A score equal to ``THRESHOLD`` is predicted 1. Other
    columns of either table are ignored, whatever their names; an empty table gives
    an empty result, and labels of one class or none give that class as the score.
    """
    model = learn(docs, labels.where(tx.fold("doc_id", 4) != 2))
    return (score_texts(docs, model, keep=("doc_id",))
            .select("doc_id", (tx.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted"))
