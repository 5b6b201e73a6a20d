"""Language identification by cross-parsing entropy.

For every learned language a reference text is kept as a suffix automaton over
bytes. A text is parsed from left to right into the longest phrases that occur
in the reference; the fewer phrases it needs, the nearer the language. The
phrase count is normalised to bits per byte, ``phrases * log2(reference
length) / bytes`` (the Ziv-Merhav cross-parsing estimate), and the language
with the smallest value wins; ties go to the smaller name.

Texts are lowered, ASCII characters other than letters count as blanks, and runs
of blanks as one. A text is parsed whole, in blocks of ``BLOCK`` bytes that each
begin a new phrase, so a batch steps through all blocks of all its texts and all
languages at once by table look-ups, and a very long text costs no more per byte
than a short one.

Learning uses a bounded sample of labelled texts: texts in order of a hash of id
and text, until a language has ``REFERENCE_BYTES`` bytes, and less where there
are more than ``TOTAL_BYTES / REFERENCE_BYTES`` languages. Prediction covers
every text and has no shuffle.
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

REFERENCE_BYTES = 32_768  # labelled text kept per language
TOTAL_BYTES = 262_144  # and over all languages
SAMPLE_ROWS = 256  # labelled texts looked at per language
BLOCK = 1024
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)  # lowered text: ASCII but letters becomes a blank
_FOLD[:97] = 32
_FOLD[123:128] = 32


class SuffixAutomaton:
    """States and transitions that read exactly the substrings of a sequence."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in symbols:
            here = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = here
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[here] = clone
            last = here


class CrossParser:
    """The automata of all languages as one table of (next state, phrase ends here)."""

    def __init__(self, references: dict[str, bytes]):
        self.languages = sorted(references)
        texts = [references[k] for k in self.languages]
        seen = sorted({b for t in texts for b in t})
        self.symbol = np.zeros(256, np.int64)  # 0: a byte no reference has
        for k, b in enumerate(seen):
            self.symbol[b] = k + 1
        self.width = len(seen) + 1
        tables, self.roots, base = [], [], 0
        for t in texts:
            automaton = SuffixAutomaton(int(self.symbol[b]) for b in t)
            n = len(automaton.next)
            root = np.full(self.width, -1, np.int64)
            for c, s in automaton.next[0].items():
                root[c] = s
            # no transition: a phrase ends and the next one begins with this symbol
            row = np.where(root >= 0, root, 0)
            table = np.tile(2 * self.width * (base + row) + 1, (n, 1))
            for s, arcs in enumerate(automaton.next):
                for c, to in arcs.items():
                    table[s, c] = 2 * self.width * (base + to)
            self.roots.append(base * self.width)
            tables.append(table.astype(np.int64 if (base + n) * self.width >= 1 << 30 else np.int32).ravel())
            base += n
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = [math.log2(max(len(t), 2)) for t in texts]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(lengths[doc] - rank * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        doc, rank, size = doc[order], rank[order], size[order]
        start = offsets[doc] + rank * BLOCK
        symbols = self.symbol[data]
        state = np.repeat(np.array(self.roots)[:, None], len(doc), axis=1)
        count = np.ones((len(self.roots), len(doc)), np.int64)
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")  # blocks longer than t
        for t in range(steps):
            k = int(active[t])
            step = self.table[state[:, :k] + symbols[start[:k] + t]]
            count[:, :k] += step & 1
            state[:, :k] = step >> 1
        out = np.zeros((len(lengths), len(self.roots)), np.int64)
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(doc, weights=count[k], minlength=len(lengths))
        return out

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per byte of every text in every language."""
        return self.phrases(data, offsets) * np.array(self.bits) / np.maximum(np.diff(offsets), 1)[:, None]


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blanks for ASCII other than letters, and one blank for a run of them inside a text."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    blank = folded == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offsets[:-1][offsets[:-1] < len(folded)]
    keep[inner] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          reference_bytes: int = REFERENCE_BYTES, total_bytes: int = TOTAL_BYTES,
          sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Reference bytes per language from labelled rows (null text or lang: not used).

    The sample is drawn on hashes, thinned where they are read; only its rows'
    texts are shuffled. What is broadcast has a row per language, and then
    ``sample_rows`` per language at most.
    """
    rows = (docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                        F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"))
            .where("text IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'"))
    first = Window.partitionBy("lang").orderBy("h")
    # thin each language by its hash to a few times the sample before ranking (all of it, if it is small)
    share = rows.groupBy("lang").agg((4 * sample_rows / F.count("*")).alias("share"))
    thinned = rows.select("lang", "h").join(F.broadcast(share), "lang").where(
        F.pmod("h", F.lit(1 << 30)) < F.least(F.col("share"), F.lit(1.0)) * (1 << 30))
    drawn = tx.settle(thinned.select("lang", "h").distinct().withColumn("k", F.row_number().over(first))
                      .where(F.col("k") <= sample_rows), "langid-sample")
    kept = rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    per = [(r["lang"], r["n"]) for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    room = min(reference_bytes, total_bytes // max(len(per), 1))
    capped = (kept.withColumn("text", F.substring("text", 1, room))
              .withColumn("before", F.sum(F.length("text")).over(first) - F.length("text"))
              .where(F.col("before") < room).orderBy("lang", "h"))
    found: dict[str, bytearray] = {}
    for r in capped.toLocalIterator():
        raw = np.frombuffer(r["text"].lower().encode(), np.uint8)
        folded, _ = normalise(raw, np.array([0, len(raw)]))
        have = found.setdefault(r["lang"], bytearray())
        have += folded.tobytes()[: max(room - len(have), 0)]
    return {k: bytes(v) for k, v in found.items()}


def predict(docs: DataFrame, references: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = (),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score (under ``names``).

    lang_pred is ``und`` (score 0) for null text, text without a letter, or when
    no language was learned. The score is the share of the runner-up's cost in
    the two best costs (0.5: undecided; 1 with a single language). Every row
    gets one result; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(CrossParser(references))
    kept = [docs.schema[c] for c in keep]
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).alias("text")]))
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept is sent once
    out = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)]
                       + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        parser = shared.value
        for batch in batches:
            lang, score = _judge(parser, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    told = narrow.mapInArrow(tx.tidy(run), out)
    return told.toDF(*keep, *names)


def _judge(parser: CrossParser, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = tx.text_buffers(pc.utf8_lower(texts))
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not parser.languages:
        return lang, score
    for i, j in tx.doc_chunks(offsets):
        part = data[offsets[i]: offsets[j]]
        at = offsets[i: j + 1] - offsets[i]
        folded, short = normalise(part, at)
        known = np.concatenate([[0], np.cumsum(folded != 32)])[short]
        cost = parser.costs(folded, short)
        best = cost.argmin(axis=1)
        low = cost[np.arange(j - i), best]
        if cost.shape[1] > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            sure = np.divide(second, low + second, out=np.ones(j - i), where=low + second > 0)
        else:
            sure = np.ones(j - i)
        ascii_letter = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])[short]
        for d in range(j - i):
            if known[d + 1] == known[d]:
                continue
            if ascii_letter[d + 1] == ascii_letter[d] and not has_letter(texts[i + d].as_py()):
                continue
            lang[i + d] = parser.languages[best[d]]
            score[i + d] = sure[d]
    return lang, score


def identify(docs: DataFrame) -> DataFrame:
    """Learn on the folds 0, 1 and 3 of ``docs`` and predict every row."""
    model = learn(docs.where(tx.fold("doc_id", 4) != 2))
    return (predict(docs, model, keep=("doc_id",))
            .select("doc_id", (tx.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


def drop_undetermined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: null texts and texts
    without a letter go, and where no language could be learned only these."""
    references = learn(docs.where(tx.fold(doc_id, 4) != 2), doc_id, text, lang)
    if not references:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    told = predict(docs, references, text, tuple(docs.columns), ("_told_language", "_told_score"))
    return told.where(F.col("_told_language") != UNDETERMINED).select(*docs.columns)
