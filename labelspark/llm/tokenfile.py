"""Token ids in Arrow stream files of equal-length sequences.

Texts are encoded by a public tokenizer file, an end id follows each document,
and the ids of all documents in ascending id order are cut into sequences of
``LENGTH`` ids. A part file is an Arrow IPC file whose record batches hold
``ROWS`` sequences each in two fixed-size-list columns, ``ids`` (uint16 where the
vocabulary fits, else uint32) and ``mask`` (bits, false where the last sequence of
a file is padded), so any sequence and any run of ids is found by arithmetic and
read as a view of the mapped file, without a copy. A second Arrow file per part lists its documents with their
first id and number of ids.

Documents are dealt to parts by ranges of their id; a task writes one part under
a name of its own attempt and returns one manifest row, so a repeated or lost
task never leaves a half-written part in the manifest. Offsets over all parts are
sums over the manifest, which has a row per part.

Texts are cut where the tokenizer's pattern always begins a new pre-token, and
each distinct piece is encoded once by a worker.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
LENGTH = 2048  # ids of a sequence
ROWS = 64  # sequences of a record batch
CACHED = 3_000_000  # distinct text pieces a worker remembers at a time

# 0: ASCII blanks and control characters, 1: letters, 2: punctuation, 3: bytes of wide characters, 4: digits
_KIND = np.full(256, 2, np.uint8)
_KIND[:33], _KIND[127], _KIND[128:], _KIND[48:58] = 0, 0, 3, 4
_KIND[65:91], _KIND[97:123] = 1, 1


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare name is a file of the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts, each distinct piece once as long as it is remembered."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of known pieces, ascending
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def pieces(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Piece starts and the first piece of each text.

        A pre-token always begins at a text, at a single blank between other
        characters (next to a byte of a wide character, which may be a blank
        itself, the other side must be ASCII), at ASCII punctuation after an ASCII letter,
        and at an ASCII letter after a single line end. Where a special token's
        string occurs, nothing is cut but texts.
        """
        cut = np.zeros(len(data), bool)
        if len(data) > 2 and not any(t in raw for t in self.added):
            kind = _KIND[data]
            before, here, after = kind[:-2], kind[1:-1], kind[2:]
            middle = cut[1:-1]
            middle |= (data[1:-1] == 0x20) & (before != 0) & (after != 0) & ((before != 3) | (after != 3))
            middle |= (here == 2) & (before == 1)
            line = (data[1:-1] == 0x0A) & ((before == 1) | (before == 2)) & (after == 1)
            middle |= line
            cut[2:] |= line
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)

    def _learn(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new pieces (ascending hashes) and remember them."""
        found = self.tokenizer.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())],
                                            add_special_tokens=False)
        ids = [e.ids for e in found]
        size = np.array([len(x) for x in ids], np.int64)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the ids per text."""
        raw = data.tobytes()
        starts, first = self.pieces(data, offsets, raw)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        distinct, one, inverse = np.unique(tx.span_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], raw, starts[one[new]], ends[one[new]])
        at = np.searchsorted(self.keys, distinct)[inverse.ravel()]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        per_text = np.diff(total[first]) + 1
        out = np.empty(int(per_text.sum()), np.uint32)
        last = np.zeros(len(out), bool)
        last[np.cumsum(per_text) - 1] = True
        out[~last] = self.ids[np.arange(int(total[-1])) + np.repeat(self.start[at] - total[:-1], size)]
        out[last] = end_id
        return out, per_text


def worker_encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker: tasks that follow each other share what it remembers."""
    store = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if tokenizer not in vars(store):
        setattr(store, tokenizer, Encoder(tokenizer))
    return vars(store)[tokenizer]


def _sequence_schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class PartWriter:
    """Writes one part: sequences of ids as they come, then the padded rest."""

    def __init__(self, sink, length: int, rows: int, vocabulary: int):
        self.length, self.size = length, length * rows
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema = _sequence_schema(length, pa.from_numpy_dtype(self.kind))
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.count = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.count += len(ids)
        if self.count >= self.size:
            joined = np.concatenate(self.held)
            whole = len(joined) // self.size * self.size
            for lo in range(0, whole, self.size):
                self._batch(joined[lo: lo + self.size])
            self.held, self.count = [joined[whole:]], len(joined) - whole

    def _batch(self, ids: np.ndarray) -> None:
        padded = -len(ids) % self.length
        mask = np.ones(len(ids) + padded, bool)
        mask[len(ids):] = False
        ids = np.concatenate([ids, np.zeros(padded, self.kind)])
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.count:
            self._batch(np.concatenate(self.held))
        self.writer.close()


class PartReader:
    """Random access to a part; local files are mapped, so what it returns are views."""

    def __init__(self, path: str):
        fs, where = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence."""
        batch, row = divmod(k, self.rows)
        columns = self.file.get_batch(batch).columns
        ids, mask = (c.flatten().slice(row * self.length, self.length) for c in columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def runs(self, start: int, n: int):
        """The ids ``start`` to ``start + n`` as views, one per record batch touched."""
        size = self.rows * self.length
        while n > 0:
            batch, at = divmod(start, size)
            got = self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)[at: at + n]
            yield got
            start, n = start + len(got), n - len(got)


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                      end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write all documents in ascending id order under ``folder`` and return the manifest.

    The manifest has a row per part: path, index_path, first_id, first_tie,
    n_docs, n_ids. Null text is empty (its end id only); null ids come first;
    rows with one id are ordered by a hash of their text. An empty table writes
    nothing and gives an empty manifest.
    """
    id_type = docs.schema[doc_id].dataType
    dealt = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
             .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("index_path", T.StringType()),
                        T.StructField("first_id", id_type), T.StructField("first_tie", tx.LONG),
                        T.StructField("n_docs", tx.LONG), T.StructField("n_ids", tx.LONG)])

    def run(batches):
        part = index = encoder = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                task = TaskContext.get()
                name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
                fs, where = pafs.FileSystem.from_uri(name)
                fs.create_dir(os.path.dirname(where), recursive=True)
                sink, index_sink = fs.open_output_stream(where + ".tokens.arrow"), fs.open_output_stream(where + ".docs.arrow")
                encoder = worker_encoder(tokenizer)
                part = PartWriter(sink, length, rows, encoder.tokenizer.get_vocab_size())
                fields = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, fields)
                first = (batch.column(0)[0], batch.column(2)[0])
                start = 0
            data, offsets = tx.text_buffers(batch.column(1))
            for i, j in tx.doc_chunks(offsets):
                ids, sizes = encoder.encode(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], end_id)
                part.add(ids)
                starts = start + np.concatenate([[0], np.cumsum(sizes)])
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(starts[:-1]), pa.array(sizes)], schema=fields))
                start = int(starts[-1])
                n_docs += j - i
        if part is not None:
            part.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name + ".tokens.arrow"]), pa.array([name + ".docs.arrow"]),
                 pa.array([first[0].as_py()], fields.field(0).type), pa.array([first[1].as_py()], pa.int64()),
                 pa.array([n_docs], pa.int64()), pa.array([start], pa.int64())], out.names)

    return tx.settle(dealt.mapInArrow(run, out), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the parts."""
    id_type = manifest.schema["first_id"].dataType
    before = F.sum("n_ids").over(Window.orderBy("first_id", "first_tie", "path").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", "index_path", F.coalesce(before, F.lit(0)).alias("base"))
    parts = max(1, manifest.count())
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", tx.LONG),
                        T.StructField("n_tokens", tx.LONG), T.StructField("ids_crc32", tx.LONG)])

    def run(batches):
        for batch in batches:
            for path, index_path, base in zip(*(c.to_pylist() for c in batch.columns)):
                part = PartReader(path)
                fs, where = pafs.FileSystem.from_uri(index_path)
                with fs.open_input_file(where) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        starts, sizes = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                        sums = []
                        for start, n in zip(starts, sizes):
                            crc = 0
                            for ids in part.runs(start, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [docs.column(0), pa.array([base + s for s in starts], pa.int64()), docs.column(2),
                             pa.array(sums, pa.int64())], out.names)

    return placed.repartition(parts, "path").mapInArrow(run, out)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Write token files of ``docs`` in the shared folder and read them back (see the two functions)."""
    from labelspark.session import checkpoint_dir

    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, doc_id, text, tokenizer))
