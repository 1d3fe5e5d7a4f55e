"""Byte-pair encoding and decoding.

A word starts as its bytes, one symbol each, in a doubly linked list. A
priority queue holds the merge rank of every adjacent pair; the lowest rank
(leftmost on a tie) is merged first, its two neighbours are queued anew, and an
entry whose symbols have changed meanwhile is stale and skipped. Decoding
concatenates the vocabulary strings of the ids and reads the bytes as UTF-8.

Texts are split into words as the vocabulary file says, special strings inside
a text become their own id, and nothing is truncated or padded. Spark deals the
rows; a worker holds the vocabulary and a bounded memo of words already merged,
so the memory of a task does not grow with the data.

Defined cases: null text and empty text have no ids and decode to ''; repeated
rows stay; every other column is passed through unchanged; an id array that is
null decodes to ''; unknown ids add nothing; bytes that are not UTF-8 decode to
U+FFFD. The output columns must not exist in the input (ValueError).
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pretokens import BytePieces, byte_alphabet, load_vocabulary
from ._text import tidy

#: bytes of results before a batch of them is handed back
OUT_BYTES = 4 << 20


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        spec = load_vocabulary(path)
        vocab = spec["vocab"]
        byte_of = byte_alphabet()
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["merges"])}
        self.first = [0] * 256
        for ch, b in byte_of.items():
            self.first[b] = vocab[ch]
        self.special = spec["special"]
        self.strings = np.full(1 + max([*vocab.values(), *self.special.values()]), b"", dtype=object)
        for s, i in vocab.items():
            self.strings[i] = bytes(byte_of[ch] for ch in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.pieces = BytePieces(lambda words: [struct.pack(f"<{len(ids)}i", *ids) for ids in (self.merge(w.encode()) for w in words)], self.special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.first[b] for b in word]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged away
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return next(self.pieces.many(pa.array([text], pa.string())))

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids, special tokens included."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.strings)):
            ids = ids[(ids >= 0) & (ids < len(self.strings))]
        return b"".join(self.strings[ids].tolist()).decode("utf-8", errors="replace")


def _check_new(df: DataFrame, *names: str) -> None:
    have = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() in have:
            raise ValueError(f"the input already has a column {n!r}: name another output column")


def _with_column(batch: pa.RecordBatch, start: int, column: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    part = batch.slice(start, len(column))
    return pa.RecordBatch.from_arrays([*part.columns, column], schema=schema)


def encode_documents(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` array<int>: the ids of each whole text."""
    _check_new(df, ids_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = BytePairCodec(path)  # of this task: its memo goes with it
        for batch in batches:
            schema = batch.schema.append(pa.field(ids_col, pa.list_(pa.int32())))
            texts, rows, size, start = batch.column(at), [], 0, 0
            for i, ids in enumerate(bp.pieces.many(texts)):
                rows.append(ids)
                size += 4 * len(ids)
                if size >= OUT_BYTES or i == len(texts) - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                    yield _with_column(batch, start, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows))), schema)
                    start, rows, size = i + 1, [], 0

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), True)]))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col`` string: the vocabulary strings of the ids, joined."""
    _check_new(df, text_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = BytePairCodec(path)  # of this task: its memo goes with it
        for batch in batches:
            schema = batch.schema.append(pa.field(text_col, pa.string()))
            lists, rows, size, start = batch.column(at), [], 0, 0
            for i in range(len(lists)):
                ids = lists[i].values.to_numpy() if lists[i].is_valid else ()
                rows.append(bp.decode(ids))
                size += 4 * len(ids)
                if size >= OUT_BYTES or i == len(lists) - 1:
                    yield _with_column(batch, start, pa.array(rows, pa.string()), schema)
                    start, rows, size = i + 1, [], 0

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType(), True)]))


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Both of the above in one pass over the rows: the ids of each text, and
    what these ids decode to."""
    _check_new(df, ids_col, decoded_col)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), True), T.StructField(decoded_col, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = BytePairCodec(path)  # of this task: its memo goes with it
        for batch in batches:
            wide = batch.schema.append(pa.field(ids_col, pa.list_(pa.int32()))).append(pa.field(decoded_col, pa.string()))
            texts, rows, size, start = batch.column(at), [], 0, 0
            for i, ids in enumerate(bp.pieces.many(texts)):
                rows.append(ids)
                size += 4 * len(ids)
                if size >= OUT_BYTES or i == len(texts) - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                    part = batch.slice(start, len(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(map(bp.decode, rows), pa.string())], schema=wide)
                    start, rows, size = i + 1, [], 0

    return df.mapInArrow(tidy(run), schema)


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256, all from the ids."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return encode_and_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
