"""Token ids in a chunked binary format of compressed bit planes.

Documents are put in ascending id order (range partitions, each one a shard).
A shard's ids, every document closed by an end id, form one stream that is cut
into blocks of ``BLOCK`` ids. A block is transposed into 4 byte planes (or 32
bit planes; for token ids byte planes come out smaller) and each plane is compressed with zstandard; planes of zeros take
no space. Blocks are written as rows of a Parquet table: the payload, its place
in the stream and the chunk index (which document has which ids of the block).
Spark's committer writes the files, so a lost task leaves no half file and any
store that Spark can write will do.

A payload is: ``magic`` 4 bytes, plane kind 1 byte (0 bit, 1 byte), 3 bytes 0,
n_ids u4, then one u4 compressed size per plane, then the planes in order, the
least significant one first. Integers are little-endian.

Memory of a task: one block and one document. A document may span blocks; its
parts are read independently and their checksums combined.

Defined cases: null and empty texts have the end id only; null ids come first;
rows with equal ids are ordered by a hash of their text, and equal rows are
kept; an empty table gives an empty file table. No other columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._library_ids import encoder
from ._text import tidy

MAGIC = b"BPL1"
BLOCK = 1 << 16
LEVEL = 3
#: bytes of payload that a task holds before it hands a batch on
OUT_BYTES = 4 << 20


# ---------------------------------------------------------------- the format


def pack(ids: np.ndarray, kind: str = "byte") -> bytes:
    """One block of ids as a payload."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little")
    elif kind == "byte":
        planes = raw.T.copy()
    else:
        raise ValueError(f"plane kind {kind!r}: bit or byte")
    press = zstandard.ZstdCompressor(level=LEVEL)
    parts = [press.compress(p.tobytes()) if p.any() else b"" for p in planes]
    head = MAGIC + struct.pack("<B3xI", 0 if kind == "bit" else 1, len(ids)) + struct.pack(f"<{len(parts)}I", *map(len, parts))
    return head + b"".join(parts)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a bit-plane block")
    kind, n = struct.unpack_from("<B3xI", payload, 4)
    count, width = (32, (n + 7) // 8) if kind == 0 else (4, n)
    sizes = struct.unpack_from(f"<{count}I", payload, 12)
    press, at = zstandard.ZstdDecompressor(), 12 + 4 * count
    planes = np.zeros((count, width), dtype=np.uint8)
    for k, size in enumerate(sizes):
        if size:
            planes[k] = np.frombuffer(press.decompress(payload[at : at + size], max_output_size=width), dtype=np.uint8)
            at += size
    if kind == 0:
        bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
        raw = np.packbits(bits.T.copy(), axis=1, bitorder="little")
    else:
        raw = planes.T.copy()
    return raw.reshape(-1).view("<u4")


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_join(first: int, second: int, n_bytes: int) -> int:
    """The crc32 of two byte strings put together, from their own crc32s and
    the length of the second one (shifting by zero bytes is linear over GF(2))."""
    if not n_bytes:
        return first
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, x) for x in step]  # one zero byte
    while n_bytes:
        if n_bytes & 1:
            first = _times(step, first)
        n_bytes >>= 1
        step = [_times(step, x) for x in step]
    return first ^ second


# ------------------------------------------------------------ Spark operators


def write_ids(df: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, kind: str = "byte", block: int = BLOCK) -> None:
    """Encode every whole text and write the blocks below the path ``out``."""
    key = df.schema[id_col].dataType
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tie"))
    docs = docs.repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    part = T.StructType([T.StructField("doc_id", key), T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("parts", T.ArrayType(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard = encoder(tokenizer), TaskContext.get().partitionId()
        buf, fill, chunk, row, parts = np.empty(block, dtype="<u4"), 0, 0, 0, []
        done: list[dict] = []

        def close() -> int:
            nonlocal fill, chunk, parts
            payload = pack(buf[:fill], kind)
            done.append({"shard": shard, "chunk": chunk, "first": chunk * block, "n_ids": fill, "payload": payload, "parts": parts})
            fill, chunk, parts = 0, chunk + 1, []
            return len(payload)

        kinds, size = None, 0
        for batch in batches:
            inner = pa.struct([("doc_id", batch.schema.field(0).type), ("row", pa.int64()), ("part", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
            kinds = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("parts", pa.list_(inner))])
            keys, texts = batch.column(0), batch.column(1)
            last = np.int32(end_id)
            for i, found in enumerate(ids_of.many(texts)):
                ids = np.append(found, last)
                at, piece = 0, 0
                while at < len(ids):
                    n = min(block - fill, len(ids) - at)
                    buf[fill : fill + n] = ids[at : at + n]
                    parts.append({"doc_id": keys[i].as_py(), "row": row, "part": piece, "at": fill, "n": n})
                    fill, at, piece = fill + n, at + n, piece + 1
                    if fill == block:
                        size += close()
                row += 1
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(done, schema=kinds)
                    done, size = [], 0
        if fill:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    docs.mapInArrow(tidy(run), schema).write.mode("errorifexists").option("compression", "none").parquet(out)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each block: shard, document columns, places in the block, ids."""
    for k in range(batch.num_rows):
        doc, row, part, at, n = batch.column("parts")[k].values.flatten()
        starts = at.to_numpy()
        yield pa.repeat(batch.column("shard")[k], len(row)), row, doc, part, pa.array(starts.astype(np.int64) + batch.column("first")[k].as_py()), np.append(starts, starts[-1] + n[-1].as_py()), unpack(batch.column("payload")[k].as_py())


def _part_fields(blocks: DataFrame) -> list[T.StructField]:
    key = blocks.schema["parts"].dataType.elementType["doc_id"].dataType
    return [T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_id", key), T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType())]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids back, one row per document and block: shard, row, doc_id, part,
    first (place of the part in its shard's stream), ids array<int>."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *columns, cuts, ids in _parts(batch):
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["shard", "row", "doc_id", "part", "first", "ids"])

    return blocks.select("shard", "first", "payload", "parts").mapInArrow(tidy(run), T.StructType([*_part_fields(blocks), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read back what :func:`write_ids` wrote: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    fields = _part_fields(blocks)

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *columns, cuts, ids in _parts(batch):
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "row", "doc_id", "part", "first", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat, cuts = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            n, crc = (flat.field(c).to_numpy() for c in ("n", "crc"))
            totals = crc[cuts[:-1]].copy()
            for i in np.flatnonzero(np.diff(cuts) > 1):
                total = int(totals[i])
                for k in range(cuts[i] + 1, cuts[i + 1]):
                    total = crc32_join(total, int(crc[k]), 4 * int(n[k]))
                totals[i] = total
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "first", "n_tokens")), pa.array(totals, pa.int64())], names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"])

    of_part = blocks.select("shard", "first", "payload", "parts").mapInArrow(tidy(checks), T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())]))
    # a document's parts are as many as its blocks, so the list is bounded by its size
    parts = of_part.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), fields[2], T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    whole = parts.select("shard", "doc_id", "first", "n_tokens", "parts").mapInArrow(tidy(joined), schema)
    # one row per shard, so as many as the writing stage had partitions
    sizes = sorted((r["shard"], r["n"]) for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for shard, n in sizes:
        base.append((shard, at))
        at += n
    bases = spark.createDataFrame(base, "shard int, base long")
    return whole.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
