"""Packing of documents into training sequences by power-of-two decomposition.

A document's ids (closed by an end id) are cut, in order, into pieces of the
longest sequence length while they last and then into one piece for each binary
digit of what is left, longest first. Pieces of one length form a bucket, and
every piece is a sequence of its own there: all sequences of a bucket have the
same power-of-two length, none is padded, and none crosses documents.

``pack_documents`` writes the sequences as Parquet, one folder per bucket
(``length=...``), ids as little-endian unsigned 32-bit integers, with their
number in their file part; ``read_pieces`` reads them back and numbers them
over the whole table: buckets by length, and inside a bucket by file part.
No row is shuffled: the numbers need only the counts per part and bucket, of
which there are at most (input partitions x 11), which are joined as a table.

Memory of a task: one document and the batch of pieces it hands on.

Defined cases: null and empty texts have the end id only; null ids are kept;
rows with equal ids are packed apart; an empty table gives no sequence. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._library_ids import encoder
from ._text import tidy

#: ids of the longest sequence
LONGEST = 1024
#: ids that a task holds before it hands a batch on
OUT_IDS = 1 << 20


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of n ids, in their order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if rest >> k & 1]


def pack_documents(df: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, longest: int = LONGEST) -> None:
    """Encode every whole text and write its sequences below the path ``out``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [("start", T.LongType()), ("doc_tokens", T.LongType()), ("part", T.IntegerType()), ("number", T.LongType()), ("ids", T.BinaryType()), ("length", T.IntegerType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        made = {1 << k: 0 for k in range(longest.bit_length())}

        def batch_of(keys, docs: list[int], totals: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
            cuts = [piece_lengths(n, longest) for n in totals]
            count = np.array([len(c) for c in cuts])
            length = np.array([n for c in cuts for n in c], dtype=np.int64)
            end = np.cumsum(length)
            total = np.array(totals, dtype=np.int64)
            start = end - length - np.repeat(np.cumsum(total) - total, count)
            number = np.empty(len(length), dtype=np.int64)
            for n in made:
                own = np.flatnonzero(length == n)
                number[own] = made[n] + np.arange(len(own))
                made[n] += len(own)
            flat = np.concatenate(ids).astype("<u4")
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((4 * np.append(0, end)).astype(np.int32)), pa.py_buffer(flat)])
            columns = [keys.take(pa.array(np.repeat(docs, count))), pa.array(start), pa.array(np.repeat(total, count)), pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(number), binary, pa.array(length.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(n for n, _ in fields)])

        last = np.int32(end_id)
        for batch in batches:
            keys = batch.column(0)
            rows, totals, ids, held = [], [], [], 0
            for i, found in enumerate(ids_of.many(batch.column(1))):
                ids.append(np.append(found, last))
                rows.append(i)
                totals.append(len(found) + 1)
                held += len(found) + 1
                if held >= OUT_IDS:
                    yield batch_of(keys, rows, totals, ids)
                    rows, totals, ids, held = [], [], [], 0
            if rows:
                yield batch_of(keys, rows, totals, ids)

    docs.mapInArrow(tidy(run), schema).write.mode("errorifexists").option("compression", "zstd").partitionBy("length").parquet(out)


def _stored(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", key), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("doc_tokens", T.LongType()), ("part", T.IntegerType()), ("number", T.LongType()), ("ids", T.BinaryType()), ("length", T.IntegerType())))])
    return spark.read.schema(schema).parquet(path)


def read_pieces(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    """The sequences that :func:`pack_documents` wrote: doc_id (of type
    ``key``), start, length, doc_tokens, sequence_id, offset (always 0: a
    sequence holds one piece), ids binary."""
    rows = _stored(spark, path, key)
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before, base = 0, []
    for r in sorted(counts.groupBy("length").agg(F.sum("n").alias("n")).collect(), reverse=True):  # at most one row per power of two
        base.append((r["length"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "length int, base long"))
    # as many rows as the writing stage had partitions, for each of the lengths
    first = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, "length").select("length", "part", (F.col("base") + F.col("inside")).alias("first"))
    return rows.join(F.broadcast(first), ["length", "part"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", (F.col("first") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def piece_digests(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of
    every stored piece; the checksum is made from the ids read back."""
    pieces = read_pieces(spark, path, key)
    fields = [f for f in pieces.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            if not pc.all(pc.equal(pc.multiply(batch.column("length"), 4), pc.binary_length(ids)), min_count=0).as_py():
                raise ValueError("a stored piece has not the length of its bucket")
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), crc], names=[*(f.name for f in fields), "ids_crc32"])

    digests = pieces.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("ids_crc32", T.LongType())]))
    return digests.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
