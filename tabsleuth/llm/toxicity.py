"""Toxicity scores by FTRL-proximal logistic regression.

Features of a text are the distinct hashed words, stems (the first bytes of
longer words, so that inflected and compound forms share them), word pairs and
skip-grams (two words with one between them). Training follows the gradient with a rate
of its own for each coordinate and an L1 penalty that keeps most weights at
exactly zero, so that the model is a short list of (bucket, weight), bounded by
the number of buckets and small enough to broadcast. Scoring looks every
feature of the whole text up in that list.

The model is fitted on at most ``SAMPLE`` labelled rows, taken by the order of
a hash of their id from the rows whose crc32(id as text) mod 5 is not 0; the
rest is held out. Only texts are inputs of a score. The sample is the one
bounded thing here: every row is scored, over its whole text.

Defined cases: null and empty texts have no features, their score is that of
the intercept; without labelled rows the score is 0; rows with null labels are
not learned from; a null id counts as an empty id text; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import byte_column, lower_column, mix, slices, tidy, token_spans

BUCKETS = 1 << 20
#: sizes of the stems in bytes
STEMS = (4, 5, 6, 7, 8)
SAMPLE = 8000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.7, 1.0, 6.0, 1.0


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, word stem, pair and skip-gram (repeats included)."""
    hasher, start, end, row = token_spans(buf, offsets)
    tokens = hasher.spans(start, end)
    out, rows = [tokens], [row]
    for size in STEMS:
        longer = np.flatnonzero(end - start > size)
        out.append(hasher.spans(start[longer], start[longer] + size) + np.uint64(size))
        rows.append(row[longer])
    for kind, gap in ((1, 1), (2, 2)):
        inside = row[:-gap] == row[gap:]
        joined = tokens[:-gap] * np.uint64(0x9FB21C651E98DF25 + 2 * kind) + tokens[gap:]
        out.append(mix(joined[inside]))
        rows.append(row[:-gap][inside])
    return (np.concatenate(out) >> np.uint64(44)).astype(np.int64), np.concatenate(rows)


def train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the intercept. Examples are
    (distinct buckets, label), visited in the given order."""
    if not examples:
        return np.empty(0, dtype=np.int64), np.empty(0), -np.inf
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0.0  # the intercept
    for _ in range(epochs):
        for buckets, label in examples:
            at = np.append(buckets, BUCKETS)
            w = _weights(z[at], n[at], l1[at])
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + error * error
            z[at] += error - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = _weights(z, n, l1)
    kept = np.flatnonzero(w[:BUCKETS])
    return kept, w[kept], float(w[BUCKETS])


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fold(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most ``sample`` rows outside the held-out fold."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(_fold(F.col("doc_id")) != 0).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "label").limit(sample)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # at most `sample` rows are sent; a repeated id may match several texts, so the bound holds again below
    rows = docs.join(F.broadcast(known), "doc_id").select("turn", "label", "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(lower_column(batch.column(2)))
            for i, j in slices(offsets):
                bucket, row = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                both = np.unique(row * BUCKETS + bucket)
                cuts = np.searchsorted(both // BUCKETS, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts), pa.array((both % BUCKETS).astype(np.int32)))], names=["turn", "label", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            examples += [(b.values.to_numpy(), y) for y, b in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
        bucket, weight, intercept = train(examples)
        yield pa.RecordBatch.from_arrays([pa.array([bucket.tolist()], pa.list_(pa.int64())), pa.array([weight.tolist()], pa.list_(pa.float64())), pa.array([intercept])], names=["bucket", "weight", "intercept"])

    bags = rows.mapInArrow(tidy(bag), "turn long, label int, buckets array<int>").orderBy("turn", "label", "buckets").limit(sample)
    model = bags.coalesce(1).mapInArrow(tidy(learn), "bucket array<long>, weight array<double>, intercept double").first()
    if model is None:
        return np.empty(0, dtype=np.int64), np.empty(0), -np.inf
    return np.array(model["bucket"], dtype=np.int64), np.array(model["weight"], dtype=np.float64), model["intercept"]


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` (0 to 1, higher: toxic likelier) of each whole text."""
    if score_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column {score_col!r}: name another output column")
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, weight, intercept = sent.value
        table = np.zeros(BUCKETS)
        table[bucket] = weight
        used = table != 0
        for batch in batches:
            buf, offsets = byte_column(lower_column(batch.column(at)))
            total = np.full(batch.num_rows, intercept)
            for i, j in slices(offsets):
                found, row = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = used[found]
                both = np.unique(row[hit] * BUCKETS + found[hit])
                total[i:j] += np.bincount(both // BUCKETS, weights=table[both % BUCKETS], minlength=j - i)
            with np.errstate(over="ignore"):
                value = 1.0 / (1.0 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], schema=batch.schema.append(pa.field(score_col, pa.float64())))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = score(docs, fit(docs, labels.withColumnRenamed(id_col, "doc_id")))
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose score is 0.5 or more."""
    name = "__score"
    while name in df.columns:
        name += "_"
    return score(df, fit(df, labels, id_col, text_col), text_col, name).where(F.col(name) < 0.5).drop(name)
