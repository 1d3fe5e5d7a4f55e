"""Benchmark passages in training texts, found by spaced-seed hashing.

A seed is a mask over ``SPAN`` neighbouring tokens that ignores two of them.
The eight masks are chosen so that every segment that counts as evidence (below)
has a window whose substituted tokens one mask ignores, wherever they lie: no
item of ``SPAN`` tokens or more is missed. Hashes of benchmark and training windows
are joined; around each hit the two token sequences are laid over each other
without gaps, and of all segments in which four fifths of the tokens are equal
the one with the most equal tokens is taken (then the shortest, then the first).
A text is contaminated by an item if that segment has ``NEED`` matching tokens,
or four fifths of the item if it is shorter. Items of fewer than ``SPAN`` tokens
are hashed whole and must occur with every token; their first place in a text
is reported.

If the benchmark has at most ``SENT_TOKENS`` tokens (checked first), its seeds
and tokens are broadcast and each text is judged where it is read, without a
shuffle. A larger benchmark is joined by shuffles: seeds by hash, frequent ones
dealt over parts, then texts with hits by digest, each once and ahead of its
items, which are judged as they pass. Both give the same rows.

Tokens are runs of lower-cased letters, digits and bytes from 0x80 on, so case,
spacing and ASCII punctuation do not matter.

Defined cases: null and empty texts are never contaminated; items without a
token match nothing; repeated rows
and equal ids each keep their own result; repeated items with one id count
once, with different ids each; a null item id is kept as null; an empty table
on either side gives no hits. Other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ._text import byte_column, lower_column, mix, slices, tidy, token_hashes

SPAN = 8
#: The two positions that each mask ignores, and those that it looks at.
IGNORED = ((0, 1), (1, 2), (4, 5), (0, 2), (3, 5), (2, 5), (2, 6), (2, 7))
MASKS = tuple(tuple(k for k in range(SPAN) if k not in two) for two in IGNORED)
NEED = 13
SENT_TOKENS = 1 << 21
#: windows of a text seed that one part takes at least, and seeds that are dealt at most
HOT_LEAST, HOT_SEEDS = 1 << 14, 1 << 18
_FILTER_BITS = 24
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_matched", T.IntegerType()), T.StructField("n_aligned", T.IntegerType()), T.StructField("text_token", T.IntegerType()), T.StructField("item_token", T.IntegerType())])
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_matched", pa.int32()), ("n_aligned", pa.int32()), ("text_token", pa.int32()), ("item_token", pa.int32())]))


def seeds(tokens: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask: hashes of all windows within a row, and where they start."""
    n = len(tokens) - SPAN + 1
    if n <= 0:
        return
    inside = np.flatnonzero(row[:n] == row[SPAN - 1 :])
    for m, mask in enumerate(MASKS):
        h = np.full(n, m + 1, dtype=np.uint64)
        for k in mask:
            h = h * _FACTOR + tokens[k : k + n]
        yield mix(h[inside]), inside


def whole(tokens: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` tokens within a row, and where they start."""
    n = max(0, len(tokens) - length + 1)
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    h = np.full(n, len(MASKS) + length, dtype=np.uint64)
    for k in range(length):
        h = h * _FACTOR + tokens[k : k + n]
    return mix(h[inside]), inside


def aligned(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """Best segment of an item laid over a text at a shift: matches, length,
    start in the text and in the item. None if it is not evidence."""
    first, last = max(0, -shift), min(len(item), len(text) - shift)
    if last <= first:
        return None
    same = text[first + shift : last + shift] == item[first:last]
    equal = np.flatnonzero(same)
    if not len(equal):
        return None
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))  # not negative: four fifths are equal
    lows = np.minimum.accumulate(sums)
    start = np.searchsorted(-lows, -sums[equal + 1])  # the first one for a segment that ends with each match
    head = np.searchsorted(equal, start)
    matches, length = np.arange(1, len(equal) + 1) - head, equal + 1 - equal[head]
    best = np.lexsort((length, -matches))[0]
    matched, begin = int(matches[best]), int(equal[head[best]])
    if matched < (len(item) if len(item) < SPAN else min(NEED, -(-4 * len(item) // 5))):
        return None
    return matched, int(length[best]), first + begin + shift, first + begin


def judge(text: np.ndarray, found: dict[int | None, tuple[np.ndarray, set[int]]]) -> list[dict]:
    """The items that contaminate a text: ``found`` has, by item id, token
    sequences and the shifts that seeds hit."""
    out = []
    for item_id, (item, shifts) in found.items():
        best = max((x for s in sorted(shifts) if (x := aligned(text, item, s))), default=None, key=lambda x: (x[0], -x[2]))
        if best:
            out.append({"item_id": item_id, "n_matched": best[0], "n_aligned": best[1], "text_token": best[2], "item_token": best[3]})
    return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"] or 0))


class SeedTable:
    """Seeds and tokens of a bounded benchmark, for lookups in a worker."""

    def __init__(self, items: list[tuple[int | None, str]]):
        buf, offsets = byte_column(lower_column(pa.array([t for _, t in items], pa.string())))
        self.ids = [i for i, _ in items]
        tokens, row = token_hashes(buf, offsets)
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        self.tokens = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        parts = [(h, at) for h, at in seeds(tokens, row)]
        counts = np.diff(bounds)
        self.lengths = [n for n in range(1, SPAN) if n in counts]
        for n in self.lengths:
            h, at = whole(tokens, row, n)
            parts.append((h[counts[row[at]] == n], at[counts[row[at]] == n]))
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.empty(0, dtype=np.uint64)
        at = np.concatenate([a for _, a in parts]) if parts else np.empty(0, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, at = hashes[order], at[order]
        self.item = row[at] if len(at) else at
        self.place = at - bounds[self.item] if len(at) else at
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, tokens: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text row, token, item, place in the item) of every equal seed; of a
        short item the first in a row."""
        for h, at in seeds(tokens, row):
            near = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(self.hashes, h[near]), np.searchsorted(self.hashes, h[near], side="right")
            for k in np.flatnonzero(high > low):
                t = int(at[near[k]])
                for s in range(low[k], high[k]):
                    yield int(row[t]), t, int(self.item[s]), int(self.place[s])
        for n in self.lengths:
            h, at = whole(tokens, row, n)
            near = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(self.hashes, h[near]), np.searchsorted(self.hashes, h[near], side="right")
            hit = np.flatnonzero(high > low)
            for k in hit[np.unique(row[at[near[hit]]] * (len(self.hashes) + 1) + low[hit], return_index=True)[1]]:
                t = int(at[near[k]])
                for s in range(low[k], high[k]):
                    yield int(row[t]), t, int(self.item[s]), int(self.place[s])


def _benchmark(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).distinct()


def contamination(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", hits_col: str = "hits", sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """``df`` with ``hits_col``: the benchmark items that each text contains, as
    an array of ``HIT`` (empty for a clean text)."""
    if hits_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column {hits_col!r}: name another output column")
    bench = _benchmark(items, item_id_col, item_text_col)
    # a token has one byte and a separator at least
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    if size <= 2 * sent_tokens:
        return _judged_in_place(df, bench, text_col, hits_col)
    return _judged_by_joins(df, bench, text_col, hits_col)


def _judged_in_place(df: DataFrame, bench: DataFrame, text_col: str, hits_col: str) -> DataFrame:
    table = df.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in bench.collect()])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = SeedTable(table.value)
        for batch in batches:
            buf, offsets = byte_column(lower_column(batch.column(at)))
            hits: list[list[dict]] = []
            for i, j in slices(offsets):
                part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                tokens, row = token_hashes(part, own)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                found: list[dict] = [{} for _ in range(j - i)]
                for r, t, item, place in seed.hits(tokens, row):
                    found[r].setdefault(item, set()).add(t - int(bounds[r]) - place)
                for r, by_item in enumerate(found):
                    best: dict = {}
                    for item, shifts in by_item.items():  # one id may have several texts
                        for h in judge(tokens[bounds[r] : bounds[r + 1]], {seed.ids[item]: (seed.tokens[item], shifts)}):
                            if (x := best.get(h["item_id"])) is None or (h["n_matched"], -h["text_token"], -h["item_token"]) > (x["n_matched"], -x["text_token"], -x["item_token"]):
                                best[h["item_id"]] = h
                    hits.append(sorted(best.values(), key=lambda h: (h["item_id"] is None, h["item_id"] or 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, _HIT_ARROW)], schema=batch.schema.append(pa.field(hits_col, _HIT_ARROW)))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(hits_col, T.ArrayType(HIT))]))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short_lengths(bench: DataFrame) -> list[int]:
    """Token counts below ``SPAN`` that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row = token_hashes(*byte_column(lower_column(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.bincount(row)).astype(np.int32))], names=["n"])

    return sorted(r["n"] for r in bench.select("text").mapInArrow(tidy(run), "n int").where(f"n > 0 and n < {SPAN}").distinct().collect())


def _seed_rows(texts: DataFrame, lengths: list[int], items: bool) -> DataFrame:
    """key, seed, place of every window of the texts (key, text); for short
    items the whole ones, in texts the first of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(lower_column(batch.column(1)))
            for i, j in slices(offsets):
                tokens, row = token_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                parts = list(seeds(tokens, row))
                for n in lengths:
                    h, at = whole(tokens, row, n)
                    if items:
                        kept = np.flatnonzero(np.diff(bounds)[row[at]] == n)
                    else:
                        kept = np.lexsort((at, h, row[at]))
                        kept = kept[np.concatenate((np.ones(min(1, len(kept)), dtype=bool), (h[kept[1:]] != h[kept[:-1]]) | (row[at[kept[1:]]] != row[at[kept[:-1]]])))]
                    parts.append((h[kept], at[kept]))
                for h, at in parts:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[at])), pa.array(h.view(np.int64)), pa.array((at - bounds[row[at]]).astype(np.int32))], names=["key", "seed", "place"])

    return texts.mapInArrow(tidy(run), T.StructType([texts.schema.fields[0], T.StructField("seed", T.LongType()), T.StructField("place", T.IntegerType())]))


def _keyed(df: DataFrame, at: int, key_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(batch.column(at))
            keys = pa.array([_digest(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], schema=batch.schema.append(pa.field(key_col, pa.binary())))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(key_col, T.BinaryType())]))


def _on_seed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Windows of texts (key, seed, place) beside those of items (item, seed,
    item_place). The windows of a frequent seed are dealt over several parts, to
    each of which its windows in items go."""
    spark = texts.sparkSession
    path = scratch_path(spark, "seed-counts")
    texts.groupBy("seed").count().join(wanted.select("seed").distinct(), "seed").write.parquet(path)
    counts = spark.read.schema("seed long, count long").parquet(path)
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = max(HOT_LEAST, -(-total // HOT_SEEDS))  # at most HOT_SEEDS seeds have more
    parts = F.ceil(F.col("count") / often).cast("long").alias("parts")
    frequent = F.broadcast(counts.where(F.col("count") > often).select("seed", parts))
    dealt = F.coalesce(F.pmod(F.xxhash64("key", "place"), F.col("parts")), F.lit(0).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    left = texts.join(frequent, "seed", "left").withColumn("part", dealt).drop("parts")
    return left.join(wanted.join(frequent, "seed", "left").withColumn("part", every).drop("parts"), ["seed", "part"])


def _judged_by_joins(df: DataFrame, bench: DataFrame, text_col: str, hits_col: str) -> DataFrame:
    spark = df.sparkSession
    plain = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    texts = _keyed(df.select(plain), 0, "key").select("key", "text")
    # the id is a number or nothing, so the first blank ends it
    named = bench.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(" "), "text"))).alias("item"), "item_id", "text")
    lengths = _short_lengths(bench)
    wanted = _seed_rows(named.select("item", "text"), lengths, True).withColumnsRenamed({"place": "item_place"})
    path = scratch_path(spark, "seed-hits")
    on_seed = _on_seed(_seed_rows(texts, lengths, False), wanted)
    on_seed.groupBy("key", "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts")).write.parquet(path)
    found = spark.read.schema("key binary, item binary, shifts array<int>").parquet(path)
    once = texts.join(found.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    rows = once.select("key", F.lit(False).alias("is_item"), F.lit(None).cast("long").alias("item_id"), "text", F.lit(None).cast("array<int>").alias("shifts"))
    rows = rows.unionByName(found.join(named, "item").select("key", F.lit(True).alias("is_item"), "item_id", "text", "shifts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens = None, None  # a text comes ahead of its items
        for batch in batches:
            buf, offsets = byte_column(lower_column(batch.column("text")))
            keys, ids, hits = [], [], []
            for i, j in slices(offsets):
                part, row = token_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                some = batch.slice(i, j - i)
                for k, (own, is_item, item_id) in enumerate(zip(*(some.column(c).to_pylist() for c in ("key", "is_item", "item_id")), strict=True)):
                    one = part[bounds[k] : bounds[k + 1]]
                    if not is_item:
                        key, tokens = own, one.copy()
                    elif own == key and (hit := judge(tokens, {item_id: (one, set(some.column("shifts")[k].as_py()))})):
                        keys.append(own)
                        ids.append(item_id)
                        hits.append(hit[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(hits, _HIT_ARROW.value_type)], names=["key", "item_id", "hit"])

    judged = rows.repartition("key").sortWithinPartitions("key", "is_item").mapInArrow(tidy(run), T.StructType([T.StructField("key", T.BinaryType()), T.StructField("item_id", T.LongType()), T.StructField("hit", HIT)]))
    best = F.max_by("hit", F.struct(F.col("hit.n_matched"), -F.col("hit.text_token"), -F.col("hit.item_token"))).alias("hit")  # one id may have several texts
    ordered = F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), F.coalesce("item_id", F.lit(0)).alias("id"), "hit")))
    hits = judged.groupBy("key", "item_id").agg(best).groupBy("key").agg(F.transform(ordered, lambda x: x["hit"]).alias("hits"))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), plain)
    joined = _keyed(whole, 1, "key").select("row", "key").join(hits, "key", "left")
    return joined.select(*(F.col("row")[c].alias(c) for c in df.columns), F.coalesce("hits", F.array().cast(T.ArrayType(HIT))).alias(hits_col))


def contaminated_pairs(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """One row per text and item found in it: doc_id, item_id, n_matched,
    n_aligned, text_token, item_token."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = contamination(docs, items, sent_tokens=sent_tokens).where(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def remove_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text contains a benchmark item."""
    hits = "__hits"
    while hits in df.columns:
        hits += "_"
    return contamination(df, items, text_col, hits_col=hits).where(F.size(hits) == 0).drop(hits)
