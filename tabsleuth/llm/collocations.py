"""Phrase collocations from count streams in prefix and suffix order.

Texts are split at marks and line breaks into pieces and those into words.
Phrases are runs of words inside a piece, counted per language.

1. Counting goes by length. Words first; then pairs of words that are both
   frequent; then longer phrases all of whose pairs are frequent (a phrase is
   never more frequent than a part of it). Which words and pairs are frequent
   is told by a bit table of fixed size, so a task may count a phrase in vain
   but never misses one. Tasks count exactly, by text, before the shuffle.
2. The frequent phrases are one stream in prefix order (by their words) and one
   in suffix order (by their words from the last to the first), each cut into
   ranges of equal size and written. In prefix order the phrases that begin a
   phrase stand before it, so one sweep knows the count of every first part;
   the counts still open at the end of a range are carried into the next ones.
   The stream in suffix order gives the counts of all last parts alike.
3. The two streams are merge-joined: every candidate now has the counts of the
   left and right part of every cut. A phrase that occurs as often as the phrase
   with one word more, on either side, is dropped (a longer phrase that holds
   it and occurs as often exists only if one of these does).

Memory of a task: a slice of text (2 MB, or one longer text) with the arrays of
its words, and the bit tables (2 x 4 MB). Hot words and phrases cost one row a
task in the shuffle of counts, and ranges are cut by rows, not by first words.

Defined cases: null texts are empty; null languages are ``und``, also where
``lang`` is that text; equal rows count as often as they occur; a table without
frequent phrases gives no row. Scores and counts are exact (decimals of 38
digits). Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ._text import FOLD, RollingHash, byte_column, mix, slices, tidy

#: words of the longest phrase
LONGEST = 5
#: bytes of text that are looked at together
SLICE = 1_900_000
#: bits of a table of frequent words or pairs: 4 MB, whatever the input
TABLE_BITS = 1 << 25
#: ranges of a stream have this many phrases on average
RANGE_ROWS = 200_000
#: part lists of the report's ranking
SALTS = 256

# White space between words, and marks between pieces.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ------------------------------------------------------------- words of texts


class Words:
    """Words of a slice of texts: put together with one space between them, so
    that any run of words is one span of ``text``."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        buf, offsets = byte_column(texts)
        folded = FOLD[buf]
        cut = _BREAK[folded]
        part = ~(cut | _BLANK[folded])
        edge = np.zeros(len(buf) + 1, dtype=bool)  # a text ends here
        edge[offsets] = True
        first, last = part.copy(), part.copy()
        first[1:] &= ~part[:-1] | edge[1:-1]
        last[:-1] &= ~part[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offsets, start, side="right") - 1
        breaks = np.cumsum(cut, dtype=np.int32)
        piece = breaks[start] if len(start) else np.empty(0, np.int32)
        #: the next word lies in the same piece
        self.joined = np.zeros(len(start), dtype=bool)
        if len(start) > 1:
            self.joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[row]
        size = end - start
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.text = np.full(int(self.end[-1]) + 1 if len(size) else 0, 0x20, dtype=np.uint8)
        kept = np.zeros(len(self.text) + 1, dtype=np.int8)
        kept[self.start] += 1
        kept[self.end] -= 1
        self.text[np.cumsum(kept[:-1], dtype=np.int8).astype(bool)] = folded[part]

    @functools.cached_property
    def hasher(self) -> RollingHash:
        return RollingHash(self.text)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of language and phrase, for the bit tables."""
        seeds = np.array([_seed(v) for v in self.langs.to_pylist()], dtype=np.uint64)
        return mix(self.hasher.spans(self.start[at], self.end[at + n - 1]) ^ seeds[self.lang[at]])

    def counts(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """lang, phrase, n: the distinct phrases of n words that begin at ``at``."""
        begin, end = self.start[at], self.end[at + n - 1]
        size = end - begin
        ends = np.append(0, np.cumsum(size))
        if n == 1:
            data = np.delete(self.text, self.end) if len(at) == len(self.start) else None
        else:
            data = None
        if data is None:
            data = self.text[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        phrase = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        table = pa.table({"lang": pa.array(self.lang[at]), "phrase": phrase}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
        return pa.RecordBatch.from_arrays([self.langs.take(table.column("lang").combine_chunks()), table.column("phrase").combine_chunks().cast(pa.string()), table.column("count_all").combine_chunks()], names=["lang", "phrase", "n"])


def _seed(lang: str) -> int:
    data = np.frombuffer(lang.encode(), dtype=np.uint8)
    return int(RollingHash(data).spans(np.array([0]), np.array([len(data)]))[0])


def phrase_keys(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The keys of whole phrases, equal to :meth:`Words.keys`."""
    buf, offsets = byte_column(phrases)
    coded = langs.dictionary_encode()
    seeds = np.array([_seed(v) for v in coded.dictionary.to_pylist()], dtype=np.uint64)
    return mix(RollingHash(buf).spans(offsets[:-1], offsets[1:]) ^ seeds[coded.indices.to_numpy(zero_copy_only=False)]) if len(phrases) else np.empty(0, np.uint64)


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit table holds the keys (perhaps more, never fewer)."""
    bit = (keys % np.uint64(len(table) * 8)).astype(np.int64)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


# ------------------------------------------------------------------- counting


def _counted(docs: DataFrame, pick) -> DataFrame:
    """Counts of the phrases that ``pick(words)`` names as (places, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(1), batch.column(0)
            _, offsets = byte_column(texts)
            for i, j in slices(offsets, SLICE):
                words = Words(texts.slice(i, j - i), langs.slice(i, j - i))
                for at, n in pick(words):
                    if len(at):
                        yield words.counts(at, n)

    return docs.mapInArrow(tidy(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bit_table(phrases: DataFrame) -> np.ndarray:
    """Bit table of some phrases. The driver gets its bytes, at most 4 MB."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = (phrase_keys(batch.column(0), batch.column(1)) % np.uint64(TABLE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = phrases.select("lang", "phrase").mapInArrow(tidy(keys), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    table = np.zeros(TABLE_BITS // 64, dtype="<i8")
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def frequent_phrases(df: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 5 words with at least ``least`` occurrences (lang,
    phrase, n), and the number of all words of each language (lang, n)."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def written(counts: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"phrases-{name}")
        counts.write.parquet(path)
        return spark.read.parquet(path)

    # one table, since rare words are needed for the number of words only
    words = _counted(docs, lambda w: [(np.arange(len(w.start)), 1)])
    rare = F.col("n") < least
    words = written(words.groupBy("lang", F.when(~rare, F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("phrase").isNotNull())
    held = spark.sparkContext.broadcast(_bit_table(words))

    def both(w: Words) -> np.ndarray:
        """Places of pairs of two words that may be frequent."""
        word = _marked(held.value, w.keys(np.arange(len(w.start)), 1)) if len(w.start) else np.empty(0, bool)
        return np.flatnonzero(w.joined[:-1] & word[:-1] & word[1:]) if len(word) > 1 else np.empty(0, np.int64)

    pairs = written(_counted(docs, lambda w: [(both(w), 2)]).where(~rare), "pairs")
    held_pairs = spark.sparkContext.broadcast(_bit_table(pairs))

    def longer(w: Words) -> list[tuple[np.ndarray, int]]:
        at = both(w)
        good = np.zeros(len(w.start) + LONGEST, dtype=bool)
        if len(at):
            good[at[_marked(held_pairs.value, w.keys(at, 2))]] = True
        run, out = good, []
        for n in range(3, LONGEST + 1):
            run = run[:-1] & good[n - 2 :]
            out.append((np.flatnonzero(run), n))
        return out

    more = written(_counted(docs, longer).where(~rare), "longer")
    return functools.reduce(DataFrame.unionByName, [words, pairs, more]), totals


# -------------------------------------------------------------------- streams


def swept(phrases: DataFrame, key: str, name: str) -> DataFrame:
    """The stream in the order of the word list ``key``, with ``parts``: the
    counts of the stream's phrases that begin the list, by their length.

    The stream is cut into ranges by its own order and written with the number
    of its range. Inside a range the counts come from one ordered sweep; where
    the beginning of a list lies in an earlier range, its count is the last one
    of that length before the range, carried over by a table of one row a range.
    """
    spark = phrases.sparkSession
    ranges = max(1, -(-phrases.count() // RANGE_ROWS))
    path = scratch_path(spark, f"phrases-{name}")
    phrases.repartitionByRange(ranges, "lang", key).withColumn("range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("len", F.size(key))
    kept = range(1, LONGEST)
    # at most 4 rows a range: the last phrase of every length
    tails = rows.where(F.col("len") < LONGEST).groupBy("range", "len").agg(F.max_by("n", F.struct("lang", key)).alias("n"))
    tails = tails.groupBy("range").agg(*(F.max(F.when(F.col("len") == k, F.col("n"))).alias(f"tail{k}") for k in kept))
    every = rows.select("range").distinct().join(tails, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a table of one row a range
    carry = every.select("range", *(F.last(f"tail{k}", ignorenulls=True).over(earlier).alias(f"carry{k}") for k in kept))
    before = Window.partitionBy("range").orderBy("lang", key).rowsBetween(Window.unboundedPreceding, -1)
    own = {k: F.last(F.when(F.col("len") == k, F.col("n")), ignorenulls=True).over(before) for k in kept}
    rows = rows.select("*", *(own[k].alias(f"own{k}") for k in kept)).join(carry, "range")
    counts = [F.when(F.col("len") > k, F.coalesce(f"own{k}", f"carry{k}")) for k in kept]
    return rows.withColumn("parts", F.filter(F.array(*counts), lambda c: c.isNotNull())).drop("range", *(f"own{k}" for k in kept), *(f"carry{k}" for k in kept))


def collocations(df: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language by the lowest score of their cuts,
    floor(1000 * a * n / (l * r)): lang, rank, phrase, a, l, r, n, score."""
    spark = df.sparkSession
    phrases, totals = frequent_phrases(df, least, lang_col, text_col)
    words = phrases.withColumn("words", F.split("phrase", " ", -1))
    forth = swept(words, "words", "prefix-order")
    back = swept(words.select("lang", F.reverse("words").alias("words"), "n"), "words", "suffix-order")
    path = scratch_path(spark, "phrases-swept")
    forth.select("lang", "words", "n", "len", F.lit(True).alias("forth"), "parts").unionByName(back.select("lang", "words", "n", "len", F.lit(False).alias("forth"), "parts")).where(F.col("len") > 1).write.parquet(path)
    both = spark.read.parquet(path)
    forth = both.where("forth").drop("forth")
    back = both.where("NOT forth").select("lang", F.reverse("words").alias("words"), F.col("parts").alias("ends"))
    as_often = F.col("n") == F.element_at("parts", -1)
    # a part as frequent as the phrase with one word more is no candidate
    shorter = both.where((F.col("len") > 2) & as_often).select("lang", F.slice("words", 1, F.col("len") - 1).alias("words"), "forth")
    shorter = shorter.select("lang", F.when(F.col("forth"), F.col("words")).otherwise(F.reverse("words")).alias("words"))
    merged = forth.hint("merge").join(back.hint("merge"), ["lang", "words"])
    left = merged.hint("merge").join(shorter.hint("merge"), ["lang", "words"], "left_anti")
    scored = left.withColumnRenamed("n", "a").join(totals, "lang")
    best = F.expr("""array_min(transform(sequence(1, len - 1), k -> named_struct(
        'score', (cast(1000 AS decimal(38, 0)) * a * n) div (cast(parts[k - 1] AS decimal(38, 0)) * ends[len - k - 1]),
        'k', k, 'l', parts[k - 1], 'r', ends[len - k - 1])))""")
    best = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", best.alias("b")).select("lang", "phrase", "a", "n", "b.score", "b.l", "b.r")
    # part lists first, so that no task ranks more than top x SALTS rows of a language at the end
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
