"""Token counts of a word-end byte-pair vocabulary, without emitting ids.

Each word is a linked list of symbols; a heap gives the adjacent pair of lowest
rank (leftmost on a tie) until none is left. The count of a word is its initial
symbols minus its merges. A text is put in NFC, lower-cased character by
character and cut into words, as the vocabulary file says; white space is
dropped. Special strings inside a text count as one token each.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
stay; a null id stays null. No other columns are read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cache import WordCache
from ._pretokens import WORD_PATTERN, byte_alphabet, load_vocabulary, special_splitter
from ._text import tidy


# Capitals that the library's tables lower and Python's do not yet.
NEWER_LOWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}
NEWER_CAPITALS = regex.compile("[\ua7cb\ua7dc]")


class TokenCounter:
    """Counts the tokens of texts under one word-end vocabulary file."""

    def __init__(self, path: str):
        spec = load_vocabulary(path)
        self.suffix = spec["suffix"]
        self.rank = {pair: r for r, pair in enumerate(spec["merges"])}
        self.known = spec["vocab"]
        self.shown = {b: ch for ch, b in byte_alphabet().items()}
        self.words = regex.compile(WORD_PATTERN)
        self.split = special_splitter(spec["special"])
        self.cache = WordCache(lambda words: list(map(self._count_word, words)))

    def _count_word(self, word: str) -> int:
        symbols: list[str | None] = [self.shown[b] for b in word.encode()]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.known]  # the model drops symbols that it does not know
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, merges = self.rank, 0
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            merges += 1
            symbols[i], symbols[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = left[i]
            if h >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return n - merges

    def _count_part(self, part: str) -> int:
        # the library lower-cases one character at a time: no final sigma
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        if NEWER_CAPITALS.search(part):
            part = part.translate(NEWER_LOWER)
        return sum(self.cache.many(self.words.findall(part)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or not self.split.search(text):
            return self._count_part(text)
        return sum(k % 2 or self._count_part(part) for k, part in enumerate(self.split.split(text)))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([c.count(texts[i].as_py()) for i in range(len(texts))], pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
