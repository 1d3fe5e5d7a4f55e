"""Removal of passages that occur more than once, by sorted suffixes.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else, in the same text or another one. All windows (strings of that length) are
judged on the input.

1. *Dealing.* Every window has an anchor, the smallest rolling hash among its
   ``GRAM``-byte strings (rightmost on a tie). It depends on the window's bytes
   alone, so equal windows have equal anchors at equal places. Consecutive
   windows with one anchor form a fragment. Anchors are counted with map-side
   combining; only fragments whose anchor occurs again go on.
2. *Collapsing.* Fragments travel by name (a 128-bit digest and their place);
   equal ones become one row with a count. All windows of a fragment that
   occurs twice are repeated. Only different fragments that share an anchor are
   fetched from one of the texts that hold them.
3. *Sorting.* The different fragments of an anchor are joined into one text and
   its suffixes sorted in two stages: only suffixes smaller than their
   successors are sorted directly; the others are induced by scanning the
   buckets of first bytes in order. Neighbours in the suffix array whose common
   prefix reaches ``length`` are repeated windows.
4. *Hot anchors.* If an anchor has more than ``GROUP`` different fragments (a
   passage in very many contexts), its fragments are cut by the window's place
   relative to the anchor, and dealt again by the bytes that all windows of
   such a cut share; the last cut is a single window, dealt by all its bytes.
   So no task ever holds an unbounded group, and no window is left out. Joins
   by anchor or fragment deal the rows of a frequent key over parts; what is
   broadcast for it are at most ``HOT_KEYS`` keys at any input size.
5. *Cutting.* The windows found go back to their texts, which are identified by
   a 128-bit digest; equal texts are worked on once.

Memory of a task: a slice of texts or the longest text, and groups of at most
``GROUP`` fragments of under 2 * length bytes.

Defined cases: null texts are read as empty and lose nothing; texts shorter
than ``length`` lose nothing and are never dropped; repeated rows of such a
length lose all their bytes; equal or null ids do not matter, rows are kept one
by one; an empty table gives an empty result; other columns are passed through
by :func:`remove_repeats` and not read by :func:`removal_digests`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ._text import RollingHash, byte_column, slices, tidy

LENGTH = 200
GRAM = 48
#: different fragments of one anchor that a task sorts together
GROUP = 1024
#: widths of the cuts of hot anchors, in window places
CUTS = (20, 1)
#: rows of one key that a join sends to one task, and keys that may have more
HOT_LEAST, HOT_KEYS = 4096, 1 << 18
#: bytes of fragments that are sorted at once
SORT_BYTES = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------- two-stage suffix sort


def _words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a big-endian number (zeros follow the end)."""
    out = np.zeros(len(text), dtype=np.uint64)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def _sort_directly(starts: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` bytes."""
    n = len(word)
    starts = starts[np.argsort(word[starts], kind="stable")]
    first = word[starts]
    tied = np.concatenate(([False], first[1:] == first[:-1])) if len(starts) else np.empty(0, bool)
    for d in range(8, depth, 8):
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        place = starts[at] + d
        key = np.where(place < n, word[np.minimum(place, n - 1)], np.uint64(0))
        odd = key != key[np.searchsorted(group, group)]
        mixed = np.flatnonzero(np.isin(group, group[odd]))  # the other groups stay as they are
        if len(mixed):
            order = np.lexsort((key[mixed], group[mixed]))
            own = at[mixed]
            starts[own] = starts[own][order]
            key[mixed] = key[mixed][order]
            tied[at[1:]] &= key[1:] == key[:-1]
    return starts


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a uint8 text, ordered by their first ``depth``
    bytes at least."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    # a suffix is smaller than its successor if the next change of byte goes up
    step = np.sign(np.diff(text.astype(np.int16))).astype(np.int8)
    change = np.flatnonzero(step)
    following = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, dtype=bool)
    has = following < len(change)
    smaller[has] = step[change[following[has]]] > 0
    word = _words8(text)
    direct = _sort_directly(np.flatnonzero(smaller), word, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Put the larger-than-successor suffixes before the scanned ones into
        their buckets, in scan order; returns those of the same bucket."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        same = before[first == byte]
        before, first = before[first != byte], first[first != byte]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece in np.split(before, cuts):
                induced[text[piece[0]]].append(piece)
        return same

    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.empty(0, dtype=np.int64)
        induced[byte] = []
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out)


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Marks the valid starts whose ``length`` bytes also follow another valid start."""
    order = two_stage_suffix_array(text, length)
    order = order[valid[order]]
    word = _words8(text)
    a, b = order[:-1], order[1:]
    for d in range(0, length - 7, 8):
        same = word[a + d] == word[b + d]
        a, b = a[same], b[same]
    if length % 8:
        d = max(length - 8, 0)
        rest = np.uint64(0) if length >= 8 else np.uint64(64 - 8 * length)
        same = (word[a + d] >> rest) == (word[b + d] >> rest)
        a, b = a[same], b[same]
    found = np.zeros(len(text), dtype=bool)
    found[a] = True
    found[b] = True
    return found


# --------------------------------------------------------------- the fragments


def _key(data: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def _name(data: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(data))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(values)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def fragments(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Fragments of all texts in a buffer: row, first window's start within the
    text, number of windows, the anchor's place after that start, its hash."""
    empty = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(buf) < length:
        return empty
    hashes = RollingHash(buf).grams(gram)
    place = _LOW - np.arange(len(hashes), dtype=np.uint64)  # the rightmost of equal hashes counts as smaller
    least = _sliding_min((hashes & ~_LOW) | place, length - gram + 1)
    anchor = (_LOW - (least & _LOW)).astype(np.int64)
    # windows must not cross texts
    valid = np.zeros(len(anchor) + 1, dtype=np.int32)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty
    row = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    return row[first], at - offsets[row[first]], count, anchor[at] - at, hashes[anchor[at]]


_ANCHORS = "anchor long, k1 long, k2 long, run long"
#: a fragment by name: its anchor and that anchor's place in it, the digest of
#: its bytes, its number of windows, and where it is
_NAMED = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("count", T.IntegerType()),
    T.StructField("copies", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())),
])
_NAMED_ARROW = [("anchor", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("place", pa.int32()), ("count", pa.int32()), ("copies", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("starts", pa.list_(pa.int32()))]
#: a fragment with its bytes, as one text holds it
_BODY = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("place", T.IntegerType()),
    T.StructField("copies", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("start", T.IntegerType()),
])


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, text digest, and the fragment's start, place and size in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(batch.column(0))
            for i, j in slices(offsets):
                part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, start, count, place, anchor = fragments(part, own, length, gram)
                if not len(row):
                    continue
                key = np.zeros((j - i, 2), dtype=np.int64)
                for r in np.unique(row):
                    key[r] = _key(part[own[r] : own[r + 1]].tobytes())
                packed = (start << 20) | (place << 10) | count
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(key[row, 0]), pa.array(key[row, 1]), pa.array(packed)], names=["anchor", "k1", "k2", "run"])

    return docs.mapInArrow(tidy(run), _ANCHORS)


def _packed_texts(docs: DataFrame, length: int) -> DataFrame:
    """Digest and compressed bytes of the texts that have a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, offsets = byte_column(batch.column(0))
            for i, j in slices(offsets):
                k1, k2, packed = [], [], []
                for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True):
                    if b - a >= length:
                        data = buf[a:b].tobytes()
                        one, two = _key(data)
                        k1.append(one)
                        k2.append(two)
                        packed.append(press.compress(data))
                if k1:
                    yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])

    return docs.mapInArrow(tidy(run), "k1 long, k2 long, packed binary")


def _open(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _fragment_rows(rows: DataFrame, length: int) -> DataFrame:
    """From (k1, k2, packed, copies, runs): the fragments by name (kind 1) and,
    once more, the text (kind 0)."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *_NAMED.fields, T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("kind", pa.int32()), *_NAMED_ARROW, ("packed", pa.binary())])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for rec in batch.slice(i, 256).to_pylist():
                    text = _open(rec["packed"])
                    found: dict[tuple, dict] = {}
                    for r in rec["runs"]:
                        start, place, count = r["run"] >> 20, (r["run"] >> 10) & 1023, r["run"] & 1023
                        name = _name(text[start : start + count - 1 + length])
                        if (x := found.get(name)) is None:
                            found[name] = {"kind": 1, "anchor": r["anchor"], "f1": name[0], "f2": name[1], "place": place, "count": count, "copies": rec["copies"], "k1": rec["k1"], "k2": rec["k2"], "starts": [start]}
                        else:
                            x["starts"].append(start)
                            x["copies"] += rec["copies"]
                    out += found.values()
                    out.append({"kind": 0, "k1": rec["k1"], "k2": rec["k2"], "copies": rec["copies"], "packed": rec["packed"]})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.mapInArrow(tidy(run), schema)


def _bodies(named: DataFrame, looked: DataFrame, length: int) -> DataFrame:
    """The bytes of named fragments, each from the text that holds it first."""
    wanted = named.select("k1", "k2", F.struct("anchor", "place", "copies", "count", F.element_at("starts", 1).alias("start")).alias("f")).groupBy("k1", "k2").agg(F.collect_list("f").alias("fragments"))
    rows = looked.join(wanted, ["k1", "k2"]).select("k1", "k2", "packed", "fragments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("anchor", pa.int64()), ("body", pa.binary()), ("place", pa.int32()), ("copies", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32())])
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for rec in batch.slice(i, 64).to_pylist():
                    text = _open(rec["packed"])
                    for f in rec["fragments"]:
                        out.append({"anchor": f["anchor"], "body": text[f["start"] : f["start"] + f["count"] - 1 + length], "place": f["place"], "copies": f["copies"], "k1": rec["k1"], "k2": rec["k2"], "start": f["start"]})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.mapInArrow(tidy(run), _BODY)


def _sorted_windows(groups: DataFrame, length: int) -> DataFrame:
    """Sort the suffixes of each anchor's fragments; the repeated windows of
    fragments that occur once, as (k1, k2, start, count)."""
    rows = groups.select("anchor", "body", "copies", "k1", "k2", "start").repartition("anchor").sortWithinPartitions("anchor")

    def solve(bodies: list[bytes], rest: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"\xff".join(bodies), dtype=np.uint8)
        sizes = np.array([len(b) for b in bodies])
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        valid = np.zeros(len(text), dtype=bool)
        for a, n in zip(begin, sizes, strict=True):
            valid[a : a + n - length + 1] = True
        found = repeated_starts(text, valid, length)
        cols: list[list[int]] = [[], [], [], []]
        for a, n, (copies, k1, k2, start) in zip(begin, sizes, rest, strict=True):
            if copies > 1:
                continue  # all its windows are known to be repeated
            own = np.concatenate(([False], found[a : a + n - length + 1], [False]))
            edge = np.flatnonzero(own[1:] != own[:-1])
            for x, y in zip(edge[::2], edge[1::2], strict=True):
                for c, v in zip(cols, (k1, k2, start + int(x), int(y - x)), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["k1", "k2", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, rest, size, last = [], [], 0, None
        for batch in batches:
            for anchor, body, *tail in zip(*(batch.column(c).to_pylist() for c in ("anchor", "body", "copies", "k1", "k2", "start")), strict=True):
                if anchor != last and size >= SORT_BYTES:
                    yield solve(bodies, rest)
                    bodies, rest, size = [], [], 0
                bodies.append(body)
                rest.append(tuple(tail))
                size, last = size + len(body), anchor
        if bodies:
            yield solve(bodies, rest)

    return rows.mapInArrow(tidy(run), "k1 long, k2 long, start int, count int")


def _cut(bodies: DataFrame, width: int, length: int) -> DataFrame:
    """Cut fragments into windows of neighbouring places, dealt by the bytes
    that all windows of the cut share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(_NAMED_ARROW)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for rec in batch.slice(i, 512).to_pylist():
                    body, place = rec["body"], rec["place"]
                    count = len(body) - length + 1
                    for cut in range((place - count + 1) // width, place // width + 1):
                        low, high = cut * width, cut * width + width - 1  # distances of the anchor from a window's start
                        first, last = max(0, place - high), min(count - 1, place - low)
                        key = _name(struct.pack("<qi", rec["anchor"], cut) + body[place - low : place - high + length])[0]
                        name = _name(body[first : last + length])
                        out.append({"anchor": key, "f1": name[0], "f2": name[1], "place": place - first, "count": last - first + 1, "copies": rec["copies"], "k1": rec["k1"], "k2": rec["k2"], "starts": [rec["start"] + first]})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return bodies.mapInArrow(tidy(run), _NAMED)


def _with_key_in(rows: DataFrame, wanted: DataFrame, on: list[str], deal: list[str]) -> DataFrame:
    """The rows whose key is in ``wanted`` (the key, ``count`` of its rows). The rows
    of a frequent key are dealt by the columns ``deal`` over several parts."""
    total = wanted.agg(F.sum("count")).first()[0] or 0
    often = max(HOT_LEAST, -(-total // HOT_KEYS))  # at most HOT_KEYS keys have more
    parts = F.ceil(F.col("count") / often).cast("long")
    frequent = F.broadcast(wanted.where(F.col("count") > often).select(*on, parts.alias("parts")))
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*deal), F.col("parts")))
    needed = wanted.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return rows.join(frequent, on, "left").withColumn("part", part).join(needed, [*on, "part"], "left_semi").drop("parts", "part")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """For a DataFrame with one string column ``text`` without nulls: the
    repeated windows (k1, k2, start, count) by text digest, and the texts that
    were looked into (k1, k2, packed)."""
    if not gram <= length <= 900:
        raise ValueError("gram <= length <= 900 is needed")
    spark = docs.sparkSession
    anchors = _anchor_rows(docs, length, gram)

    def stored(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    again = stored(anchors.groupBy("anchor").count().where("count > 1"), "anchors")
    runs = _with_key_in(anchors, again, ["anchor"], ["k1", "k2", "run"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "run")).alias("runs"))
    texts = _packed_texts(docs, length).groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
    path = scratch_path(spark, "fragments")
    _fragment_rows(texts.join(runs, ["k1", "k2"]).select("k1", "k2", "packed", "copies", "runs"), length).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    table = T.StructType([*_NAMED.fields, T.StructField("packed", T.BinaryType()), T.StructField("kind", T.IntegerType())])
    written = spark.read.schema(table).parquet(path)
    named, looked = written.where("kind = 1").select(*_NAMED.names), written.where("kind = 0").select("k1", "k2", "packed")

    found = []
    for width in (*CUTS, 0):
        rest = F.first(F.struct("place", "count", "k1", "k2", "starts")).alias("rest")
        different = stored(named.groupBy("anchor", "f1", "f2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), rest).select("anchor", "f1", "f2", "copies", "rows", "rest.*"), "different")
        often = different.where("copies > 1").select("anchor", "f1", "f2", F.col("rows").alias("count"))
        found.append(_with_key_in(named, often, ["anchor", "f1", "f2"], ["k1", "k2"]).select("k1", "k2", F.explode("starts").alias("start"), "count"))
        different = different.drop("rows")
        if not width:  # single windows: equal ones are one row by now
            break
        sizes = stored(different.groupBy("anchor").count().where("count > 1"), "sizes")
        total = sizes.agg(F.sum("count")).first()[0] or 0
        most = max(group, -(-total // HOT_KEYS))  # at most HOT_KEYS anchors have more fragments: these stay out of the shuffle by anchor
        heavy = F.broadcast(sizes.where(f"count > {most}").select("anchor"))
        light = different.join(heavy, "anchor", "left_anti")
        found.append(_sorted_windows(_bodies(light.join(sizes.where(f"count <= {group}").select("anchor"), "anchor", "left_semi"), looked, length), length))
        if sizes.where(f"count > {group}").isEmpty():
            break
        hot = different.join(heavy, "anchor", "left_semi")
        if most > group:
            hot = hot.unionByName(light.join(sizes.where(f"count > {group} and count <= {most}").select("anchor"), "anchor", "left_semi"))
        named = stored(_cut(_bodies(hot, looked, length), width, length), "cuts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, looked


def _spans(windows: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for start, count in sorted((w["start"], w["count"]) for w in windows):
        end = start + count - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut_texts(windows: DataFrame, looked: DataFrame, length: int, as_text: bool = False) -> DataFrame:
    """Per text digest that loses bytes: n_removed, spans, kept (bytes, or text
    without the characters of which only a part is left)."""
    per_text = windows.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "count")).alias("windows"))
    rows = looked.join(per_text, ["k1", "k2"]).select("k1", "k2", "packed", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                kept, removed, spans = [], [], []
                for packed, wins in zip(part.column("packed").to_pylist(), part.column("windows").to_pylist(), strict=True):
                    text, at, pieces = _open(packed), 0, []
                    own = _spans(wins, length)
                    for a, b in own:
                        pieces.append(text[at:a])
                        at = b
                    pieces.append(text[at:])
                    rest = b"".join(pieces)
                    kept.append(rest.decode("utf-8", errors="ignore") if as_text else rest)
                    removed.append(sum(b - a for a, b in own))
                    spans.append([{"start": a, "end": b} for a, b in own])
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=["k1", "k2", "n_removed", "spans", "kept"],
                )

    return rows.mapInArrow(tidy(run), "k1 long, k2 long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept " + ("string" if as_text else "binary"))


def _with_digest(df: DataFrame, at: int, names: tuple[str, str]) -> DataFrame:
    """``df`` with the digest of its text column in two long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(batch.column(at))
            keys = np.array([_key(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64).reshape(-1, 2)
            schema = batch.schema.append(pa.field(names[0], pa.int64())).append(pa.field(names[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], schema=schema)

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())]))


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    windows, looked = repeated_windows(_texts(df, text_col), length)
    cut = _cut_texts(windows, looked, length).select("k1", "k2", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = _with_digest(base, 1, ("k1", "k2")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"), "k1", "k2")
    return base.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with the repeated passages cut out of ``text_col``. A character of
    which only a part is covered goes as a whole. All rows and columns stay; a
    null text stays null."""
    windows, looked = repeated_windows(_texts(df, text_col), length)
    cut = _cut_texts(windows, looked, length, as_text=True).select("k1", "k2", "kept")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = _with_digest(df.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")), 1, ("k1", "k2")).drop("text")
    joined = keyed.join(cut, ["k1", "k2"], "left")
    return joined.select(*(F.coalesce(F.col("kept"), F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))
