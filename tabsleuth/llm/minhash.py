"""Near-duplicate texts by a signature-coordinate inverted join.

1. The distinct five-word shingles of a text are hashed; texts with equal sets
   are one class. A class has ``COORDS`` minima (signature coordinates), that
   is ``COORDS`` coordinate-value pairs.
2. The classes of every coordinate-value pair are counted. Pairs of one class
   collide with nothing. The m others of a class are ordered from the rarest to
   the most frequent, and the class is posted under the first m - MATCHES + 1:
   two classes that agree on MATCHES coordinates or more share one of these, so
   no such two are missed, whatever the frequencies. Classes with m < MATCHES
   are not posted at all.
3. Posting lists are merged by the join on the pair. In a list the collisions of
   its classes are counted; the lists that the prefix left out, the longest, are
   skipped: whether two classes meet there is looked up in their signatures, and
   counting stops after ``PREFIX`` coordinates where ``MATCHES`` is out of reach.
   Classes with MATCHES collisions are candidates. Of each list only a spanning
   forest of its candidates is emitted.
4. Lists of more than two blocks of classes are split: every block meets the
   first one, and then, in lists whose classes are not all connected yet, every
   other one. The block is of fixed size, and lists are split by joining their
   sizes; what is broadcast are only the frequencies of pairs above a threshold
   that at most ``HOT_VALUES`` pairs can pass at any input size.
5. Classes that candidates connect form a cluster. The full shingle sets of a
   cluster's classes are compared with each other (intersections of all its
   pairs at once, as a product of incidence matrices), so every link inside it
   is known; what leaves the task is a spanning forest of these links. Large
   clusters are split into blocks like long lists, and blocks that are linked
   already are not compared again.
6. Components of the links give the result.

A link is missed only if two classes of similarity 0.75 or more agree on fewer
than MATCHES coordinates (once in ten thousand at 0.75 exactly).

Memory of a task: a slice of texts, one posting list of at most two blocks of
64-byte signatures, or two blocks of shingle sets. The classes of one
list whose own similarity lies between a half and the limit (a long passage that
very many texts share) are compared block by block, quadratic in their number.

Defined cases: a text without words (null, empty, white space) has no shingles
and is linked with nothing; one of fewer than five words has one shingle; rows
with equal ids are told apart by their texts, and each is returned; null ids
count as no id when the smallest id is taken (``kept`` is then false unless the
row has no shingles); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ._components import components
from ._text import FOLD, RollingHash, byte_column, mix, slices, tidy, words

SHINGLE = 5
COORDS = 64
#: collisions that make a candidate: at similarity .75, 48 are expected and
#: fewer than 34 come up less than once in ten thousand pairs
MATCHES = 34
STRONG = 48
#: coordinates counted before hopeless pairs are skipped
PREFIX = 48
#: pairs counted by a broadcast table: at most HOT_VALUES, of more than HOT_LEAST classes
HOT_LEAST, HOT_VALUES = 4096, 1 << 18
BLOCK = 1024
#: digests of texts that a task remembers, to send a repeated text once
SEEN = 1 << 16
#: shingles of a block of sets
SET_BLOCK = 1 << 20

_A = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a buffer, sorted within a text,
    and the bounds of each text's part."""
    n = len(offsets) - 1
    folded = FOLD[buf]
    start, end, row = words(folded, offsets)
    if not len(start):
        return np.empty(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    word = RollingHash(folded).spans(start, end)
    factor = np.uint64(0xD6E8FEB86659FD93)
    many = len(word) - size + 1
    if many > 0:
        whole = np.zeros(many, dtype=np.uint64)
        for k in range(size):
            whole = whole * factor + word[k : k + many]
        inside = row[: many] == row[size - 1 :]
        hashes, owner = mix(whole[inside] + np.uint64(size)), row[:many][inside]
    else:
        hashes, owner = np.empty(0, dtype=np.uint64), np.empty(0, dtype=row.dtype)
    count = np.bincount(row, minlength=n)
    first = np.searchsorted(row, np.arange(n))
    extra_h, extra_o = [], []
    for r in np.flatnonzero((count > 0) & (count < size)):
        h = np.zeros(1, dtype=np.uint64)
        for w in word[first[r] : first[r] + count[r]]:
            h = h * factor + w
        extra_h.append(mix(h + np.uint64(count[r]))[0])
        extra_o.append(r)
    if extra_h:
        hashes = np.concatenate((hashes, np.array(extra_h, dtype=np.uint64)))
        owner = np.concatenate((owner, np.array(extra_o, dtype=owner.dtype)))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, COORDS) uint32 minima; only for texts that have shingles."""
    own = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(bounds) - 1, COORDS), dtype=np.uint32)
    if len(own):
        for k in range(COORDS):
            out[own, k] = np.minimum.reduceat(((hashes * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), bounds[own])
    return out


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, class (16-byte digest of the set, null without shingles), n, the
    text's digest, the signature (32-bit minima)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("source_text", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(batch.column(1))
            for i, j in slices(offsets):
                part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, bounds = shingle_hashes(part, own)
                sig = signatures(hashes, bounds)
                n = np.diff(bounds)
                full = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        pa.array(n.astype(np.int64)),
                        pa.array([_digest(part[a:b].tobytes()) if f else None for a, b, f in zip(own[:-1], own[1:], full, strict=True)], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=schema.names,
                )

    return docs.mapInArrow(tidy(run), schema)


def _packed(docs: DataFrame) -> DataFrame:
    """Digest and compressed bytes of every text, of repeats in a task mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            buf, offsets = byte_column(batch.column(0))
            for i, j in slices(offsets):
                digests, packed = [], []
                for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True):
                    text = buf[a:b].tobytes()
                    digest = _digest(text)
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest)
                        packed.append(press.compress(text))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["source_text", "packed"])

    return docs.select("text").mapInArrow(tidy(run), "source_text binary, packed binary")


def _signature(column: pa.Array) -> np.ndarray:
    buf, offsets = byte_column(column)
    return buf[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, COORDS)


def _values(classes: DataFrame) -> DataFrame:
    """id, pair: the coordinate-value pairs of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(COORDS, dtype=np.int64) << 32
        for batch in batches:
            pairs = coordinate | _signature(batch.column("sig")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), COORDS)), pa.array(pairs.reshape(-1))], names=["id", "pair"])

    return classes.select("id", "sig").mapInArrow(tidy(run), "id long, pair long")


def _low(classes: DataFrame) -> DataFrame:
    """id, n, low: the low byte of each coordinate, enough to count collisions
    (two values that differ agree in it once in 256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _signature(batch.column("sig")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "n", "low"])

    return classes.select("id", "n", "sig").mapInArrow(tidy(run), "id long, n long, low binary")


def _collisions(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision counts of the pairs (a, b); pairs that cannot reach MATCHES
    after the prefix are skipped and get 0."""
    count = (low[a, :PREFIX] == low[b, :PREFIX]).sum(axis=1)
    going = np.flatnonzero(count >= MATCHES - (COORDS - PREFIX))
    out = np.zeros(len(a), dtype=np.int64)
    out[going] = count[going] + (low[a[going], PREFIX:] == low[b[going], PREFIX:]).sum(axis=1)
    return out


def _candidates(low: np.ndarray, size: np.ndarray, label: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``others``, those of another label that are candidates of ``i``."""
    others = others[label[others] != label[i]]
    small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
    others = others[100 * small >= 75 * large]
    count = _collisions(low, np.full(len(others), i), others)
    return others[count >= MATCHES], count[count >= MATCHES]


def _forest(low: np.ndarray, size: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the candidates that join different labels, strong
    candidates first."""
    m = len(size)
    label, everyone, out = label.copy(), np.arange(m), []
    for least in (STRONG, MATCHES):
        for i in range(m - 1):
            if (label == label[0]).all():
                return out
            near, count = _candidates(low, size, label, i, everyone[i + 1 :])
            for j in near[count >= least]:
                if label[j] != label[i]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[list]]:
    """The columns of each run of rows with equal keys, over batch borders."""
    last, group = None, [[] for _ in columns]
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        for key, *values in zip(names, *(batch.column(c).to_pylist() for c in columns), strict=True):
            if key != last:
                if group[0]:
                    yield group
                last, group = key, [[] for _ in columns]
            for g, v in zip(group, values, strict=True):
                g.append(v)
    if group[0]:
        yield group


def _once(group: list[list]) -> list[list]:
    """A group sorted by its first column, without repeats: a block may meet itself."""
    keep = [k for k in range(len(group[0])) if k == 0 or group[0][k] != group[0][k - 1]]
    return group if len(keep) == len(group[0]) else [[c[k] for k in keep] for c in group]


def _edges(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out = ([], [])
    for a, b in found:
        out[0].append(min(a, b))
        out[1].append(max(a, b))
        if len(out[0]) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
            out = ([], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with a whole list (pair, unit), and the bounds of their lists."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches(held + ([batch] if batch is not None else [])).combine_chunks() if held else None
        rows = rows.to_batches()[0] if rows is not None and rows.num_rows else batch
        if rows is None or not rows.num_rows:
            continue
        pair, unit = rows.column("pair").to_numpy(), rows.column("unit").to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero((pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])) + 1, [len(pair)]))
        if batch is not None:  # the last list may go on
            held, bounds = [rows.slice(int(bounds[-2]))], bounds[:-1]
        if len(bounds) > 1:
            yield rows, bounds


def _list_pairs(postings: DataFrame) -> DataFrame:
    """Candidates (a < b) that connect the classes of each posting list.
    ``postings`` has pair, unit, id, n, low, label."""
    rows = postings.select("pair", "unit", "id", "n", "low", "label").repartition("pair", "unit").sortWithinPartitions("pair", "unit", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for batch, bounds in _whole_lists(batches):
                ids, n, label = (batch.column(c).to_numpy() for c in ("id", "n", "label"))
                buf, offsets = byte_column(batch.column("low"))
                low = buf[offsets[0] : offsets[-1]].reshape(-1, COORDS)
                size = np.diff(bounds)
                two = bounds[:-1][size == 2]  # most lists: counted all at once
                two = two[(label[two] != label[two + 1]) & (100 * np.minimum(n[two], n[two + 1]) >= 75 * np.maximum(n[two], n[two + 1]))]
                for i in two[_collisions(low, two, two + 1) >= MATCHES]:
                    yield int(ids[i]), int(ids[i + 1])
                for k in np.flatnonzero(size > 2):
                    at = np.arange(bounds[k], bounds[k + 1])
                    at = at[np.concatenate(([True], ids[at[1:]] != ids[at[:-1]]))]  # a block may meet itself
                    for i, j in _forest(low[at], n[at], label[at]):
                        yield int(ids[at[i]]), int(ids[at[j]])

        yield from _edges(found())

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def linked_forest(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different labels. All
    intersections are counted; a shingle of one set only adds nothing to them."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = count[inverse] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    both = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    linked = 100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both)
    label, out = label.copy(), []
    for i in range(m):
        if (label == label[0]).all():
            break
        for j in np.flatnonzero(linked[i] & (label != label[i])):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _cluster_links(members: DataFrame) -> DataFrame:
    """Links (a < b) that connect the classes of each cluster as far as they are
    linked. ``members`` has cluster, unit, id, packed, label."""
    columns = ["id", "packed", "label"]
    rows = members.select("cluster", "unit", *columns).repartition("cluster", "unit").sortWithinPartitions("cluster", "unit", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def shingles(packed: bytes) -> np.ndarray:
            buf = np.frombuffer(press.decompress(packed), dtype=np.uint8)
            return shingle_hashes(buf, np.array([0, len(buf)]))[0]

        def found() -> Iterator[tuple[bytes, bytes]]:
            for group in _groups(batches, ["cluster", "unit"], columns):
                ids, packed, label = _once(group)
                if len(set(label)) > 1:
                    for i, j in linked_forest([shingles(p) for p in packed], np.array(label)):
                        yield ids[i], ids[j]

        yield from _edges(found())

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def _units_first() -> Column:
    """Units of a row of block ``block`` out of ``blocks``: each block with the first one."""
    blocks = F.col("blocks").cast("long")
    return F.explode(F.when(blocks == 1, F.array(F.lit(0).cast("long"))).when(F.col("block") == 0, F.sequence(F.lit(1).cast("long"), blocks - 1)).otherwise(F.array(F.col("block").cast("long"))))


def _units_rest() -> Column:
    """Units of a row: each pair of blocks, the first one excepted."""
    block, blocks = F.col("block").cast("long"), F.col("blocks").cast("long")
    others = F.when((blocks > 2) & (block > 0), F.array_remove(F.sequence(F.lit(1).cast("long"), blocks - 1), block)).otherwise(F.array().cast("array<long>"))
    return F.explode(F.transform(others, lambda o: F.least(o, block) * blocks + F.greatest(o, block)))


def _written(frame: DataFrame, name: str) -> DataFrame:
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _prefixes(classes: DataFrame) -> DataFrame:
    """id, n, low, prefix (structs of frequency f and pair, the rarest first) of
    the classes that can have a candidate."""
    values = _values(classes)
    counts = _written(values.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "frequencies")
    # at most HOT_VALUES pairs can be more frequent than this
    often = max(HOT_LEAST, -(-COORDS * classes.count() // HOT_VALUES))
    tagged = values.join(F.broadcast(counts.where(F.col("f") > often)), "pair", "left")
    rest = tagged.where("f is null").select("id", "pair").join(counts.where(F.col("f") <= often).hint("merge"), "pair")
    shared = tagged.where("f is not null").select("id", "pair", "f").unionByName(rest.select("id", "pair", "f"))
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "pair"))).alias("own"))  # COORDS a class at most
    own = own.where(F.size("own") >= MATCHES).select("id", F.slice("own", 1, F.size("own") - (MATCHES - 1)).alias("prefix"))
    return _written(_low(classes).join(own, "id"), "prefixes")


def candidate_links(classes: DataFrame) -> DataFrame:
    """Candidates (a < b) that connect every two classes with MATCHES collisions
    or more. ``classes`` has id, n (set size), sig (COORDS 32-bit minima)."""
    postings = _prefixes(classes).select("id", "n", "low", F.explode("prefix").alias("p")).select("id", "n", "low", "p.pair", "p.f")
    long = F.col("f") > 2 * BLOCK
    sizes = postings.where(long).groupBy("pair").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 2 * BLOCK)
    sizes = _written(sizes.select("pair", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "sizes")
    split = postings.where(long).join(sizes, "pair", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = postings.where(~long).withColumn("blocks", F.lit(1)).unionByName(split)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = _written(_list_pairs(spread.withColumn("unit", _units_first()).withColumn("label", F.col("id"))), "candidates")
    if sizes.isEmpty():
        return pairs
    known = spread.where("blocks > 2").join(components(pairs).select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = known.groupBy("pair").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("pair")
    more = _list_pairs(known.join(mixed, "pair", "left_semi").withColumn("unit", _units_rest()))
    return pairs.unionByName(_written(more, "candidates"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; further class and
    source_text (16-byte names of the row's set and of its text) and component
    (a number), all three null without shingles."""
    docs = _rows(df, id_col, text_col)
    rows = _written(_signature_rows(docs), "signatures")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("n", "source_text", "sig")))
    classes = _written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # ids are fixed by the written table

    cluster = components(candidate_links(classes))
    cluster = cluster.select(F.col("node").alias("id"), F.col("root").alias("cluster")).join(classes.select("id", "n", "source_text"), "id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SET_BLOCK)).cast("int").alias("blocks")
    cluster = _written(cluster.join(cluster.groupBy("cluster").agg(blocks), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "clusters")
    # the clusters grow with the corpus: joined by shuffle at any size, never broadcast
    held = _packed(docs).join(cluster.select("source_text").hint("merge"), "source_text", "left_semi").groupBy("source_text").agg(F.first("packed").alias("packed"))
    members = _written(cluster.join(held, "source_text").select("cluster", "blocks", "block", "id", "packed"), "members")
    links = _written(_cluster_links(members.withColumn("unit", _units_first()).withColumn("label", F.col("id"))), "links")
    label = components(links)
    large = members.where("blocks > 2").join(label.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = large.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("cluster")
    more = _written(_cluster_links(large.join(mixed, "cluster", "left_semi").withColumn("unit", _units_rest())), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    found = label.select(F.col("node").alias("id"), F.col("root").alias("component"))
    named = classes.select("id", "class", "least").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("class", "component", F.col("component_id"))
    return rows.select("doc_id", "class", "source_text", "n").join(named, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("class").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
        "class",
        "component",
        "source_text",
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (null ids
    last, then by the text's digest), and one of equal rows. Rows without
    shingles are linked with nothing and all stay."""
    decided = near_duplicates(df, id_col, text_col).where("class is not null")
    stays = decided.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source_text")).alias("s")).select(F.col("s.doc_id").alias("stay_id"), F.col("s.source_text").alias("stay_text"))
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("row_id", df.schema[id_col].dataType), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_column(batch.column(2))
            digests: list[bytes | None] = []
            for i, j in slices(offsets):
                part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                full = np.bincount(words(part, own)[2], minlength=j - i) > 0 if len(part) else np.zeros(j - i, dtype=bool)
                digests += [_digest(part[a:b].tobytes()) if f else None for a, b, f in zip(own[:-1], own[1:], full, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["row", "row_id", "digest"])

    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("row_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(tidy(run), schema)
    same = F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_text"))
    one = keyed.where("digest is not null").join(stays, same, "left_semi").groupBy("row_id", "digest").agg(F.first("row").alias("row"))
    return one.select("row").unionByName(keyed.where("digest is null").select("row")).select(*(F.col("row")[c].alias(c) for c in df.columns))
