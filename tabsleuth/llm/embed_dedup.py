"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of 64 random-hyperplane bits. Vectors are
put in the lexicographic order of their keys (range partitions) and each one is
compared, in double precision, with the ``WINDOW`` ones on either side and with
its block; similar vectors share long key prefixes and so come close to each
other in some pass. The verified links of all passes are united into components.

How far that goes is measured, not assumed: each pass reports for each vector
how many leading bits a partner had to share to be compared with it for certain
(one more than the first vector beyond its reach, or beyond the partition,
shares). A pair right at the threshold agrees on that many bits with a known
probability, so each vector has a probability that all passes missed a partner
of it. It is settled, and left out of later passes, when that is below
1 - ``RECALL``; ``n_passes()`` only sets the length of the first round. Rounds go
on until all are settled. Where vectors lie so densely that further passes would
cost more than comparing all open vectors with each other, that is done instead
(``_all_links``, strips of bounded size), which is exact.

Windows alone would miss links inside groups larger than a window, so links are
then counted exactly within each component: small components in one task, large
ones in blocks. With the angle of each member to the component's mean direction
known, pairs of blocks whose angles add up to less than the threshold are all
linked and only counted; blocks too far apart are skipped; the others are
multiplied. Pairs are never emitted there, only counts.

Equal vectors are one class with a weight, so a large group of copies costs one
row. Vectors of different length never link.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; repeated rows and
equal ids count as vectors of their own; null ids are ignored where the smallest
id is taken; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ._components import components
from ._text import tidy

LEAST = 0.9
WINDOW = 128
RECALL = 0.99
BITS = 64
SEED = 20_240_229
#: members of a component that one task counts together, and of a block
GROUP, BLOCK = 2048, 1024
#: bytes of vectors that are sent to all tasks at a time, and comparisons at a time
STRIP, AT_ONCE = 8 << 20, 4 << 20
#: width in degrees of the rings that large components are cut into
RING = 0.5


def n_passes(n: int, window: int = WINDOW, least: float = LEAST, recall: float = RECALL) -> int:
    """First guess, for vectors spread evenly, of the passes after which a pair of similarity ``least`` among ``n`` vectors has
    shared a window with probability ``recall``: it must agree on about
    log2(n / window) leading bits, on each with probability 1 - angle / pi."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    once = (1.0 - math.acos(least) / math.pi) ** bits
    return 1 if once >= recall else math.ceil(math.log(1.0 - recall) / math.log(1.0 - once))


def _units(vectors: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(v if isinstance(v, bytes) else v.as_py() for v in vectors), dtype=kind).astype(np.float64).reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id, class (digest; null if the vector links with nothing), vector."""
    element = df.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast(T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())).alias("v"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("class", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("vector", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, data = [], [], []
            for v in batch.column(1):
                one = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype(kind)
                    if np.isfinite(x).all() and x.any():
                        one = (x + 0).tobytes()  # -0.0 and 0.0 are the same
                names.append(None if one is None else hashlib.blake2b(one, digest_size=16).digest())
                sizes.append(0 if one is None else len(one) // np.dtype(kind).itemsize)
                data.append(one)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema), kind


def _keys(classes: DataFrame, kind: str, turns: range) -> DataFrame:
    """The classes with the sort key of each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            key = np.zeros((len(turns), batch.num_rows), dtype=np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                unit = _units(batch.column("vector").take(pa.array(at)), kind)
                for k, turn in enumerate(turns):
                    if (turn, dim) not in planes:
                        planes[turn, dim] = np.random.default_rng([SEED, turn, int(dim)]).standard_normal((int(dim), BITS))
                    key[k, at] = np.packbits(unit @ planes[turn, dim] > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)
            for k, turn in enumerate(turns):
                more = [pa.array(np.full(batch.num_rows, turn, dtype=np.int32)), pa.array((key[k] ^ np.uint64(1 << 63)).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=batch.schema.append(pa.field("turn", pa.int32())).append(pa.field("key", pa.int64())))

    return classes.mapInArrow(tidy(run), T.StructType([*classes.schema.fields, T.StructField("turn", T.IntegerType()), T.StructField("key", T.LongType())]))


def _shared(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Leading bits that keys have in common with another one."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """(turn, size) and the rows of it in their order, ``BLOCK`` at a time."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        turn, size = batch.column("turn").to_numpy(), batch.column("size").to_numpy()
        cuts = (np.flatnonzero((turn[1:] != turn[:-1]) | (size[1:] != size[:-1])) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            group, part = (int(turn[i]), int(size[i])), pa.Table.from_batches([batch.slice(i, j - i)])
            if group != last and held is not None and held.num_rows:
                yield last, held
            held, last = part if group != last else pa.concat_tables([held, part]), group
            while held.num_rows >= BLOCK:
                yield last, held.slice(0, BLOCK)
                held = held.slice(BLOCK)
    if held is not None and held.num_rows:
        yield last, held


def _forest(close: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that span the components of a block."""
    unseen = np.ones(len(close), dtype=bool)
    for start in np.flatnonzero(close.sum(axis=1) > 1):
        if unseen[start]:
            unseen[start] = False
            stack = [start]
            while stack:
                x = stack.pop()
                new = np.flatnonzero(close[x] & unseen)
                unseen[new] = False
                stack.extend(new)
                for y in new:
                    yield x, y


_FOUND = "a binary, b binary, mark long, bits int"


def _window_links(classes: DataFrame, kind: str, turns: range, window: int, least: float) -> DataFrame:
    """Verified links (a, b) of some passes, within a task only those that join
    something; and for every vector (mark) and pass the leading bits that make
    sure that a partner was compared: 0 if all were, over ``BITS`` if unknown."""
    rows = _keys(classes.select("class", "size", "vector", "mark"), kind, turns).repartitionByRange("turn", "size", "key", "class").sortWithinPartitions("turn", "size", "key", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        def reach(mark: np.ndarray, key: np.ndarray, floor: np.ndarray, ceil: np.uint64 | None) -> pa.RecordBatch:
            bits = 1 + (floor if ceil is None else np.maximum(floor, _shared(key, ceil)))
            none = pa.nulls(len(mark), pa.binary())
            return pa.RecordBatch.from_arrays([none, none, pa.array(mark), pa.array(bits.astype(np.int32))], names=["a", "b", "mark", "bits"])

        last, before = None, None  # before: the key ahead of the tail, none at the start of all
        names: list[bytes] = []
        mark, key, floor, unit = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty((0, 0))
        wait = (mark, key, floor)  # compared with all in reach, but the next key is not known
        for group, block in _blocks(batches):
            own = block.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            if group == last:
                yield reach(*wait, own[0])
            else:
                if last is not None:
                    yield reach(*wait, None)
                    yield reach(mark, key, floor, None)
                before = own[0] if last is None else None  # more of the group may be in the partition before
                names, mark, key, floor, unit = [], mark[:0], key[:0], floor[:0], np.empty((0, group[1]))
                last = group
            names = names + block.column("class").to_pylist()
            mark = np.concatenate((mark, block.column("mark").to_numpy()))
            floor = np.concatenate((floor, np.full(len(own), -1) if before is None else _shared(own, before)))
            key = np.concatenate((key, own))
            unit = np.concatenate((unit, _units(block.column("vector").to_pylist(), kind)))
            found = ([], [])
            for x, y in _forest(unit @ unit.T >= least):
                a, b = root(names[x]), root(names[y])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found[0].append(names[x])
                    found[1].append(names[y])
            if found[0]:
                none = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32())], names=["a", "b", "mark", "bits"])
            cut = max(0, len(names) - window)
            if cut:
                before = key[cut - 1]
            wait = (mark[:cut], key[:cut], floor[:cut])
            names, mark, key, floor, unit = names[cut:], mark[cut:], key[cut:], floor[cut:], unit[cut:]
        if last is not None:  # more of the group may be in the partition after
            yield reach(*wait, key[-1] if len(key) else wait[1][-1])
            yield reach(mark, key, floor, key[-1] if len(key) else None)

    return rows.mapInArrow(tidy(run), _FOUND)


def _all_links(rows: DataFrame, kind: str, least: float) -> DataFrame:
    """Links that span the components of all rows, every pair compared."""
    spark = rows.sparkSession
    strips = -(-rows.agg(F.sum(F.col("size").cast("long") * 8)).first()[0] // STRIP)
    rows = rows.select("class", "size", "vector").withColumn("strip", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(strips)))

    def against(strip: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.col("strip") == strip).select("class", "size", "vector").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            side: dict[int, tuple[list[bytes], np.ndarray, np.ndarray]] = {}
            for dim in {r[1] for r in sent.value}:
                part = [r for r in sent.value if r[1] == dim]
                side[dim] = ([bytes(r[0]) for r in part], _units([bytes(r[2]) for r in part], kind), np.arange(len(part)))
            for batch in batches:
                sizes, found = batch.column("size").to_numpy(), ([], [])
                for dim in np.unique(sizes):
                    if dim not in side:
                        continue
                    names, unit, label = side[dim]  # label: a member that the links so far lead to
                    at = np.flatnonzero(sizes == dim)
                    step = max(1, AT_ONCE // len(names))
                    for i in range(0, len(at), step):
                        some = pa.array(at[i : i + step])
                        close = _units(batch.column("vector").take(some), kind) @ unit.T >= least
                        own = batch.column("class").take(some).to_pylist()
                        for k in np.flatnonzero(close.any(axis=1)):
                            ends = np.unique(label[close[k]])
                            for e in ends:
                                if names[e] != own[k]:
                                    found[0].append(own[k])
                                    found[1].append(names[e])
                            if len(ends) > 1:
                                label[np.isin(label, ends)] = ends[0]
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["a", "b"])

        return rows.where(F.col("strip") >= strip).mapInArrow(tidy(run), "a binary, b binary")

    links = None
    for strip in range(strips):
        path = scratch_path(spark, "links")
        against(strip).write.parquet(path)
        found = spark.read.schema("a binary, b binary").parquet(path)
        links = found if links is None else links.unionByName(found)
    return links


def _counts_in_groups(members: DataFrame, kind: str, least: float) -> DataFrame:
    """class, links of every member of the small components, weights counted."""
    rows = members.select("component", "class", "weight", "vector").repartition("component").sortWithinPartitions("component")

    def solve(names: list[bytes], weight: list[int], vectors: list[bytes]) -> pa.RecordBatch:
        unit, w = _units(vectors, kind), np.array(weight)
        links = (unit @ unit.T >= least) @ w - w  # a vector isn't its own partner here; copies are added later
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links.astype(np.int64))], names=["class", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, ([], [], [])
        for batch in batches:
            for c, *rest in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != last:
                    if group[0]:
                        yield solve(*group)
                    last, group = c, ([], [], [])
                for g, v in zip(group, rest, strict=True):
                    g.append(v)
        if group[0]:
            yield solve(*group)

    return rows.mapInArrow(tidy(run), "class binary, links long")


def _counts_in_blocks(members: DataFrame, kind: str, least: float) -> DataFrame:
    """The same for large components, by rings around the mean direction."""
    spark = members.sparkSession
    theta = math.degrees(math.acos(least))

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column("vector"), kind)
            offsets = np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.reshape(-1)))], names=["component", "unit"])

    units = members.select("component", "vector").mapInArrow(tidy(unit_rows), "component binary, unit array<double>")
    mean = units.select("component", F.posexplode("unit").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    mean = mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column("vector"), kind)
            mid = batch.column("mean").flatten().to_numpy().reshape(unit.shape)
            norm = np.linalg.norm(mid, axis=1)
            cos = np.where(norm > 0, (unit * mid).sum(axis=1) / np.where(norm > 0, norm, 1), 0.0)
            angle = np.degrees(np.arccos(np.clip(cos, -1, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "class", "weight", "vector")), pa.array((angle / RING).astype(np.int32))], names=["component", "class", "weight", "vector", "ring"])

    path = scratch_path(spark, "rings")
    members.join(mean, "component").select("component", "class", "weight", "vector", "mean").mapInArrow(tidy(angles), "component binary, class binary, weight long, vector binary, ring int").write.parquet(path)
    rings = spark.read.schema("component binary, class binary, weight long, vector binary, ring int").parquet(path)
    size = rings.groupBy("component", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    one, two = size.select("component", F.col("ring").alias("r"), F.col("n").alias("rn")), size.select("component", F.col("ring").alias("q"), F.col("n").alias("qn"), F.col("w").alias("qw"))
    pairs = one.join(two, "component")  # at most (180 / RING) ** 2 rows a component
    sure = (F.col("r") + F.col("q") + 2) * RING <= theta - 1e-6
    far = (F.greatest("r", "q") - F.least("r", "q") - 1) * RING > theta + 1e-6
    surely = pairs.where(sure).groupBy("component", "r").agg(F.sum("qw").alias("sure"))
    known = rings.join(surely.withColumnRenamed("r", "ring"), ["component", "ring"], "left").select("class", (F.coalesce("sure", F.lit(0)) - F.when(F.col("sure").isNotNull() & ((F.col("ring") * 2 + 2) * RING <= theta - 1e-6), F.col("weight")).otherwise(F.lit(0))).alias("links"))

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    open_pairs = pairs.where(~sure & ~far).select("component", "r", "q", blocks("rn").alias("rb"), blocks("qn").alias("qb"))
    unit = F.xxhash64("component", "r", "q", "i", "j")
    left = rings.withColumnRenamed("ring", "r").join(open_pairs, ["component", "r"]).withColumn("i", F.pmod(F.xxhash64("class"), F.col("rb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    right = rings.withColumnRenamed("ring", "q").join(open_pairs, ["component", "q"]).withColumn("j", F.pmod(F.xxhash64("class"), F.col("qb")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    sides = left.select("component", "r", "q", "i", "j", F.lit(0).alias("side"), "class", "weight", "vector").unionByName(right.select("component", "r", "q", "i", "j", F.lit(1).alias("side"), "class", "weight", "vector"))
    dealt = sides.withColumn("unit", unit).drop("component").repartition("unit").sortWithinPartitions("unit", "r", "q", "i", "j", "side")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: list[tuple]) -> pa.RecordBatch | None:
            a, b = [g for g in group if g[0] == 0], [g for g in group if g[0] == 1]
            if not a or not b:
                return None
            names = np.array([g[1] for g in a], dtype=object)
            close = _units([g[3] for g in a], kind) @ _units([g[3] for g in b], kind).T >= least
            links = close @ np.array([g[2] for g in b])
            own = {g[1]: k for k, g in enumerate(b)}
            for k, g in enumerate(a):
                if g[1] in own and close[k, own[g[1]]]:
                    links[k] -= g[2]
            return pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.binary()), pa.array(links.astype(np.int64))], names=["class", "links"])

        last, group = None, []
        for batch in batches:
            for u, r, q, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("unit", "r", "q", "i", "j", "side", "class", "weight", "vector")), strict=True):
                if (u, r, q, i, j) != last:
                    if (out := solve(group)) is not None:
                        yield out
                    last, group = (u, r, q, i, j), []
                group.append(tuple(rest))
        if (out := solve(group)) is not None:
            yield out

    return known.unionByName(dealt.mapInArrow(tidy(multiply), "class binary, links long")).groupBy("class").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession

    def written(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    vectors, kind = _vectors(df, id_col, vector_col)
    classes = written(vectors.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.min("size").alias("size"), F.min("vector").alias("vector")), "vectors")
    n = classes.count()
    links, gains = spark.createDataFrame([], "a binary, b binary"), None
    agree, enough = 1.0 - math.acos(least) / math.pi, math.log(1.0 - RECALL)
    missed = F.when(F.col("bits") > BITS, 0.0).otherwise(F.log1p(-F.least(F.pow(F.lit(agree), F.col("bits")), F.lit(1 - 1e-12))))
    rest, m, done, more = classes.withColumn("mark", F.xxhash64("class")).select("class", "size", "vector", "mark"), n, 0, n_passes(n, window, least)
    while m:
        per = min(more, max(1, n // m))  # no more rows at a time than in the first pass
        for turn in range(done, done + more, per):
            # each pass is written, so that its shuffle files can go before the next one
            found = written(_window_links(rest, kind, range(turn, min(turn + per, done + more)), window, least), "links")
            links = links.unionByName(found.where("a is not null").select("a", "b"))
            gain = found.where("a is null").select("mark", "bits")
            gains = gain if gains is None else gains.unionByName(gain)
        done += more
        still = gains.groupBy("mark").agg(F.sum(missed).alias("missed")).where(F.col("missed") > enough)
        needs = still.select(F.least(F.lit(enough) / F.least("missed", F.lit(-1e-9)) - 1, F.lit(1e6)) * done)
        m, mean, middle = needs.toDF("needs").agg(F.count(F.lit(1)), F.avg("needs"), F.percentile_approx("needs", 0.5)).first()
        if m:
            rest = written(rest.join(still.select("mark"), "mark", "left_semi").select("class", "size", "vector", "mark"), "open")
            if m <= 2 * mean * (BLOCK + window):  # a pass compares a row with so many, the other way with m / 2
                links = links.unionByName(_all_links(rest, kind, least))
                break
            more = max(1, math.ceil(min(middle, done)))
    label = components(links).select(F.col("node").alias("class"), F.col("root").alias("component"))
    members = written(classes.join(label, "class").select("component", "class", "weight", "least", "vector"), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component_id"))
    counts = _counts_in_groups(members.join(sizes.where(f"n <= {group}").select("component"), "component", "left_semi"), kind, least)
    large = sizes.where(f"n > {group}").select("component")
    if not large.isEmpty():
        counts = counts.unionByName(_counts_in_blocks(members.join(large, "component", "left_semi"), kind, least))
    named = members.select("component", "class").join(sizes.select("component", "component_id"), "component").join(counts, "class").select("class", "component_id", "links")
    per_class = classes.select("class", "weight", "least").join(named, "class", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = vectors.select("vec_id", "class").join(per_class, "class", "left")
    alone = F.col("class").isNull()
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )
