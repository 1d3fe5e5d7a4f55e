"""Hard-negative mining with bounds along spanning trees of the anchors.

Scores are integer inner products of vectors whose components are
floor(scale * x). An anchor's positives are its best other rows of the same
label; its negatives of a positive are the best rows of other labels whose
score lies in a window below the positive's.

1. Anchors are dealt by a hash of their id into slabs of about ``SLAB``. Inside
   a slab the anchors of one label are joined by a minimum spanning tree, and
   each one carries its parent and the length of the edge to it.
2. All rows are dealt by a hash of their id into chunks of about ``CHUNK``; a
   task takes one chunk and one slab. A tree's root is scored against all rows
   of the chunk that concern its label. A child's score of a row x lies within
   the parent's, plus or minus edge length times |x| (Cauchy-Schwarz), so the
   parent's bounds give the child's. Only rows whose bounds overlap what is
   asked for are scored again: for positives those that can reach the fifth
   best lower bound, for negatives those that overlap a window and can reach
   the third best lower bound inside it.
3. A task hands on its best rows an anchor, and a second level merges them.
   Positives come first, since their scores make the windows of the negatives.

Every row is compared with every anchor, by its bounds at least: the work is
anchors x rows, in blocks of bounded size. A row is copied once per slab and an
anchor once per chunk. Memory of a task: a chunk, a slab, and the bounds of at
most log2(SLAB) anchors (children with smaller subtrees go first).

Scores are exact: products that might leave the 53 bits of a double are made
with Python integers; a score beyond 64 bits is an error.

Defined cases: rows with a null id, a null label, a null vector or a null or
non-finite component take no part. Of several rows with one id the one with
the smallest (label, vector) counts, so repeated rows are one row. Shorter
vectors count as padded with zeros. Fewer rows than asked for are all taken;
anchors without a positive, and positives without a negative, give no row; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: anchors that a task handles at once, and rows that it compares them with
SLAB, CHUNK = 4096, 8192
#: slack of bounds, as a share and absolutely, far above the rounding of doubles
SLACK, LEAST = 1e-9, 1e-3


def quantized(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of the components, one row a vector, as doubles."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * flat)
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    return max([1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns if len(c))])


class Rows:
    """The vectors of a chunk: exact scores and norms."""

    def __init__(self, vectors: np.ndarray, largest: float):
        self.vectors, self.norm = vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        most = float(np.abs(vectors).max(initial=0.0))
        self.exact = most * largest * vectors.shape[1] < 2.0**53  # also of the sums on the way

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products of the rows ``at``."""
        if self.exact:
            return (self.vectors[at] @ anchor).astype(np.int64)
        whole = [int(v) for v in anchor]
        return np.array([sum(int(x) * y for x, y in zip(r, whole, strict=True)) for r in self.vectors[at]], dtype=np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree (Prim) from the vector nearest to the mean: a
    preorder in which smaller subtrees come first, the parent of each vector
    (-1: root) and the length of the edge to it."""
    n = len(vectors)
    square = np.einsum("ij,ij->i", vectors, vectors)
    middle = vectors.mean(axis=0)
    root = int(np.argmin(square - 2 * (vectors @ middle)))
    parent, near, left = np.full(n, -1), np.full(n, np.inf), np.ones(n, dtype=bool)
    taken, now = [root], root
    left[root] = False
    for _ in range(n - 1):
        d = square + square[now] - 2 * (vectors @ vectors[now])
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
        left[now] = False
        taken.append(now)
    below = np.ones(n, dtype=np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in reversed(taken[1:]):
        below[parent[v]] += below[v]
        children[parent[v]].append(v)
    order, stack = [], [root]
    while stack:
        v = stack.pop()
        order.append(v)
        stack += sorted(children[v], key=lambda c: -below[c])  # the smallest is popped first
    edge = np.zeros(n)
    held = parent >= 0
    edge[held] = np.linalg.norm(vectors[held] - vectors[parent[held]], axis=1)
    return np.array(order), parent, edge


class Bounds:
    """Scores of one tree's anchors against some rows of a chunk, walked from
    parents to children."""

    def __init__(self, rows: Rows, at: np.ndarray):
        self.rows, self.at, self.norm = rows, at, rows.norm[at]
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.rescored = 0

    def enter(self, k: int, parent: int, edge: float, own: float, last: bool) -> None:
        """Bounds of anchor ``k`` from its parent's; ``last``: the parent has
        no more children."""
        if parent < 0:
            self.low[k], self.high[k] = -own * self.norm * (1 + SLACK) - LEAST, own * self.norm * (1 + SLACK) + LEAST
            return
        reach = edge * self.norm * (1 + SLACK) + LEAST
        self.low[k], self.high[k] = self.low[parent] - reach, self.high[parent] + reach
        np.minimum(self.high[k], own * self.norm * (1 + SLACK) + LEAST, out=self.high[k])
        np.maximum(self.low[k], -own * self.norm * (1 + SLACK) - LEAST, out=self.low[k])
        if last:
            del self.low[parent], self.high[parent]

    def rescore(self, k: int, anchor: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the rows ``wanted`` (places among the rows)."""
        scores = self.rows.scores(anchor, self.at[wanted])
        self.low[k][wanted] = self.high[k][wanted] = scores
        self.rescored += len(wanted)
        return scores

    def leave(self, k: int) -> None:
        self.low.pop(k, None), self.high.pop(k, None)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value (-inf: there are fewer)."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _trees(anchors: pa.Table):
    """Runs of the anchors of one tree, in preorder, with the last child of
    every parent marked."""
    order = pc.sort_indices(anchors, sort_keys=[("tree", "ascending"), ("at", "ascending")])
    anchors = anchors.take(order)
    trees = anchors.column("tree").combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), len(trees)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        run = anchors.slice(a, b - a)
        parent = run.column("parent").to_numpy()
        final = {int(p): k for k, p in enumerate(parent)}  # the last one wins
        yield run, parent, {k for p, k in final.items() if p >= 0}, set(final)


def _walk(chunk: pa.Table, slab: pa.Table, scale: float, same_label: bool, wanted, chosen) -> pa.Table:
    """Walk all trees of a slab over a chunk. ``wanted(bounds, k, own, row)``
    gives the rows to score again, ``chosen(ids, scores, row)`` the result of an anchor."""
    width = width_of(chunk.column("vector"), slab.column("vector"))
    x = quantized(chunk.column("vector"), scale, width)
    ids, labels = chunk.column("id").combine_chunks(), chunk.column("label").combine_chunks()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    largest = float(np.abs(quantized(slab.column("vector"), scale, width)).max(initial=0.0))
    rows = Rows(x, largest)
    out: list[pa.Table] = []
    for run, parent, last, parents in _trees(slab):
        label = run.column("label")[0]
        same = pc.equal(labels, label).to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(same if same_label else ~same)
        if not len(at):
            continue
        bounds, vectors = Bounds(rows, at), quantized(run.column("vector"), scale, width)
        own, edge = np.linalg.norm(vectors, axis=1), run.column("edge").to_numpy()
        local_ids, local_rank = ids.take(pa.array(at)), rank[at]
        for k in range(run.num_rows):
            bounds.enter(k, int(parent[k]), float(edge[k]), float(own[k]), k in last)
            me = pc.index(local_ids, run.column("id")[k]).as_py() if same_label else -1
            row = {c: run.column(c)[k] for c in run.column_names if c not in ("vector", "label")}
            need = np.arange(len(at)) if parent[k] < 0 else wanted(bounds, k, me, row)
            if len(need):
                scores = bounds.rescore(k, vectors[k], need)
                others = need != me
                out.append(chosen(local_ids, need[others], scores[others], local_rank, row))
            if k not in parents:
                bounds.leave(k)
    return pa.concat_tables([t for t in out if t is not None]) if out else None


def _best(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by smaller id."""
    if len(scores) > 8 * k:
        some = np.flatnonzero(scores >= _kth(scores, k))
        return some[np.lexsort((rank[some], -scores[some]))[:k]]
    return np.lexsort((rank, -scores))[:k]


def positives_of(chunk: pa.Table, slab: pa.Table, scale: float, k: int, schema: pa.Schema) -> pa.Table:
    """The k best other rows of each anchor's label in a chunk."""

    def wanted(bounds: Bounds, n: int, me: int, row: dict) -> np.ndarray:
        low, high = bounds.low[n], bounds.high[n]
        if me >= 0:
            low, high = np.delete(low, me), np.delete(high, me)
        need = np.flatnonzero(high >= _kth(low, k))
        return need + (need >= me) if me >= 0 else need

    def chosen(ids, need, scores, rank, row):
        best = _best(scores, rank[need], k)
        return pa.table([pa.repeat(row["id"], len(best)), ids.take(pa.array(need[best])), pa.array(scores[best], pa.int64())], schema=schema)

    return _walk(chunk, slab, scale, True, wanted, chosen) or schema.empty_table()


def negatives_of(chunk: pa.Table, slab: pa.Table, scale: float, k: int, low_pct: int, high_pct: int, schema: pa.Schema) -> pa.Table:
    """The k best rows of other labels in each window of each anchor, in a chunk."""

    def windows(row: dict) -> list[tuple[int, int, int]]:
        """(place of the positive, least and greatest score)"""
        found = [(j, -(-low_pct * p // 100), high_pct * p // 100) for j, p in enumerate(row["positive_scores"].as_py())]
        return [w for w in found if w[1] <= w[2]]

    def wanted(bounds: Bounds, n: int, me: int, row: dict) -> np.ndarray:
        low, high = bounds.low[n], bounds.high[n]
        need = np.zeros(len(low), dtype=bool)
        for _, least, most in windows(row):
            inside = low[(low >= least) & (high <= most)]
            need |= (high >= max(least, _kth(inside, k))) & (low <= most)
        return np.flatnonzero(need)

    def chosen(ids, need, scores, rank, row):
        places, rows, found = [], [], []
        for j, least, most in windows(row):
            fits = np.flatnonzero((scores >= least) & (scores <= most))
            best = fits[_best(scores[fits], rank[need[fits]], k)]
            places += [j] * len(best)
            rows.append(need[best])
            found.append(scores[best])
        if not places:
            return None
        return pa.table([pa.repeat(row["id"], len(places)), pa.array(places, pa.int32()), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found), pa.int64())], schema=schema)

    return _walk(chunk, slab, scale, False, wanted, chosen) or schema.empty_table()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _counted(rows: DataFrame, per_group: int) -> int:
    return max(1, -(-rows.count() // per_group))


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    the ``n_negatives`` best rows of other labels with low_pct * positive_score
    <= 100 * negative_score <= high_pct * positive_score, for each of the
    ``n_positives`` best rows of the anchor's label. ``is_anchor`` is a condition
    on the columns of ``df``."""
    spark = df.sparkSession
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    rows = df.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    path = scratch_path(spark, "hard-negatives-rows")
    rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*").write.parquet(path)
    rows = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in rows.schema}
    anchors = rows.where("anchor").drop("anchor")
    chunks, slabs = _counted(rows, CHUNK), _counted(anchors, SLAB)

    tree = T.StructType([T.StructField("slab", T.IntegerType()), T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("vector", kinds["vector"]), T.StructField("tree", kinds["id"]), T.StructField("at", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("edge", T.DoubleType())])
    tree_arrow = _arrow(tree)

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        order, parent, edge = spanning_tree(quantized(group.column("vector"), scale, width_of(group.column("vector"))))
        at = np.empty(len(order), dtype=np.int32)
        at[order] = np.arange(len(order))
        up = np.where(parent[order] < 0, -1, at[parent[order]]).astype(np.int32)
        group = group.take(pa.array(order))
        n = group.num_rows
        columns = [group.column("slab"), group.column("id"), group.column("label"), group.column("vector"), pa.repeat(group.column("id")[0], n), pa.array(np.arange(n, dtype=np.int32)), pa.array(up), pa.array(edge[order])]
        return pa.table([c.cast(f.type) for c, f in zip(columns, tree_arrow, strict=True)], schema=tree_arrow)

    path = scratch_path(spark, "hard-negatives-trees")
    slab = F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int")
    anchors.withColumn("slab", slab).groupBy("slab", "label").applyInArrow(grow, tree).write.parquet(path)
    trees = spark.read.parquet(path)

    candidates = rows.drop("anchor").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))

    def over_blocks(anchors: DataFrame, run, schema: T.StructType) -> DataFrame:
        copies = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return candidates.groupBy("chunk", "slab").cogroup(copies.groupBy("chunk", "slab")).applyInArrow(run, schema)

    first = T.StructType([T.StructField("id", kinds["id"]), T.StructField("positive_id", kinds["id"]), T.StructField("positive_score", T.LongType())])
    first_arrow = _arrow(first)

    def positives(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        return positives_of(chunk, slab, scale, n_positives, first_arrow) if chunk.num_rows and slab.num_rows else first_arrow.empty_table()

    best = Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    found = over_blocks(trees, positives, first).withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < n_positives)
    path = scratch_path(spark, "hard-negatives-positives")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    scores = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("positive_scores"))  # n_positives at most

    second = T.StructType([T.StructField("id", kinds["id"]), T.StructField("place", T.IntegerType()), T.StructField("negative_id", kinds["id"]), T.StructField("negative_score", T.LongType())])
    second_arrow = _arrow(second)

    def negatives(chunk: pa.Table, slab: pa.Table) -> pa.Table:
        return negatives_of(chunk, slab, scale, n_negatives, low_pct, high_pct, second_arrow) if chunk.num_rows and slab.num_rows else second_arrow.empty_table()

    best = Window.partitionBy("id", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = over_blocks(trees.join(scores, "id", "left").withColumn("positive_scores", F.coalesce("positive_scores", F.array().cast("array<long>"))), negatives, second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return mined.join(found, ["id", "place"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
