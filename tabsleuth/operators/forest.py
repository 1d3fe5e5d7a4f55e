"""MLlib's random forest classifier, grown on counts in place of rows.

A forest sees a row only by the bins of its features (at most ``maxBins`` a
feature) and its label, so rows alike in both are one cell with a count. MLlib
still takes every row into every tree at every level; here the rows are read
once and the trees are grown on the cells:

1. the thresholds of the bins come from the rows that MLlib samples for them;
2. a forest of depth 0 whose classes are the cells counts, in its root nodes,
   how often each tree's bootstrap draws a cell: MLlib's own draws, since they
   depend on the seed and the row's place only;
3. trees are dealt over the tasks, which find the best splits of a level from
   the counts. The driver holds the growing trees, as MLlib's does, and draws
   the features of a node by MLlib's generator in MLlib's order;
4. the nodes are saved in MLlib's format and loaded as its model.

Counts are whole numbers, so the model is the one that the estimator itself
fits. Where rows fall into more than ``MAX_CELLS`` cells (many features), or a
setting is not covered, the estimator fits the rows itself.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

#: cells (bins of all features, and label) up to which trees are grown on counts
MAX_CELLS = 1 << 16
#: rows that MLlib reads for the thresholds, at least
SPLIT_ROWS = 10000
#: gain of a split that is not allowed (Double.MinValue)
NO_GAIN = -np.finfo("float64").max


def fit_forest(est, rows: DataFrame):
    """The model that ``est.fit(rows)`` gives. ``rows`` should be written
    (checkpointed): draws depend on the places of rows in their partitions."""
    known = _binned(est, rows)
    if known is None:
        return est.fit(rows)
    counter, classes, thresholds, flags, cells, trees = known
    grown = _Growth(est, classes, [len(t) for t in thresholds], flags)
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(cells)
    while grown.stack:
        group = grown.next_group()
        shape = spark.sparkContext.broadcast((grown.shapes(), group))
        found = trees.mapInArrow(_best_splits(held, shape, grown.settings()), SPLITS).toArrow()
        grown.split(group, {t: [found[c][i].values.to_numpy(zero_copy_only=False) for c in found.column_names[1:]] for i, t in enumerate(found["tree"].to_pylist())})
        shape.unpersist()
    return _as_model(spark, counter, classes, thresholds, flags, grown)


# ---------------------------------------------------------------- cells and draws

def _classes(rows: DataFrame, label: str, most: float) -> int | None:
    """Classes, as MLlib counts them: by the label's attribute, else by the
    greatest label, which then has to be below 100."""
    attr = rows.schema[label].metadata.get("ml_attr", {})
    if "vals" in attr or "num_vals" in attr:
        return len(attr["vals"]) if "vals" in attr else int(attr["num_vals"])
    return int(most) + 1 if most < 100 else None


def _binned(est, rows: DataFrame):
    """(folder of the forest that counted, classes, thresholds of each feature,
    features of two categories, (bins, labels) of the cells, table of trees with
    their counts of each cell), or ``None`` where the estimator has to fit the
    rows itself."""
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector, vector_to_array

    label, vector = est.getLabelCol(), est.getFeaturesCol()
    plain = est.getImpurity() == "gini" and not est.isDefined(est.weightCol) and not est.isDefined(est.thresholds) and est.getMinWeightFractionPerNode() == 0.0 and est.getNumTrees() > 1
    attrs = rows.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    if not plain or "nominal" in attrs:
        return None
    flags = {a["idx"] for a in attrs.get("binary", [])}  # to MLlib features of two categories, 0 and 1
    x = rows.select(F.col(label).cast("double").alias("y"), vector_to_array(F.col(vector)).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    n, fine, width, least, most = x.agg(F.count(F.lit(1)), F.count_if(finite & (F.col("y") == F.floor("y"))), F.max(F.size("x")), F.min("y"), F.max("y")).first()
    classes = _classes(rows, label, most) if n >= 4 and fine == n and least >= 0 else None
    if classes is None or most >= classes:
        return None
    thresholds = [np.array([0.5]) if f in flags else t for f, t in enumerate(_thresholds(est, rows, n, width))]
    radix = [len(t) + 1 for t in thresholds]
    if math.prod(radix) * classes >= 1 << 62:
        return None

    def code(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype="int64")
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for f, t in enumerate(thresholds):
                    if f in flags and not np.isin(v[:, f], (0.0, 1.0)).all():
                        raise ValueError(f"feature {f} has two categories, 0 and 1, but a row gives it another value")
                    out = out * radix[f] + np.searchsorted(t, v[:, f], side="left")
                out = out * classes + batch.column(0).to_numpy().astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["code"])

    coded = materialize(x.mapInArrow(code, "code long"))  # in the order of the rows
    seen = coded.groupBy("code").count().select("code").limit(MAX_CELLS + 1).collect()
    if len(seen) > MAX_CELLS:
        return None
    codes = np.sort(np.array([r["code"] for r in seen], dtype="int64"))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(codes, batch.column(0).to_numpy()).astype("float64"))], names=["cell"])

    drawn = coded.mapInArrow(place, "cell double").select(
        F.col("cell").alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": max(2, len(codes)), "name": label}}), array_to_vector(F.array(F.lit(0.0))).alias(vector))
    counter, path = est.copy({est.maxDepth: 0}).fit(drawn), scratch_path(rows.sparkSession, "forest-draws")
    counter.write().overwrite().save(path)
    tasks = min(est.getNumTrees(), max(1, rows.sparkSession.sparkContext.defaultParallelism))
    trees = rows.sparkSession.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), F.slice("nodeData.impurityStats", 1, len(codes)).alias("drawn"))
    bins, rest = np.empty((len(codes), width), dtype="int64"), codes // classes
    for f in reversed(range(width)):
        bins[:, f], rest = rest % radix[f], rest // radix[f]
    return path, classes, thresholds, flags, (bins, codes % classes), materialize(trees.repartition(tasks, "tree"))


def _thresholds(est, rows: DataFrame, n: int, width: int) -> list[np.ndarray]:
    """Thresholds between the bins of each feature, from the rows (about
    ``SPLIT_ROWS``) that MLlib samples, by its rule."""
    from pyspark.ml.functions import vector_to_array

    spark, seed = rows.sparkSession, est.getSeed()
    wanted = max(est.getMaxBins() ** 2, SPLIT_ROWS)
    share = wanted / n if wanted < n else 1.0
    x = rows.select(vector_to_array(F.col(est.getFeaturesCol())).alias("x"))
    draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = spark._jsparkSession.createDataFrame(x._jdf.toJavaRDD().sample(False, float(share), draw), x._jdf.schema())
    values = np.array([r["x"] for r in DataFrame(some, spark).collect()], dtype="float64").reshape(-1, width)
    return [_between(values[:, f], share * n, min(est.getMaxBins(), n) - 1) for f in range(width)]


def _between(values: np.ndarray, total: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds that cut sampled values into even parts;
    ``total`` values were expected, those missing count as zeros."""
    values = values[values != 0.0]
    if not len(values):
        return np.empty(0)
    v, count = np.unique(values, return_counts=True)
    count = count.astype("float64")
    if total - len(values) > 2.0 ** -52 * len(values) * 100:
        at = int(np.searchsorted(v, 0.0))
        v, count = np.insert(v, at, 0.0), np.insert(count, at, total - len(values))
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride, found = total / (most + 1), []
    have, target = count[0], total / (most + 1)
    for i in range(1, len(v)):
        before, have = have, have + count[i]
        if abs(before - target) < abs(have - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


# ---------------------------------------------------------------- splits

SPLITS = "tree int, feature array<int>, bin array<int>, gain array<double>, left array<double>, right array<double>"


#: the place of a cut between categories 1 (left) and 0 (right)
TURNED = -2


def _gini(stats: np.ndarray, count: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.ones(count.shape)
        for c in range(stats.shape[-1]):  # in MLlib's order of subtractions
            share = stats[..., c] / count
            out = out - share * share
    return np.where(count == 0, 0.0, out)


def best_splits(drawn, bins, labels, at, subsets, settings):
    """For each node, the best (feature, bin, gain, counts left, counts right)
    among the features of its row of ``subsets``. ``drawn``: the tree's draws
    of each cell, ``at``: the node of a cell, or -1."""
    classes, splits, flags, least, least_gain = settings
    nodes, here = len(subsets), np.flatnonzero((at >= 0) & (drawn > 0))
    at, drawn, bins, labels = at[here], drawn[here], bins[here], labels[here]
    best = (np.full(nodes, -1, dtype="int32"), np.full(nodes, -1, dtype="int32"), np.full(nodes, -np.inf), np.zeros((nodes, classes)), np.zeros((nodes, classes)))
    whole = np.bincount(at * classes + labels, weights=drawn, minlength=nodes * classes).reshape(nodes, classes)
    impurity = _gini(whole, whole.sum(axis=1))
    per_feature = {}
    for f in np.unique(subsets):
        if splits[f]:
            width = splits[f] + 1
            of = np.flatnonzero((subsets == f).any(axis=1))
            place = np.full(nodes, -1)
            place[of] = np.arange(len(of))
            use = place[at] >= 0
            hist = np.bincount((place[at[use]] * width + bins[use, f]) * classes + labels[use], weights=drawn[use], minlength=len(of) * width * classes)
            hist = hist.reshape(len(of), width, classes)
            left = hist.cumsum(axis=1)[:, :-1]
            turned = np.zeros(len(of), dtype=bool)
            if f in flags and classes == 2:  # two classes: the category with fewer rows of the second one goes left, an empty one right
                rank = np.where(hist.sum(axis=2) > 0, hist[:, :, 1], np.inf)
                turned = rank[:, 1] < rank[:, 0]
                left[turned] = hist[turned, 1:]
            right = whole[of][:, None] - left
            n_left, n_right = left.sum(axis=2), right.sum(axis=2)
            total = n_left + n_right
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = impurity[of][:, None] - n_left / total * _gini(left, n_left) - n_right / total * _gini(right, n_right)
                gain = np.where((n_left < least) | (n_right < least) | ~(gain >= least_gain), NO_GAIN, gain)
            cut, i = gain.argmax(axis=1), np.arange(len(of))
            per_feature[f] = (of, np.where(turned, TURNED, cut), gain[i, cut], left[i, cut], right[i, cut])
    for k in range(subsets.shape[1]):  # the first feature of a node with the greatest gain
        for f, (of, cut, gain, left, right) in per_feature.items():
            better = (subsets[of, k] == f) & (gain > best[2][of])
            node = of[better]
            best[0][node], best[1][node], best[2][node], best[3][node], best[4][node] = f, cut[better], gain[better], left[better], right[better]
    return best


def _best_splits(cells, shape, settings):
    """Best splits of the nodes of a group, for each tree of a batch."""
    import pyarrow as pa

    def run(batches):
        bins, labels = cells.value
        shapes, group = shape.value
        rows = np.arange(len(bins))
        for batch in batches:
            out = []
            for i, tree in enumerate(batch.column(0).to_pylist()):
                if tree not in group:
                    continue
                feature, cut, left, right = shapes[tree]
                nodes, subsets = group[tree]
                at = np.zeros(len(bins), dtype="int64")
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    value, limit = bins[rows, np.where(inner, feature[at], 0)], cut[at]
                    goes = np.where(limit == TURNED, value > 0, value <= limit)
                    at = np.where(inner, np.where(goes, left[at], right[at]), at)
                place = np.full(len(feature), -1)
                place[nodes] = np.arange(len(nodes))
                out.append((tree, *best_splits(batch.column(1)[i].values.to_numpy(zero_copy_only=False), bins, labels, place[at], subsets, settings)))
            if out:
                lists = [pa.array([v.ravel() for v in c], type=pa.list_(pa.int32() if k < 2 else pa.float64())) for k, c in enumerate([*zip(*out, strict=True)][1:])]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type=pa.int32()), *lists], names=["tree", "feature", "bin", "gain", "left", "right"])

    return run


# ---------------------------------------------------------------- growth

class _Growth:
    """The growing trees, and MLlib's stack of nodes to split: nodes are taken
    in its order, since each takes the next number of one generator to draw
    its features."""

    def __init__(self, est, classes: int, splits: list[int], flags: set[int]):
        self.classes, self.splits, self.flags, width = classes, splits, flags, len(splits)
        self.depth, self.least, self.least_gain = est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinInfoGain()
        self.bytes = est.getMaxMemoryInMB() << 20
        self.features = _feature_count(est, width)
        self.state = (est.getSeed() ^ 0x5DEECE66D) & ((1 << 48) - 1)
        count = est.getNumTrees()
        # of each node: feature (-1: none), bin, children, level, gain, counts, whether its best split was allowed
        self.trees = [[[-1, -1, -1, -1, 0, 0.0, None, True]] for _ in range(count)]
        self.stack = [(t, 0) for t in range(count)] if self.depth >= 0 else []

    def settings(self) -> tuple:
        return self.classes, self.splits, self.flags, self.least, self.least_gain

    def shapes(self) -> list:
        return [tuple(np.array([n[k] for n in tree]) for k in range(4)) for tree in self.trees]

    def next_group(self) -> dict:
        """{tree: (nodes, features of each)} of the next nodes whose statistics
        fit into MLlib's memory setting."""
        todo = self.stack[::-1]
        if self.features < len(self.splits):
            seeds, states = self._longs(len(todo))
            subsets = reservoir(seeds, len(self.splits), self.features)
            size = (np.array(self.splits) + 1)[subsets].sum(axis=1) * self.classes * 8
        else:
            subsets = np.tile(np.arange(len(self.splits)), (len(todo), 1))
            size, states = np.full(len(todo), (sum(self.splits) + len(self.splits)) * self.classes * 8), None
        taken = max(1, int(np.searchsorted(size.cumsum(), self.bytes, side="right")))
        if states is not None:
            self.state = states[min(taken, len(todo) - 1)]  # the node that does not fit has drawn too
        del self.stack[len(self.stack) - taken:]
        group: dict = {}
        for i, (tree, node) in enumerate(todo[:taken]):
            group.setdefault(tree, []).append((node, i))
        return {t: (np.array([n for n, _ in of]), subsets[[i for _, i in of]]) for t, of in group.items()}

    def _longs(self, count: int) -> tuple[np.ndarray, list[int]]:
        """The generator's next numbers (java.util.Random) and its state after each."""
        out, states, state = [], [], self.state
        for _ in range(count):
            a = state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            low = state >> 16
            out.append((((a >> 16) << 32) + (low - (1 << 32) if low >> 31 else low)) & ((1 << 64) - 1))
            states.append(state)
        return np.array(out, dtype="uint64"), states

    def split(self, group: dict, found: dict) -> None:
        for t in _map_order(list(group)):
            tree, (feature, cut, gain, left, right) = self.trees[t], found[t]
            left, right = left.reshape(-1, self.classes), right.reshape(-1, self.classes)
            pure = [np.abs(_gini(s, s.sum(axis=1))) < 2.0 ** -52 for s in (left, right)]
            for i, nid in enumerate(group[t][0].tolist()):
                node = tree[nid]
                node[7] = bool(gain[i] > NO_GAIN)
                if node[6] is None:
                    node[6] = left[i] + right[i]
                if gain[i] <= 0:
                    continue
                node[0], node[1], node[2], node[3], node[5] = int(feature[i]), int(cut[i]), len(tree), len(tree) + 1, float(gain[i])
                level = node[4] + 1
                for stats, leaf in ((left[i], pure[0][i]), (right[i], pure[1][i])):
                    tree.append([-1, -1, -1, -1, level, 0.0, stats, True])
                    if level < self.depth and not leaf:
                        self.stack.append((t, len(tree) - 1))


def _feature_count(est, width: int) -> int:
    """Features that a node draws, by MLlib's settings."""
    how = est.getFeatureSubsetStrategy().lower()
    rules = {"auto": lambda: math.ceil(math.sqrt(width)), "all": lambda: width, "sqrt": lambda: math.ceil(math.sqrt(width)), "log2": lambda: max(1, math.ceil(math.log2(width))), "onethird": lambda: math.ceil(width / 3.0)}
    return rules[how]()


def _map_order(trees: list[int], shift: int = 0) -> list[int]:
    """The order in which MLlib goes through the trees of a group: that of a
    Scala map of integers."""
    if shift == 0 and len(trees) <= 4:
        return sorted(trees, key=lambda t: (t & 15, t))

    def spread(t: int) -> int:
        h = (t + ~(t << 9)) & 0xFFFFFFFF
        h ^= h >> 14
        h = (h + (h << 4)) & 0xFFFFFFFF
        return h ^ (h >> 10)

    parts: dict[int, list[int]] = {}
    for t in trees:
        parts.setdefault(spread(t) >> shift & 31, []).append(t)
    ranked = [parts[k] for k in sorted(parts)]
    return [p[0] for p in ranked if len(p) == 1] + [t for p in ranked if len(p) > 1 for t in _map_order(p, shift + 5)]


def reservoir(seeds: np.ndarray, n: int, k: int) -> np.ndarray:
    """A sample of ``k`` of 0, ..., n - 1 for each seed, as Spark's reservoir
    sampling over its XORShiftRandom draws it."""
    u32, u64 = np.uint32, np.uint64
    rotated = lambda h, r: (h << u32(r)) | (h >> u32(32 - r))

    def hashed(start):
        h = start
        for word in ((seeds >> u64(32)).astype(u32).byteswap(), seeds.astype(u32).byteswap()):
            h = rotated(h ^ rotated(word * u32(0xCC9E2D51), 15) * u32(0x1B873593), 13) * u32(5) + u32(0xE6546B64)
        h = h ^ u32(8)
        h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
        h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
        return h ^ (h >> u32(16))

    low = hashed(np.full(len(seeds), 0x3C074A61, dtype=u32))
    state = (hashed(low).astype(u64) << u64(32)) | low.astype(u64)

    def bits(count):
        nonlocal state
        state = state ^ (state << u64(21))
        state = state ^ (state >> u64(35))
        state = state ^ (state << u64(4))
        return (state & u64((1 << count) - 1)).astype("int64")

    out = np.tile(np.arange(k), (len(seeds), 1))
    rows = np.arange(len(seeds))
    for item in range(k, n):
        high = bits(26)
        at = (((high << 27) + bits(27)) * 2.0 ** -53 * (item + 1)).astype("int64")
        inside = at < k
        out[rows[inside], at[inside]] = item
    return out


# ---------------------------------------------------------------- model

def _as_model(spark, counter: str, classes: int, thresholds: list[np.ndarray], flags: set[int], grown: _Growth):
    """The grown trees as MLlib's model: saved beside the settings of the
    forest that counted the draws (with the depth, classes and features of this
    one), and loaded."""
    import pyarrow as pa
    from pyspark.ml.classification import RandomForestClassificationModel

    path = scratch_path(spark, "forest-model")
    about = json.loads(spark.read.text(f"{counter}/metadata").first()[0])
    about |= {"numFeatures": len(thresholds), "numClasses": classes, "paramMap": about["paramMap"] | {"maxDepth": grown.depth}}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{counter}/treesMetadata").withColumn("_2", F.regexp_replace("_2", '"maxDepth":0', f'"maxDepth":{grown.depth}')).write.parquet(f"{path}/treesMetadata")
    cols: dict[str, list] = {c: [] for c in ("tree", "id", "prediction", "impurity", "stats", "n", "gain", "left", "right", "feature", "threshold", "categories")}
    for t, tree in enumerate(grown.trees):
        _numbered(t, tree, thresholds, flags, cols)
    ints, doubles = pa.int32(), pa.float64()
    split = pa.StructArray.from_arrays([pa.array(cols["feature"], ints), pa.array(cols["threshold"], pa.list_(doubles)), pa.array(cols["categories"], ints)], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [pa.array(cols["id"], ints), pa.array(cols["prediction"], doubles), pa.array(cols["impurity"], doubles), pa.array(cols["stats"], pa.list_(doubles)), pa.array(cols["n"], pa.int64()), pa.array(cols["gain"], doubles), pa.array(cols["left"], ints), pa.array(cols["right"], ints), split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    spark.createDataFrame(pa.table({"treeID": pa.array(cols["tree"], ints), "nodeData": node})).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def _numbered(t: int, tree: list, thresholds: list[np.ndarray], flags: set[int], cols: dict) -> None:
    """Appends the nodes of a tree to ``cols``, parents first. As in MLlib,
    two leaves of one prediction become one leaf."""
    said = [int(n[6].argmax()) for n in tree]
    leaf = [n[0] < 0 for n in tree]
    pruned = [False] * len(tree)
    for i in reversed(range(len(tree))):  # children come after their parents
        _, _, a, b = tree[i][:4]
        if not leaf[i] and leaf[a] and leaf[b] and said[a] == said[b]:
            leaf[i] = pruned[i] = True
            said[i] = said[a]
    impurity = _gini(np.array([n[6] for n in tree]), np.array([n[6].sum() for n in tree]))

    todo, first, at = [(0, None)], len(cols["id"]), 0
    while todo:
        i, parent = todo.pop()
        feature, cut, left, right, _, gain, stats, allowed = tree[i]
        if parent is not None:
            cols["right"][first + parent] = at
        cols["tree"].append(t)
        cols["id"].append(at)
        cols["prediction"].append(float(said[i] if leaf[i] else stats.argmax()))
        cols["impurity"].append(float(impurity[i]) if allowed or pruned[i] else -1.0)
        cols["stats"].append(stats)
        cols["n"].append(int(stats.sum()))
        cols["feature"].append(-1 if leaf[i] else feature)
        category = not leaf[i] and feature in flags
        cols["threshold"].append([] if leaf[i] else [float(cut == TURNED)] if category else [float(thresholds[feature][cut])])
        cols["categories"].append(2 if category else -1)
        cols["gain"].append(-1.0 if leaf[i] else gain)
        cols["left"].append(-1 if leaf[i] else at + 1)
        cols["right"].append(-1)
        if not leaf[i]:
            todo += [(right, at), (left, None)]
        at += 1
