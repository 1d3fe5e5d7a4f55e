"""Baseline models (G7-G18) on ``pyspark.ml``.

Estimators are MLlib's; their settings map the reference's scikit-learn
baselines (sum-loss regularisation -> mean loss). k-nearest neighbours has
no MLlib estimator and is built as an exact blocked join (see ``knn_predict``);
the forest classifier is grown on counts (``forest.py``).
Every evaluation goes through the prediction-table metrics of
``metrics.py``; results are long (model, metric, value) DataFrames.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as mt
from .prep import N_FOLDS, Preprocessor, assign_folds, preprocess_apply, preprocess_fit

SEED = 42
N_NEIGHBORS = 5
KNN = "K-Nearest Neighbors"
# Metrics where a smaller value is better.
LOWER_IS_BETTER_METRICS = ("mae", "mse", "rmse", "log_loss")


def classifiers(n_train: int, n_classes: int) -> dict:
    """Logistic regression (C = 1), tree and forest (depth 10,
    100 trees), Gaussian naive Bayes."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier

    return {
        "Logistic Regression": LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
                                                  family="multinomial" if n_classes > 2 else "binomial"),
        "Decision Tree": DecisionTreeClassifier(maxDepth=10, seed=SEED),
        "Random Forest": RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED),
        "Naive Bayes": NaiveBayes(modelType="gaussian"),
    }


def regressors(n_train: int, y_std: float) -> dict:
    """G12-G14 + trees: OLS, ridge (alpha 1), lasso (alpha .1), tree, forest."""
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor

    return {
        "Linear Regression": LinearRegression(solver="normal", regParam=0.0),
        "Ridge Regression": LinearRegression(solver="normal", regParam=1.0 * (y_std or 1.0) / max(n_train, 1), elasticNetParam=0.0, standardization=False),
        "Lasso Regression": LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-12),
        "Decision Tree": DecisionTreeRegressor(maxDepth=10, seed=SEED),
        "Random Forest": RandomForestRegressor(numTrees=100, maxDepth=10, seed=SEED),
    }


# ---------------------------------------------------------------- G11 k-nearest neighbours

#: training rows that a pivot's cell has on average, and pivots at most
CELL_ROWS, MAX_PIVOTS = 2000, 1024
#: training rows of a box inside a task (where few and where many rows ask), and asking rows that are looked up at a time
BOX_ROWS, LEAST_ROWS, ASK_ROWS = 128, 16, 256
#: numbers of a distance matrix that a task holds at a time, and its rows at least
MATRIX_CELLS, SLICE_ROWS = 1 << 16, 32
#: rows of a cell whose other cells are looked up at a time
SLICE_ASKS = 1024
#: slack of distance bounds, above the rounding of sums of squares
KNN_SLACK = 1e-6


def _cell_of(rows: DataFrame, pivots, columns: list[str]) -> DataFrame:
    """``rows`` (x array<double> and ``columns``) with the nearest pivot and
    the distance to it. The pivots are at most ``MAX_PIVOTS`` vectors."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    # one product gives the squared distances to all pivots, less the row's own square
    held = rows.sparkSession.sparkContext.broadcast((pivots, np.vstack([-2.0 * pivots.T, (pivots ** 2).sum(axis=1)])))
    schema = T.StructType([*[rows.schema[c] for c in columns], rows.schema["x"], T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])

    def run(batches):
        pivots, product = held.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(len(columns)))
                longer = np.column_stack([x, np.ones(len(x))])
                cell = np.concatenate([(part @ product).argmin(axis=1) for part in _slices(longer, len(pivots))])
                off = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off)], names=[f.name for f in schema.fields])

    return rows.select(*columns, "x").mapInArrow(run, schema)


def _matrix(column):
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)


def _distances(a, b):
    import numpy as np

    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :], 0.0))


def _slices(x, width: int) -> list:
    """Slices of the rows of ``x`` whose matrices of ``width`` columns stay
    within ``MATRIX_CELLS`` (a processor's cache), of some rows at least."""
    step = max(SLICE_ROWS, MATRIX_CELLS // max(1, width))
    return [x[s:s + step] for s in range(0, len(x), step)]


def _ranked(qx, tx, tid, reach, k: int):
    """Places in ``qx`` and ``tx``, and squared distances, of the ``k`` rows of
    ``tx`` nearest to each row of ``qx`` that are not farther than its reach."""
    import numpy as np

    kk, parts = min(k, len(tx)), []
    s = 0
    for part in _slices(qx, len(tx)):
        near = _distances(part, tx)
        bound = np.minimum(np.partition(near, kk - 1, axis=1)[:, kk - 1], reach[s:s + len(part)])
        rows, cols = np.nonzero(near <= (bound * (1 + KNN_SLACK) + KNN_SLACK)[:, None])
        # these few again, term by term: the same number in whatever block, so that ties are ties
        d = ((qx[s + rows] - tx[cols]) ** 2).sum(axis=1)
        order = np.lexsort((tid[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        parts.append((s + rows[place < kk], cols[place < kk], d[place < kk]))
        s += len(part)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _boxes(qx, tx, tid, k: int) -> list:
    """The training rows, halved along their widest side until a box has at
    most ``BOX_ROWS`` (``LEAST_ROWS`` where more than ``ASK_ROWS`` ask), with the
    asking rows on the same side of all cuts:
    (training places, asking places, least values, greatest values). A larger
    box that cannot be cut holds equal rows, whose ``k`` smallest ids do."""
    import numpy as np

    todo, done = [(np.arange(len(tx)), np.arange(len(qx)))], []
    while todo:
        t, q = todo.pop()
        x = tx[t]
        low, high = x.min(axis=0), x.max(axis=0)
        side = int((high - low).argmax()) if len(low) else 0
        if len(t) <= BOX_ROWS and (len(q) <= ASK_ROWS or len(t) <= LEAST_ROWS):
            done.append((t, q, low, high))
        elif not len(low) or high[side] == low[side]:
            done.append((t[np.argsort(tid[t], kind="stable")[:k]], q, low, high))
        else:
            v, asked = x[:, side], qx[q, side]
            cut = np.partition(v, len(v) // 2)[len(v) // 2]
            left, asks_left = (v < cut, asked < cut) if cut > low[side] else (v <= cut, asked <= cut)
            todo += [(t[left], q[asks_left]), (t[~left], q[~asks_left])]
    return done


def _nearest(qx, tx, tid, reach, k: int):
    """As :func:`_ranked`, but an asking row is compared only with the boxes of
    training rows that its reach meets. Without a reach, the boxes around it
    that hold ``k`` rows give one. Rows that meet most boxes (as in many
    dimensions) are compared with all rows at once."""
    import numpy as np

    boxes = _boxes(qx, tx, tid, k)
    low, high = np.array([b[2] for b in boxes]), np.array([b[3] for b in boxes])
    size = np.array([len(b[0]) for b in boxes])
    kk, parts, wide = min(k, int(size.sum())), [], []

    def of(some):
        return np.concatenate([boxes[i][0] for i in some])

    for _, q, _, _ in boxes:
        q = q[np.argsort(reach[q], kind="stable")]
        for s in range(0, len(q), ASK_ROWS):
            ask = q[s:s + ASK_ROWS]
            x = qx[ask]
            a, b = x.min(axis=0), x.max(axis=0)
            gap = np.sqrt((np.maximum(np.maximum(low - b, a - high), 0.0) ** 2).sum(axis=1))
            bound = reach[ask]
            if not np.isfinite(bound).all():
                order = np.sqrt((np.maximum(high - a, b - low) ** 2).sum(axis=1)).argsort()
                around = of(order[:np.searchsorted(size[order].cumsum(), kk) + 1])
                bound = np.minimum(bound, np.partition(_distances(x, tx[around]), kk - 1, axis=1)[:, kk - 1])
            some = np.flatnonzero(gap <= bound.max() * (1 + KNN_SLACK) + KNN_SLACK)
            if 2 * size[some].sum() > len(tx):
                wide.append((ask, bound))
            elif len(some):
                near = of(some)
                rows, cols, d = _ranked(x, tx[near], tid[near], bound * (1 + KNN_SLACK) + KNN_SLACK, kk)
                parts.append((ask[rows], near[cols], d))
    if wide:
        ask, bound = (np.concatenate(c) for c in zip(*wide, strict=True))
        rows, cols, d = _ranked(qx[ask], tx, tid, bound * (1 + KNN_SLACK) + KNN_SLACK, k)
        parts.append((ask[rows], cols, d))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _solved(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(qid, tid, d, y): of each test row, the k nearest training rows of each
    block it meets that are not farther than its ``reach``."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("d", pa.float64()), ("y", pa.float64())])

    def solve(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return out.empty_table()
        qx, tx = _matrix(q.column("x")), _matrix(t.column("x"))
        qid, tid, y, reach = (c.to_numpy() for c in (q.column("qid"), t.column("tid"), t.column("y"), q.column("reach")))
        asks, known = (np.flatnonzero(np.isfinite(m).all(axis=1)) for m in (qx, tx))  # others have no distance
        if not len(asks) or not len(known):
            return out.empty_table()
        rows, cols, d = _nearest(qx[asks], tx[known], tid[known], reach[asks], k)
        rows, cols = asks[rows], known[cols]
        return pa.table([pa.array(c) for c in (qid[rows], tid[cols], d, y[cols])], schema=out)

    return test.groupBy("cell", "tb", "qb").cogroup(train.groupBy("cell", "tb", "qb")).applyInArrow(solve, "qid long, tid long, d double, y double")


def _cell_shapes(rows: DataFrame, pivots) -> tuple:
    """Rows, farthest distance from the pivot, least and greatest values of
    each cell, of rows that have distances (one row a pivot reaches the driver)."""
    import numpy as np
    import pyarrow as pa

    schema = "cell int, n long, far double, low array<double>, high array<double>"

    def folded(cell, n, far, low, high):
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        return [cell[at], *[f.reduceat(v[order], at, axis=0) for f, v in ((np.add, n), (np.maximum, far), (np.minimum, low), (np.maximum, high))]]

    def packed(parts):
        cell, n, far, low, high = parts
        return [pa.array(cell.astype(np.int32)), pa.array(n), pa.array(far), pa.array(list(low)), pa.array(list(high))]

    names = ["cell", "n", "far", "low", "high"]

    def shapes(batches):
        held = None
        for batch in batches:
            x, cell, off = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ok = np.isfinite(x).all(axis=1)
            if ok.any():
                x, cell = x[ok], cell[ok]
                new = folded(cell, np.ones(len(cell), dtype="int64"), off[ok], x, x)
                held = new if held is None else folded(*[np.concatenate(c) for c in zip(held, new, strict=True)])
        if held is not None:
            yield pa.RecordBatch.from_arrays(packed(held), names=names)

    def merged(t: pa.Table) -> pa.Table:
        return pa.table(packed(folded(*[t.column(c).to_numpy() for c in names[:3]], _matrix(t.column("low")), _matrix(t.column("high")))), names=names)

    count, radius = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
    low, high = np.full(pivots.shape, np.inf), np.full(pivots.shape, -np.inf)
    for r in rows.select("x", "cell", "off").mapInArrow(shapes, schema).groupBy("cell").applyInArrow(merged, schema).collect():
        c = r["cell"]
        count[c], radius[c], low[c], high[c] = r["n"], r["far"], r["low"], r["high"]
    return count, radius, low, high


def _may_hold(x, home: int, reach, cells):
    """For rows of the cell ``home``: places in ``x`` and cells besides it that
    may hold a training row within reach, and the reach, which a cell of ``k``
    rows may bound too.

    A training row is no nearer than the distance to its cell's pivot less the
    cell's radius, than the box around the cell's rows, and than the plane
    between the two pivots, on whose other side it lies."""
    import numpy as np

    pivots, count, radius, full, low, high = cells
    squares = (pivots ** 2).sum(axis=1)
    apart = np.sqrt(((pivots - pivots[home]) ** 2).sum(axis=1))
    reach, order = reach.copy(), np.argsort(reach, kind="stable")
    rows, found = [], []
    for s in range(0, len(order), SLICE_ASKS):
        at = order[s:s + SLICE_ASKS]
        part, open_ = x[at], ~np.isfinite(reach[at])
        if full.any() and open_.any():
            for few in _slices(at[open_], len(pivots)):
                reach[few] = (_distances(x[few], pivots[full]) + radius[full]).min(axis=1)
        within = reach[at] * (1 + KNN_SLACK) + KNN_SLACK
        least, most = part.min(axis=0), part.max(axis=0)
        gap = np.sqrt((np.maximum(np.maximum(low - most, least - high), 0.0) ** 2).sum(axis=1))
        some = np.flatnonzero((gap <= within.max()) & (count > 0) & (np.arange(len(pivots)) != home))
        if not len(some):
            continue
        own = (part * part).sum(axis=1)
        slack = 1e-9 * (squares.max() + own.max() + (np.sqrt(squares[some]) + radius[some]) ** 2)  # above the rounding of the nearest pivot
        for i, few in zip(range(0, len(part), max(SLICE_ROWS, MATRIX_CELLS // len(some))), _slices(part, len(some)), strict=True):
            to = squares[some] - 2.0 * few @ pivots[some].T
            across = (to - (squares[home] - 2.0 * few @ pivots[home])[:, None] - slack) / (2.0 * apart[some])
            d = np.sqrt(np.maximum(to + own[i:i + len(few), None], 0.0))
            r = within[i:i + len(few)]
            row, cell = np.nonzero((d - radius[some] <= r[:, None]) & (across <= r[:, None]))
            cell = some[cell]
            near = np.sqrt((np.maximum(np.maximum(low[cell] - few[row], few[row] - high[cell]), 0.0) ** 2).sum(axis=1)) <= r[row]
            rows.append(at[i + row[near]])
            found.append(cell[near])
    none = np.empty(0, dtype="int64")
    return np.concatenate([none, *rows]), np.concatenate([none, *found]), reach


def _as_lists(rows, values, n: int, only=None):
    """An Arrow column of ``n`` lists: the values of each row (``rows`` in
    order); with ``only``, null for the other rows."""
    import numpy as np
    import pyarrow as pa

    many = np.bincount(rows, minlength=n)
    if only is not None:
        values, many = values[only[rows]], many * only
    offsets = pa.array(np.concatenate([[0], many.cumsum()]).astype("int32"), mask=None if only is None else np.concatenate([~only, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


class KnnIndex:
    """Training rows (tid, y, x) divided into cells, to be asked for the ``k``
    nearest. Exact; neither side is broadcast.

    Pivots (a sample of the training rows by hash) divide both tables into
    cells. A row first meets the training rows of its own cell; its k-th
    distance is its reach (where the cell has fewer than k rows, distances to
    pivots plus cell radii bound it). Other cells are entered only where
    :func:`_may_hold` says that they may hold a nearer row; most rows of few
    dimensions need none and are done, with no further shuffle. Cells of more
    than ``rows_per_block`` rows, on either side, are split into blocks: a row
    meets the first block of its cell, then the others within its reach. A task
    holds two blocks and compares a row only with boxes of training rows within
    its reach."""

    def __init__(self, train: DataFrame, k: int, rows_per_block: int = 20000):
        import numpy as np

        from ..session import materialize

        self.k, self.rows_per_block, self.n = k, rows_per_block, train.count()
        if self.n:
            m = min(MAX_PIVOTS, max(1, self.n // CELL_ROWS))
            sample = train.select("tid", "x").orderBy(F.xxhash64("tid", F.lit(SEED + 2)), "tid").limit(m).collect()  # MAX_PIVOTS rows at most
            self.pivots = np.unique(np.array([r["x"] for r in sample], dtype="float64").reshape(len(sample), -1), axis=0)
            rows = materialize(_cell_of(train, self.pivots, ["tid", "y"]))
            count, radius, low, high = _cell_shapes(rows, self.pivots)
            self.cells = (self.pivots, count, radius, count >= k, low, high)
            self.blocks = self._blocks(rows)
            self.train = self._dealt(rows, "tid", self.blocks, "tb")

    def _blocks(self, rows: DataFrame) -> list[int]:
        """Blocks of each cell of ``rows``."""
        many = {r["cell"]: -(-r["n"] // self.rows_per_block) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [many.get(c, 1) for c in range(len(self.pivots))]

    @staticmethod
    def _of_cell(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)

    def _dealt(self, rows: DataFrame, key: str, blocks: list[int], at: str) -> DataFrame:
        return rows.withColumn(at, F.pmod(F.xxhash64(key, F.lit(SEED)), self._of_cell(blocks)).cast("int"))

    def neighbours(self, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of ``test`` (qid, x, and columns that Arrow holds) that
        have a neighbour, with ``qid`` and their columns and the labels ``y``
        (array) of the nearest, by distance and id; and the (row, cell) pairs
        that met, as a column ``cell``."""
        from ..session import materialize

        carried = [c for c in test.columns if c != "x"]
        if not self.n:
            none = test.limit(0).select(*carried, F.array().cast("array<double>").alias("y"))
            return none, none.select(F.lit(0).alias("cell"))
        asked = materialize(_cell_of(test, self.pivots, carried).drop("off"))
        first = materialize(self._at_home(asked, carried))
        more = first.where(F.size("more") > 0)
        asked = more.select("qid", "x", "reach", F.col("cell").alias("home"), F.explode("more").alias("cell"))
        asked = self._dealt(asked, "qid", of_asked := self._blocks(asked), "qb")
        asked = asked.withColumn("tb", F.explode(F.sequence((F.col("cell") == F.col("home")).cast("int"), self._of_cell(self.blocks) - 1)))
        found = _solved(asked.drop("home"), self._copied(self.train, of_asked), self.k)
        found = more.select("qid", F.explode(F.arrays_zip("d", "tid", "y")).alias("c")).select("qid", "c.d", "c.tid", "c.y").unionByName(found.select("qid", "d", "tid", "y"))
        nearest = F.slice(F.array_sort(F.collect_list(F.struct("d", "tid", "y"))), 1, self.k)
        found = found.groupBy("qid").agg(nearest.alias("near")).select("qid", F.col("near.y").alias("y"))
        done = first.where(F.size("more") == 0).where(F.size("y") > 0).select(*carried, "y")
        met = first.select(F.explode(F.array_union(F.array("cell"), "more")).alias("cell"))
        return done.unionByName(more.drop("y").join(found, "qid").select(*carried, "y")), met

    def _copied(self, train: DataFrame, asking: list[int]) -> DataFrame:
        """Training rows, once for each block of rows that ask in their cell."""
        return train.withColumn("qb", F.explode(F.sequence(F.lit(0), self._of_cell(asking) - 1)))

    def _at_home(self, asked: DataFrame, carried: list[str]) -> DataFrame:
        """Asking rows with the nearest (y, d, tid) of the first block of their
        cell and the cells to be entered yet (``more``; their own where it has
        other blocks). Rows that are done keep only the labels."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql import types as T

        held, blocks, k = asked.sparkSession.sparkContext.broadcast(self.cells), np.array(self.blocks), self.k
        asked = self._dealt(asked, "qid", of_asked := self._blocks(asked), "qb")
        train = self._copied(self.train.where(F.col("tb") == 0), of_asked)
        lists = [("y", T.DoubleType()), ("d", T.DoubleType()), ("tid", T.LongType()), ("x", T.DoubleType()), ("more", T.IntegerType())]
        schema = T.StructType([*[asked.schema[c] for c in carried], T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType()), *[T.StructField(c, T.ArrayType(t)) for c, t in lists]])
        names = schema.names

        def solve(q: pa.Table, t: pa.Table) -> pa.Table:
            n = q.num_rows
            if not n:
                return pa.table([*[q.column(c) for c in carried], q.column("cell"), pa.array([], pa.float64()), *[pa.array([], pa.list_(v)) for v in (pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int32())]], names=names)
            x, home, reach = _matrix(q.column("x")), q.column("cell")[0].as_py(), np.full(n, np.inf)
            asks = np.flatnonzero(np.isfinite(x).all(axis=1))  # others have no distance
            tx = _matrix(t.column("x")) if t.num_rows else np.empty((0, x.shape[1]))
            known = np.flatnonzero(np.isfinite(tx).all(axis=1))
            tid, y = t.column("tid").to_numpy()[known], t.column("y").to_numpy()[known]
            rows, d, cols = np.empty(0, dtype="int64"), np.empty(0), np.empty(0, dtype="int64")
            if len(asks) and len(known):
                rows, cols, d = _nearest(x[asks], tx[known], tid, reach[asks], k)
                order = np.lexsort((tid[cols], d, rows))
                rows, cols, d = asks[rows[order]], cols[order], d[order]
                last = np.searchsorted(rows, asks, side="right") - 1
                whole = last - np.searchsorted(rows, asks) + 1 >= k
                reach[asks[whole]] = np.sqrt(d[last[whole]])
            at, cells = np.empty(0, dtype="int64"), np.empty(0, dtype="int64")
            if len(asks):
                at, cells, reach[asks] = _may_hold(x[asks], home, reach[asks], held.value)
                at = asks[at]
                if blocks[home] > 1:
                    at, cells = np.concatenate([at, asks]), np.concatenate([cells, np.full(len(asks), home)])
                order = np.argsort(at, kind="stable")
                at, cells = at[order], cells[order]
            open_ = np.bincount(at, minlength=n) > 0
            each = np.repeat(np.arange(n), x.shape[1])
            columns = [_as_lists(rows, y[cols], n), _as_lists(rows, d, n, open_), _as_lists(rows, tid[cols], n, open_), _as_lists(each, x.ravel(), n, open_), _as_lists(at, cells.astype("int32"), n)]
            return pa.table([*[q.column(c) for c in carried], q.column("cell"), pa.array(reach), *columns], names=names)

        return asked.withColumn("tb", F.lit(0)).groupBy("cell", "tb", "qb").cogroup(train.groupBy("cell", "tb", "qb")).applyInArrow(solve, schema)


def _training_table(train: DataFrame, ids: list[str], features: str, label: str) -> DataFrame:
    """(tid, y, x) of training rows: ties in distance go to the smaller tid."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import types as T

    single = len(ids) == 1 and isinstance(train.schema[ids[0]].dataType, T.IntegralType)
    tie = F.col(f"`{ids[0]}`").cast("long") if single else F.xxhash64(*[F.col(f"`{c}`") for c in ids])
    return train.select(tie.alias("tid"), F.col(label).cast("double").alias("y"), vector_to_array(F.col(features)).alias("x"))


def _asking_table(test: DataFrame, columns: list[str], features: str) -> DataFrame:
    """(qid, c0, c1, ..., x) of asking rows: ``columns`` by place."""
    from pyspark.ml.functions import vector_to_array

    return test.select(F.monotonically_increasing_id().alias("qid"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], vector_to_array(F.col(features)).alias("x"))


def _predicted(index: KnnIndex, test: DataFrame, columns: list[str], features: str, task: str, n_classes: int | None) -> DataFrame:
    """``columns`` of ``test`` with prediction (and probability). Columns of
    plain types go along with the rows, others are joined to them again."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import types as T

    from ..session import materialize

    asked = _asking_table(test, columns, features)
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    along = all(isinstance(f.dataType, plain) for f in asked.schema.fields if f.name != "x")
    asked = asked if along else materialize(asked)
    found, _ = index.neighbours(asked if along else asked.select("qid", "x"))
    y = F.col("y")
    more = []
    if task != "classification":
        pred = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.size(y)
    elif n_classes:
        found = found.withColumn("votes", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.size(F.filter(y, lambda v: v == c))))
        pred = (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
        more = [array_to_vector(F.transform("votes", lambda v: v / F.size(y))).alias("probability")]
    else:
        pred = -F.array_max(F.transform(y, lambda v: F.struct(F.size(F.filter(y, lambda w: w == v)).alias("n"), (-v).alias("v"))))["v"]
    found = found.withColumn("_p", pred)
    found = found if along else asked.drop("x").join(found.drop(*[c for c in found.columns if c in asked.columns and c != "qid"]), "qid")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_p").alias("prediction"), *more)


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    id_col: str | list[str],
    features: str = "features",
    label: str = "label",
    k: int = N_NEIGHBORS,
    task: str = "classification",
    rows_per_block: int = 20000,
    n_classes: int | None = None,
) -> DataFrame:
    """Exact k nearest neighbours (Euclidean) -> (id columns, prediction).

    See :class:`KnnIndex` for the layout: cells that cannot hold a
    neighbour are skipped, row pairs are never materialised, and neither side
    is broadcast. Ids may be one or several columns of any type; ties in
    distance go to the smaller integer id (else to the smaller hash of the id);
    the vote goes to the most frequent label (ties: smallest), regression takes
    the mean. With ``n_classes`` (labels 0, 1, ...) there is a ``probability``
    vector too: the share of the votes of each class."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    index = KnnIndex(_training_table(train, ids, features, label), k, rows_per_block)
    return _predicted(index, test, ids, features, task, n_classes)


def knn_pruning(train: DataFrame, test: DataFrame, id_col: str | list[str], features: str = "features", label: str = "label", k: int = N_NEIGHBORS, rows_per_block: int = 20000) -> DataFrame:
    """One row with the pairs of test and training rows, those compared,
    and the share that the bounds of cells spared."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    index = KnnIndex(_training_table(train, ids, features, label), k, rows_per_block)
    _, met = index.neighbours(_asking_table(test, [], features))
    pairs = index.n * test.count()
    compared = sum(r["n"] * int(index.cells[1][r["cell"]]) for r in met.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
    return train.sparkSession.createDataFrame([(pairs, compared, float(1 - compared / pairs) if pairs else 0.0)], "pairs long, compared long, pruned_share double")


# ---------------------------------------------------------------- G16 training loop

def _label_index(df: DataFrame, target: str):
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)


def evaluate_predictions(pred: DataFrame, task: str, classes: list | None = None) -> DataFrame:
    """H metrics of one prediction table (label, prediction[, probability])
    -> (metric, value) rows."""
    from pyspark.ml.functions import vector_to_array

    from ..session import materialize

    p = pred.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), *([vector_to_array("probability").alias("prob")] if "probability" in pred.columns else []))
    p = materialize(p)  # read by every metric: the model predicts once
    rows = []
    if task == "classification":
        rows.append(mt.accuracy(p))
        rows.append(mt.balanced_accuracy(p))
        binary = classes is not None and len(classes) == 2
        if binary:
            rows.append(mt.binary_prf(p, positive=1.0))
            if "prob" in p.columns:
                q = p.withColumn("score", F.col("prob")[1])
                rows.append(mt.roc_auc(q, positive=1.0))
                rows.append(mt.average_precision(q, positive=1.0).withColumnRenamed("average_precision", "pr_auc"))
                rows.append(mt.log_loss_binary(q, positive=1.0))
        else:
            rows.append(mt.multiclass_prf(p).select("f1_macro", "f1_weighted", "precision_macro", "recall_macro"))
            if "prob" in p.columns and classes is not None:
                names = [f"p{i}" for i in range(len(classes))]
                q = p.select("y_true", *[F.col("prob")[i].alias(n) for i, n in enumerate(names)])
                index = [float(i) for i in range(len(classes))]
                rows.append(mt.roc_auc_multiclass(q, index, names).select("roc_auc_ovr"))
                rows.append(mt.log_loss_multiclass(q, index, names))
    else:
        rows.append(mt.regression_metrics(p).select("mae", "rmse", "r2", "mape"))
    wide = rows[0]
    for x in rows[1:]:
        wide = wide.crossJoin(x)  # one-row frames
    cols = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select("m.*")


@dataclass
class BaselineRun:
    """What training leaves behind: the result rows, and everything needed to
    predict with or to explain a fitted model."""

    results: DataFrame  # (model, metric, value, error)
    models: dict
    preprocessor: Preprocessor
    task: str
    classes: list | None
    train: DataFrame  # raw features, keys, label
    test: DataFrame

    def best(self) -> str | None:
        row = select_best_model(self.results).first()
        return row["best_model"] if row else None

    def predict(self, df: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns with the model's prediction of raw rows."""
        return self.models[model].transform(preprocess_apply(df, self.preprocessor, keep=keep or ["label"]))


def train_baselines(
    df: DataFrame,
    target: str,
    key: str | list[str],
    task: str,
    features: list[str] | None = None,
    models: list[str] | None = None,
    include_knn: bool = True,
    cv_folds: int = N_FOLDS,
    parallelism: int = 4,
) -> BaselineRun:
    """Split (stratified for classification), preprocess (fitted on the
    training rows), fit every baseline, predict the test rows, compute
    metrics, and cross-validate the primary score on the training rows (the
    preprocessing is fitted anew in each fold; ``cv_folds=0`` skips it). A
    failing model yields an 'error' row instead of failing the run. Up to
    ``parallelism`` fits (of a model, or of a model in a fold) run side by
    side; the rows of a fold are preprocessed once for all models.

    ``results`` has (model, metric, value, error) rows; ``primary_score`` is
    the balanced accuracy or -RMSE; ``train_seconds`` the fit time.
    """
    from pyspark.ml.classification import RandomForestClassifier

    from ..session import materialize
    from .clean import filter_target_not_null
    from .forest import fit_forest
    from .prep import random_split, stratified_split

    if task not in ("classification", "regression"):
        raise ValueError("task must be 'classification' or 'regression' (an unclear task has to be named by the caller)")
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    feats = features or [c for c in df.columns if c != target and c not in keys]
    data = filter_target_not_null(df, target)
    if task == "classification":
        data = stratified_split(data, target, keys)
        data = data.withColumn("_target", F.col(f"`{target}`"))  # the indexer takes no names with a dot
        indexer = _label_index(data, "_target")
        data = indexer.transform(data).drop("_target")
        classes = list(indexer.labels)
    else:
        data = random_split(data, keys).withColumn("label", F.col(f"`{target}`").cast("double"))
        classes = None
    data = materialize(data)  # split + label index computed once, reused by every model
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    prep = preprocess_fit(train, feats)
    tr = preprocess_apply(train, prep, keep=keys + ["label"])
    te = preprocess_apply(test, prep, keep=keys + ["label"])

    def candidates(rows: DataFrame) -> dict:
        n, sd = rows.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
        found: dict = dict(classifiers(n, len(classes)) if task == "classification" else regressors(n, sd))
        if include_knn:
            found[KNN] = None
        return {k: v for k, v in found.items() if not models or k in models}

    def fitted(name: str, est, rows: DataFrame):
        if name == KNN:
            return KnnModel(rows, keys, task, len(classes) if classes else None)
        est = est.setFeaturesCol("features").setLabelCol("label")
        return fit_forest(est, rows) if isinstance(est, RandomForestClassifier) else est.fit(rows)

    names = list(candidates(tr))
    if cv_folds:
        folds = materialize(assign_folds(train, keys, label="label" if task == "classification" else None, k=cv_folds))
        prepared = side_by_side([lambda f=f: fold_tables(folds, f, feats, keys) for f in range(cv_folds)], parallelism)
    tr, te = materialize(tr), materialize(te)  # read by every model

    def trained(name: str):
        try:
            t0 = time.time()
            model = fitted(name, candidates(tr)[name], tr)
            secs = time.time() - t0
            rows = [(name, r["metric"], r["value"], None) for r in evaluate_predictions(model.transform(te), task, classes).collect()]
            score = {m: v for _, m, v, _ in rows}
            rows.append((name, "primary_score", score["balanced_accuracy"] if task == "classification" else -score["rmse"], None))
            return [*rows, (name, "train_seconds", secs, None)], model
        except Exception as e:  # noqa: BLE001 - one failing model must not stop the others
            return [(name, "error", None, str(e)[:500])], None

    jobs = [lambda n=name: trained(n) for name in names]
    if cv_folds:
        jobs += [lambda n=name, f=f: fold_score(f, lambda r: fitted(n, candidates(r)[n], r), task) for name in names for f in prepared]
    done = side_by_side(jobs, parallelism)
    results, kept = [], {}
    for i, name in enumerate(names):
        rows, model = done[i]
        results += rows
        if model is not None:
            kept[name] = model
            if cv_folds:
                value, error = mean_score(done[len(names) + i * cv_folds:len(names) + (i + 1) * cv_folds])
                results.append((name, "cv_mean", value, error))
    return BaselineRun(spark.createDataFrame(results, "model string, metric string, value double, error string"), kept, prep, task, classes, train, test)


def side_by_side(jobs: list, parallelism: int) -> list:
    """Results of the jobs, in order, at most ``parallelism`` at a time. Each
    one runs in a pinned thread with this thread's Spark properties, in a
    scheduler pool of its own (used where the scheduler mode is FAIR)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if parallelism <= 1 or len(jobs) <= 1 or spark is None:
        return [job() for job in jobs]

    def pooled(i: int, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"job-{i % parallelism}")
        return job()

    with ThreadPoolExecutor(parallelism) as pool:
        # the properties are copied when the target is made, once a job
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(pooled), i, job) for i, job in enumerate(jobs)]]


class KnnModel:
    """The neighbours estimator in the form of a fitted model."""

    def __init__(self, train: DataFrame, keys: list[str], task: str, n_classes: int | None = None):
        self.train, self.keys, self.task, self.n_classes = train, keys, task, n_classes
        self.index = None

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows, less their ``features``, with ``prediction`` (and
        ``probability``: vote shares). Keys need not be unique. The training
        rows are divided into cells at the first call, for all calls."""
        if self.index is None:
            train = self.train.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in self.keys]))
            self.index = KnnIndex(_training_table(train, ["_row"], "features", "label"), N_NEIGHBORS)
        return _predicted(self.index, df, [c for c in df.columns if c != "features"], "features", self.task, self.n_classes)


def fold_tables(folded: DataFrame, fold: int, features: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training and held rows of one fold, preprocessed by what its training
    rows say, written once for all models."""
    from ..session import materialize

    inside, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
    prep = preprocess_fit(inside, features)
    return tuple(materialize(preprocess_apply(d, prep, keep=keys + ["label"])) for d in (inside, held))


def fold_score(tables: tuple[DataFrame, DataFrame], fit, task: str) -> tuple[float | None, str | None]:
    """Primary score (balanced accuracy or -RMSE) of ``fit(rows)`` in one fold,
    or its error."""
    from ..session import materialize

    try:
        pred = materialize(fit(tables[0]).transform(tables[1]).select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")))
        return (mt.balanced_accuracy(pred).first()[0] if task == "classification" else -mt.regression_metrics(pred).first()["rmse"]), None
    except Exception as e:  # noqa: BLE001 - reported beside the model's other rows
        return None, str(e)[:500]


def mean_score(folds: list[tuple[float | None, str | None]]) -> tuple[float | None, str | None]:
    """Mean of the folds' scores; a failing fold gives no score but its error."""
    errors = [e for _, e in folds if e is not None]
    return (None, errors[0]) if errors else (float(sum(v for v, _ in folds) / len(folds)), None)


def cross_validate_score(folded: DataFrame, fit, task: str, features: list[str], keys: list[str], parallelism: int = 4) -> tuple[float | None, str | None]:
    """Mean primary score (balanced accuracy or -RMSE) over the folds of
    ``folded`` (raw rows with ``label`` and ``fold``). Preprocessing and model
    (``fit(rows)``) see the other folds only. Folds run side by side; a
    failing fold gives no score but its error."""

    def one(f: int) -> tuple[float | None, str | None]:
        try:
            return fold_score(fold_tables(folded, f, features, keys), fit, task)
        except Exception as e:  # noqa: BLE001 - reported beside the model's other rows
            return None, str(e)[:500]

    return mean_score(side_by_side([lambda f=f: one(f) for f in range(folded.agg(F.max("fold")).first()[0] + 1)], parallelism))


def select_best_model(results: DataFrame, group_cols: list[str] | None = None, score: str = "primary_score") -> DataFrame:
    """Model with the highest primary score among non-failed models (ties:
    the first name)."""
    g = group_cols or []
    ok = results.where(F.col("metric") == score).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return ok.groupBy(*g).agg(F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"), F.max("value").alias("best_score"))


def model_leaderboard(results: DataFrame, metric: str, group_cols: list[str] | None = None) -> DataFrame:
    """Models ranked by ``metric`` (ascending for error metrics); models
    without the metric have no score and come last, failed ones at the very end
    with their error."""
    from pyspark.sql import Window

    g = group_cols or []
    models = results.select(*g, "model").distinct()
    vals = results.where((F.col("metric") == metric) & ~F.isnan("value")).select(*g, "model", F.col("value").alias("primary_metric"))
    errs = results.where(F.col("metric") == "error").select(*g, "model", F.col("error"))
    t = models.join(vals, [*g, "model"], "left").join(errs, [*g, "model"], "left")
    t = t.withColumn("status", F.when(F.col("error").isNotNull(), "Failed").otherwise("Success"))
    value = F.col("primary_metric")
    order = value.asc_nulls_last() if metric.lower() in LOWER_IS_BETTER_METRICS else value.desc_nulls_last()
    w = Window.partitionBy(*g).orderBy(F.col("error").isNotNull(), order, F.col("model"))  # one row per model
    return t.withColumn("rank", F.row_number().over(w)).select(*g, "rank", "model", "primary_metric", "status", "error")
