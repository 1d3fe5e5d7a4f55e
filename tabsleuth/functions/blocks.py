"""Blocks of a column's values, for rank statistics that Spark deals out by value.

Cut points (quantiles from one scan, at most ``MAX_CUTS`` a column) divide a
column's values: a cut value is a block of its own (odd numbers), the values
between two cuts are another one (even numbers). A value that many rows share
is a cut, so the rows of a block that has several values are at most about
rows / cuts, and blocks of one value need no sort. The cuts decide only who
compares what; results are exact with any cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows between two cuts, on average, and cuts of a column at most
BLOCK_ROWS, MAX_CUTS = 100_000, 256
#: rows of a leaf in :func:`ascents`, at least
LEAF = 128


def cut_points(df: DataFrame, columns: list[str], batch: int = 50) -> dict[str, np.ndarray]:
    """The distinct cut points of double ``columns``, ascending."""
    m = min(MAX_CUTS, df.count() // BLOCK_ROWS + 1)
    probs = F.array(*[F.lit((i + 0.5) / m) for i in range(m)])
    out: dict = {}
    for i in range(0, len(columns), batch):
        some = columns[i:i + batch]
        row = df.agg(*[F.percentile_approx(F.col(c), probs, 20 * MAX_CUTS).alias(c) for c in some]).first()
        out |= {c: np.unique(np.array(row[c] or [], dtype="float64")) for c in some}
    return out


def block_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Block numbers, 0 to 2 * cuts; of a missing value -1."""
    low = np.searchsorted(cuts, values, "left")
    return np.where(np.isnan(values), -1, low + np.searchsorted(cuts, values, "right"))


def block_counts(df: DataFrame, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of each block of each (double) column of ``df``, from one scan."""
    import pyarrow as pa

    def count(batches):
        sums = [np.zeros(2 * len(c) + 1, dtype="int64") for c in cuts]
        for batch in batches:
            for n, v, c in zip(sums, doubles(batch), cuts, strict=True):
                b = block_of(v, c)
                n += np.bincount(b[b >= 0], minlength=len(n))
        for i, n in enumerate(sums):
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i)), pa.array(b), pa.array(n[b])], names=["c", "b", "n"])

    out = [np.zeros(2 * len(c) + 1, dtype="int64") for c in cuts]
    for r in df.mapInArrow(count, "c long, b long, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
        out[r["c"]][r["b"]] = r["n"]
    return out


def doubles(batch) -> list[np.ndarray]:
    """Columns of an Arrow batch or table, missing values as NaN."""
    return [c.to_numpy() if hasattr(c, "chunks") else c.to_numpy(zero_copy_only=False) for c in batch.columns]


def ties(*keys: np.ndarray) -> int:
    """Pairs of rows that agree in all ``keys``."""
    order = np.lexsort(keys)
    if not len(order):
        return 0
    new = np.ones(len(order) + 1, dtype=bool)
    new[1:-1] = False
    for k in keys:
        new[1:-1] |= k[order][1:] != k[order][:-1]
    t = np.diff(np.flatnonzero(new))
    return int((t * (t - 1) // 2).sum())


def smaller_in_both(table: np.ndarray) -> int:
    """Pairs of rows of which one is in a smaller line and a smaller column of
    a table of counts."""
    table = table.astype("int64")
    below = table.cumsum(axis=0)[:-1, :-1].cumsum(axis=1)
    return int((table[1:, 1:] * below).sum())


def concordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of rows of which one has the smaller x and the smaller y."""
    return ascents(_numbered(y[np.lexsort((-y, x))]))


def ascents(p: np.ndarray) -> int:
    """Pairs i < j with p[i] < p[j] of a permutation: places and values are cut
    into leaves; pairs in different leaves of both come from a table of counts,
    pairs in one leaf by comparing it with itself moved by 1, 2, ... places."""
    n = len(p)
    if n < 2:
        return 0
    leaf = max(LEAF, 1 << int(n // 1024).bit_length())
    m = -(-n // leaf)
    table = np.bincount((np.arange(n) // leaf) * m + p // leaf, minlength=m * m).reshape(m, m)
    inverse = np.empty(n, dtype="int64")
    inverse[p] = np.arange(n)
    return smaller_in_both(table) + _within(p, leaf) + _within(inverse // leaf, leaf)


def _within(values: np.ndarray, leaf: int) -> int:
    """Pairs i < j of one leaf with values[i] < values[j]."""
    rows = np.full(-(-len(values) // leaf) * leaf, -1, dtype="int32")
    rows[:len(values)] = values
    rows = np.ascontiguousarray(rows.reshape(-1, leaf).T)  # the added places come last and hold the least value
    return sum(int(np.count_nonzero(rows[:-d] < rows[d:])) for d in range(1, leaf))


def _numbered(y: np.ndarray) -> np.ndarray:
    """Place of each value in ascending order, equal ones from the back."""
    n = len(y)
    place = np.empty(n, dtype="int64")
    place[n - 1 - np.argsort(y[::-1], kind="stable")] = np.arange(n)
    return place
