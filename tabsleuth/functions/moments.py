"""Shifted power sums: moments and pairwise co-moments in codegen-friendly passes.

Spark's statistical aggregates (``corr``, ``stddev``, ``skewness`` ...) keep
3-5 buffer fields each; a few dozen of them in one aggregation exceed the
whole-stage-codegen field limit and the aggregation falls back to the
interpreted path (several times slower). Here every statistic is a plain
``sum``/``count``/``min``/``max`` of values shifted by the column mean (from a
first, narrow pass), so the sums stay numerically stable, and the
aggregations are batched to at most ``MAX_FIELDS`` outputs each. The few
per-column / per-pair numbers are finished on the driver. Wide tables would
need one pass per 90 pairs that way; their co-moments come from one scan in
which each task multiplies blocks of rows (``co_moments``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import numeric_value

MAX_FIELDS = 90


def batched_agg(df: DataFrame, exprs: list[tuple[str, Column]], max_fields: int = MAX_FIELDS) -> dict:
    """Evaluate named aggregate expressions in passes of <= max_fields."""
    out: dict = {}
    for i in range(0, len(exprs), max_fields):
        part = exprs[i:i + max_fields]
        row = df.agg(*[e.alias(f"a{j}") for j, (_, e) in enumerate(part)]).first()
        for j, (name, _) in enumerate(part):
            out[name] = row[f"a{j}"]
    return out


def column_shifts(df: DataFrame, cols: list[str]) -> tuple[dict, dict, int]:
    """(mean, non-null count) per column and the row count - one narrow pass."""
    exprs = [("__n", F.count(F.lit(1)))]
    for c in cols:
        v = numeric_value(df, c)
        exprs += [(f"m:{c}", F.avg(v)), (f"c:{c}", F.count(v))]
    r = batched_agg(df, exprs)
    return {c: r[f"m:{c}"] for c in cols}, {c: r[f"c:{c}"] for c in cols}, r["__n"]


def column_moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """count, mean, std (n-1), min, max, skewness G1, kurtosis G2 per column."""
    means, _, _ = column_shifts(df, cols)
    exprs = []
    for c in cols:
        v = numeric_value(df, c)
        d = v - F.lit(means[c] if means[c] is not None else 0.0)
        exprs += [(f"n:{c}", F.count(v)), (f"s1:{c}", F.sum(d)), (f"s2:{c}", F.sum(d * d)), (f"s3:{c}", F.sum(d * d * d)),
                  (f"s4:{c}", F.sum(d * d * d * d)), (f"min:{c}", F.min(v)), (f"max:{c}", F.max(v))]
    r = batched_agg(df, exprs)
    out = {}
    for c in cols:
        n = r[f"n:{c}"] or 0
        res = {"count": n, "mean": None, "std": None, "min": r[f"min:{c}"], "max": r[f"max:{c}"], "skewness": None, "kurtosis": None}
        if n > 0:
            s1, s2, s3, s4 = (float(r[f"{k}:{c}"]) for k in ("s1", "s2", "s3", "s4"))
            m1 = s1 / n
            res["mean"] = (means[c] or 0.0) + m1
            m2 = max(s2 / n - m1 * m1, 0.0)
            m3 = s3 / n - 3 * m1 * s2 / n + 2 * m1 ** 3
            m4 = s4 / n - 4 * m1 * s3 / n + 6 * m1 * m1 * s2 / n - 3 * m1 ** 4
            if n > 1:
                res["std"] = math.sqrt(m2 * n / (n - 1))
            if n > 2 and m2 > 0:
                g1 = m3 / m2 ** 1.5
                res["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2)
            if n > 3 and m2 > 0:
                g2 = m4 / (m2 * m2) - 3
                res["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        out[c] = res
    return out


#: columns up to which co-moments are built-in sums in one codegen-sized pass
NARROW = 8
#: values of a block of rows that a task multiplies at once
BLOCK_VALUES = 1 << 20
#: partial matrices that one task of the reduction adds up
FAN_IN = 32


def _partials(x: DataFrame) -> DataFrame:
    """One row for each task and matrix row i, with the sums over the rows
    where columns i and j are both there, for all j >= i, of values less the
    task's own shift: n, a and b (of i and of j), aa, bb, ab. A task adds up
    blocks of rows by matrix products; its memory is a block and 6 p x p
    matrices."""
    import numpy as np
    import pyarrow as pa

    p = len(x.columns)
    schema = "i int, part int, shift array<double>, n array<double>, a array<double>, b array<double>, aa array<double>, bb array<double>, ab array<double>"

    def run(batches):
        from pyspark import TaskContext

        shift, sums, step = None, None, max(1, BLOCK_VALUES // p)
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
            for k in range(0, len(whole), step):
                block = whole[k:k + step]
                there = ~np.isnan(block)
                if shift is None:
                    count = there.sum(axis=0)
                    shift = np.where(count > 0, np.where(there, block, 0.0).sum(axis=0) / np.maximum(count, 1), 0.0)
                    sums = np.zeros((4, p, p))
                d = np.where(there, block - shift, 0.0)
                m = there.astype("float64")
                sums[0] += m.T @ m  # n
                sums[1] += d.T @ m  # sum of the row column over common rows
                sums[2] += (d * d).T @ m
                sums[3] += d.T @ d
        if sums is None:
            return
        n, s, q, c = sums
        out = [(i, TaskContext.get().partitionId() % (1 << 30), shift[i:], n[i, i:], s[i, i:], s[i:, i], q[i, i:], q[i:, i], c[i, i:]) for i in range(p)]
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array([list(v) for v in col], pa.list_(pa.float64())) for col in columns[2:])]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "part", "shift", "n", "a", "b", "aa", "bb", "ab"])

    return x.mapInArrow(run, schema)


def _added(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial matrix rows of a key added up, moved to a common shift first."""
    import numpy as np
    import pyarrow as pa

    def add(group: pa.Table) -> pa.Table:
        rows = {c: np.array(group.column(c).to_pylist(), dtype="float64") for c in ("shift", "n", "a", "b", "aa", "bb", "ab")}
        weight = np.maximum(rows["n"].sum(axis=1, keepdims=True), 1.0)
        # any common shift will do; the first column of a row is column i itself
        common = (rows["shift"] * weight).sum(axis=0) / weight.sum()
        dj = rows["shift"] - common
        di, n = dj[:, :1], rows["n"]
        new = {
            "n": n,
            "a": rows["a"] + di * n,
            "b": rows["b"] + dj * n,
            "aa": rows["aa"] + 2 * di * rows["a"] + di * di * n,
            "bb": rows["bb"] + 2 * dj * rows["b"] + dj * dj * n,
            "ab": rows["ab"] + di * rows["b"] + dj * rows["a"] + di * dj * n,
        }
        first = group.slice(0, 1)
        columns = {"i": first.column("i"), "part": first.column("part"), "shift": [common.tolist()]} | {c: [v.sum(axis=0).tolist()] for c, v in new.items()}
        return pa.table({c: columns[c] if c in ("i", "part") else pa.array(columns[c], pa.list_(pa.float64())) for c in columns})

    return partials.groupBy(*keys).applyInArrow(add, partials.schema)


def co_moments(df: DataFrame, values: list[Column]) -> dict[tuple[int, int], dict[str, float]]:
    """For every pair i <= j of ``values``: n, means and centred sums (saa,
    sbb, sab) over the rows where both are there, from one scan whatever the
    number of columns. Tasks add up their rows by matrix products, the partial
    matrices are added up in two levels of at most ``FAN_IN`` and
    tasks / ``FAN_IN`` rows of p numbers, and p * p / 2 results reach the driver."""
    p = len(values)
    x = df.select(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, v in enumerate(values)])
    parts = _partials(x)
    parts = _added(parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), ["i", "part"])
    out: dict = {}
    for r in _added(parts, ["i"]).toLocalIterator():
        i = r["i"]
        for k, (shift, n, a, b, aa, bb, ab) in enumerate(zip(r["shift"], r["n"], r["a"], r["b"], r["aa"], r["bb"], r["ab"], strict=True)):
            if n:
                out[(i, i + k)] = {"n": n, "mean_a": r["shift"][0] + a / n, "mean_b": shift + b / n, "saa": aa - a * a / n, "sbb": bb - b * b / n, "sab": ab - a * b / n}
    for i in range(p):
        for j in range(i, p):
            out.setdefault((i, j), {"n": 0.0, "mean_a": None, "mean_b": None, "saa": 0.0, "sbb": 0.0, "sab": 0.0})
    return out


def pearson_of(m: dict[str, float]) -> float | None:
    """Pearson r of one pair's co-moments; None when a side is constant (up to
    rounding of its mean) or there are fewer than 2 rows."""
    if m["n"] < 2:
        return None
    floor = [m["n"] * (v * 1e-15) ** 2 for v in (m["mean_a"], m["mean_b"])]
    if m["saa"] <= floor[0] or m["sbb"] <= floor[1]:
        return None
    return max(-1.0, min(1.0, m["sab"] / math.sqrt(m["saa"] * m["sbb"])))


def pairwise_pearson(df: DataFrame, pairs: list[tuple[str, str]], values: dict[str, Column] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson r of each pair over its pair-complete rows (pairwise deletion),
    from shifted sums; None when a side is constant or fewer than 2 rows. More
    than ``NARROW`` columns take one scan of :func:`co_moments`; few columns
    take built-in sums (one narrow pass for the shifts, one or two for the sums)."""
    cols = sorted({c for p in pairs for c in p})
    vals = values or {c: numeric_value(df, c) for c in cols}
    if len(cols) > NARROW:
        at = {c: i for i, c in enumerate(cols)}
        m = co_moments(df, [vals[c] for c in cols])
        return {(a, b): pearson_of(m[tuple(sorted((at[a], at[b])))]) for a, b in pairs}
    names = {c: f"v{i}" for i, c in enumerate(cols)}
    back = {v: c for c, v in names.items()}
    x = df.select(*[vals[c].alias(names[c]) for c in cols])
    return {(back[a], back[b]): v for (a, b), v in _narrow_pearson(x, [(names[a], names[b]) for a, b in pairs]).items()}


def _narrow_pearson(x: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """The same for few columns, by built-in sums."""
    cols = x.columns
    means, counts, total = column_shifts(x, cols)
    complete = {c for c in cols if counts[c] == total}
    d = {c: F.col(c) - F.lit(means[c] if means[c] is not None else 0.0) for c in cols}
    exprs = []
    for c in sorted(complete):
        exprs += [(f"S:{c}", F.sum(d[c])), (f"Q:{c}", F.sum(d[c] * d[c]))]
    for a, b in pairs:
        exprs.append((f"P:{a}|{b}", F.sum(d[a] * d[b])))
        if not (a in complete and b in complete):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            exprs += [
                (f"N:{a}|{b}", F.count_if(both)),
                (f"SA:{a}|{b}", F.sum(F.when(both, d[a]))),
                (f"SB:{a}|{b}", F.sum(F.when(both, d[b]))),
                (f"QA:{a}|{b}", F.sum(F.when(both, d[a] * d[a]))),
                (f"QB:{a}|{b}", F.sum(F.when(both, d[b] * d[b]))),
            ]
    r = batched_agg(x, exprs)
    out = {}
    for a, b in pairs:
        if a in complete and b in complete:
            n, sa, sb, qa, qb = total, r[f"S:{a}"], r[f"S:{b}"], r[f"Q:{a}"], r[f"Q:{b}"]
        else:
            key = f"{a}|{b}"
            n, sa, sb, qa, qb = r[f"N:{key}"], r[f"SA:{key}"], r[f"SB:{key}"], r[f"QA:{key}"], r[f"QB:{key}"]
        p = r[f"P:{a}|{b}"]
        if not n or n < 2 or p is None:
            out[(a, b)] = None
            continue
        cov = p - sa * sb / n
        va = qa - sa * sa / n
        vb = qb - sb * sb / n
        out[(a, b)] = max(-1.0, min(1.0, cov / math.sqrt(va * vb))) if va > 0 and vb > 0 else None
    return out
