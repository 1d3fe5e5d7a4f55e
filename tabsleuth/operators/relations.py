"""Relationships between columns (E1-E16), all results in long form.

Pairwise work is done for all pairs in one job wherever possible:
``corr`` of every numeric pair in one aggregation; contingency tables of
every categorical pair from one explode into (pair, a, b) cells followed by
one hash aggregation (Spark's Expand, i.e. GROUPING SETS, without the NULL
ambiguity); ANOVA moments of every (numeric, categorical) pair from one
grouped aggregation per categorical level. Only per-pair rows reach the
driver, never data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.blocks import block_counts, block_of, concordant, cut_points, doubles, smaller_in_both, ties
from ..functions.ranking import average_ranks, cumulative_by_value, exact_quantiles, value_frequencies
from ..functions.moments import batched_agg, co_moments, pairwise_pearson
from ..functions.stats import chi2_pvalue_udf, f_pvalue_udf
from ..session import materialize

# Thresholds used to label relationships.
STRONG_CORR = 0.7
VERY_STRONG_CORR = 0.9
STRONG_ASSOC = 0.5
VERY_STRONG_ASSOC = 0.8
ANOVA_MIN_ROWS = 10
ANOVA_ALPHA = 0.05
VIF_HIGH = 10.0
MI_BINS = 10
MISSING_LABEL = "Missing"
PAIR_BATCH = 50  # pairs per explode
KENDALL_BATCH = 10
RANKED_PAIRS = 3  # pairs of one column with missing values that are ranked at once, at least
RANK_PASSES = 8  # columns that are ranked by a pass each, at most
# A scaled Gram matrix with an eigenvalue this small has a linear dependence of
# the columns whose share in its eigenvector is larger than the second number.
COLLINEAR_EIGENVALUE, COLLINEAR_SHARE = 1e-13, 1e-5


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _pair_schema(value: str = "value") -> str:
    return f"var1 string, var2 string, {value} double"


# ---------------------------------------------------------------- E1 / E4

def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every numeric pair (upper triangle, pairwise
    deletion); NULL where a side is constant. Shifted co-moment sums in
    codegen-sized passes (see ``functions.moments``)."""
    cols = columns or ty.numeric_columns(df)
    return pearson_pairs(df, _pairs(cols))


def strong_pairs(corr_long: DataFrame, threshold: float = STRONG_CORR) -> DataFrame:
    """|r| >= threshold, labelled 'Very Strong' (>= .9) or 'Strong'."""
    return corr_long.where(F.abs("value") >= threshold).select(
        F.col("var1").alias("feature_1"),
        F.col("var2").alias("feature_2"),
        F.col("value").alias("correlation"),
        F.abs("value").alias("abs_correlation"),
        F.when(F.abs("value") >= VERY_STRONG_CORR, "Very Strong").otherwise("Strong").alias("strength"),
    )


# ---------------------------------------------------------------- E2 Spearman

def _name_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Replace the int pair id ``pid`` by (var1, var2) names (literal arrays,
    no join)."""
    v1 = F.array(*[F.lit(a) for a, _ in pairs])
    v2 = F.array(*[F.lit(b) for _, b in pairs])
    rest = [c for c in df.columns if c != "pid"]
    return df.select(F.element_at(v1, F.col("pid") + 1).alias("var1"), F.element_at(v2, F.col("pid") + 1).alias("var2"), *rest)


def numeric_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pid, a, b, o): counts of each distinct numeric value pair over the
    pair-complete rows of every pair (one explode, one aggregation keyed by an
    int pair id)."""
    structs = [
        F.struct(F.lit(i).alias("pid"), ty.numeric_value(df, a).alias("a"), ty.numeric_value(df, b).alias("b"))
        for i, (a, b) in enumerate(pairs)
    ]
    return (
        df.select(F.explode(F.array(*structs)).alias("_p"))
        .select("_p.*")
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pid", "a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("o"))
    )


def spearman(df: DataFrame, columns: list[str] | None = None, batch: int = PAIR_BATCH) -> DataFrame:
    """Spearman rho of every numeric pair with pairwise deletion.

    Columns without a missing value have one ranking, whatever the pair: they
    are ranked all at once (see :func:`ranked_rows`), and rho is the Pearson r
    of the rank columns. So have the pairs of one column with missing values
    with columns that have none (from ``RANKED_PAIRS`` pairs on), over its own
    rows. Other pairs are ranked over their complete rows, from the counts of
    distinct value pairs, ``batch`` pairs at a time."""
    cols = columns or ty.numeric_columns(df)
    pairs = _pairs(cols)
    if not pairs:
        return df.sparkSession.createDataFrame([], _pair_schema())
    holes = df.agg(*[F.count_if(ty.numeric_value(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    gaps = [c for i, c in enumerate(cols) if holes[f"n{i}"]]
    by_gaps: dict = {}
    for p in pairs:
        by_gaps.setdefault(tuple(c for c in p if c in gaps), []).append(p)
    out, rest = [], []
    for missing, some in by_gaps.items():
        if len(missing) < 2 and len(some) >= len(missing) * RANKED_PAIRS:
            complete = df.where(ty.numeric_value(df, missing[0]).isNotNull()) if missing else df
            used = list(dict.fromkeys(c for p in some for c in p))
            name = {c: f"r{i}" for i, c in enumerate(used)}
            r = pairwise_pearson(materialize(ranked_rows(complete, used)), [(name[a], name[b]) for a, b in some])
            out.append(df.sparkSession.createDataFrame([(a, b, r[(name[a], name[b])]) for a, b in some], _pair_schema()))
        else:
            rest += some
    out += [_spearman_cells(df, rest[i:i + batch]) for i in range(0, len(rest), batch)]
    return _union(out)


def ranked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row of ``df`` with ``r0``, ``r1``, ...: the average ranks of
    the values of ``columns`` (none of them missing).

    Values are cut into blocks (see ``functions.blocks``); counts of the blocks
    rank all rows whose block has one value, without a sort. For up to
    ``RANK_PASSES`` columns with other blocks the rows are dealt out once a
    column, by its blocks, and ranked there; more columns are ranked by one
    sort of their long form."""
    rows = materialize(df.select(*[ty.numeric_value(df, c).alias(f"v{i}") for i, c in enumerate(columns)]))
    found = cut_points(rows, rows.columns)
    cuts = [found[c] for c in rows.columns]
    counts = block_counts(rows, cuts)
    several = [i for i, n in enumerate(counts) if n[::2].any()]
    if len(several) > RANK_PASSES:
        return _ranked_long(df, columns)
    before = [n.cumsum() - n for n in counts]
    single = [b + (n + 1) / 2.0 for b, n in zip(before, counts, strict=True)]
    schema = ", ".join(f"v{i} double" for i in range(len(columns)))
    few = [i for i in range(len(columns)) if i not in several]

    def known(batches):
        for batch in batches:
            v = doubles(batch)
            for i in few:
                v[i] = single[i][block_of(v[i], cuts[i])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in v], names=batch.schema.names)

    if few:
        rows = rows.mapInArrow(known, schema)
    for i in several:
        rows = _ranked_in_blocks(rows, i, cuts[i], before[i], single[i], schema)
    return rows.toDF(*[f"r{i}" for i in range(len(columns))])


def _ranked_in_blocks(rows: DataFrame, i: int, cuts, before, single, schema: str) -> DataFrame:
    """``rows`` with the values of column ``i`` replaced by their ranks; rows in
    blocks of one value have theirs and are spread evenly."""

    def mark(batches):
        for batch in batches:
            v = doubles(batch)
            b = block_of(v[i], cuts)
            alone = b % 2 == 1
            v[i] = np.where(alone, single[b], v[i])
            b = np.where(alone, -1 - np.arange(len(b)) % (len(cuts) + 1), b)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in v), pa.array(b.astype("int32"))], names=[*batch.schema.names, "b"])

    def solve(group: pa.Table) -> pa.Table:
        b = group.column("b")[0].as_py()
        group = group.drop_columns(["b"])
        if b < 0:
            return group
        _, at, n = np.unique(doubles(group)[i], return_inverse=True, return_counts=True)
        rank = before[b] + n.cumsum() - (n - 1) / 2.0
        return group.set_column(i, f"v{i}", pa.array(rank[at]))

    return rows.mapInArrow(mark, schema + ", b int").groupBy("b").applyInArrow(solve, schema)


def _ranked_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`ranked_rows` for many columns.

    All columns are ranked by one sort of their long form (column, value, row
    id), cut into even ranges by all three, so a value that a third of the rows
    share covers several ranges. A range's rows get their place by windows
    inside the range; the counts of rows in earlier ranges, and of the values
    that lie at the ends of ranges (at most two a range and column, so a small
    table), make it a rank of the whole column. The ranks are put together
    again by row id: one shuffle each way, whatever the number of columns."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = materialize(df.select(F.monotonically_increasing_id().alias("id"), *[ty.numeric_value(df, c).alias(f"v{i}") for i, c in enumerate(columns)]))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(len(columns))]))
    long = rows.select("id", cells.alias("_c")).select("id", "_c.*")
    long = materialize(long.repartitionByRange(parts, "c", "v", "id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "c").orderBy("v")
    same = Window.partitionBy("part", "c", "v")
    own = long.select("id", "c", "v", "part", F.rank().over(inside).alias("lo"), F.count(F.lit(1)).over(same).alias("n"))
    # a range has a column's values between these two
    ends = long.groupBy("c", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = materialize(ends.select("c", "part", "rows", "least", "most", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")))
    edge = ends.select("c", F.explode(F.array_distinct(F.array("least", "most"))).alias("v")).distinct()
    edges = long.join(F.broadcast(edge), ["c", "v"]).groupBy("c", "v", "part").agg(F.count(F.lit(1)).alias("n"))
    edges = edges.groupBy("c", "v").agg(F.sum("n").alias("edge_n"), F.min_by("n", "part").alias("first_n"), F.min("part").alias("part")).join(ends, ["c", "part"])
    # in its first range such a value is the least one or the last one
    smaller = F.when(F.col("v") == F.col("least"), 0).otherwise(F.col("rows") - F.col("first_n"))
    edges = edges.select("c", "v", (F.col("before") + smaller + 1 + (F.col("edge_n") - 1) / 2.0).alias("edge_rank"))
    ranked = own.join(F.broadcast(ends.select("c", "part", "before")), ["c", "part"]).join(F.broadcast(edges), ["c", "v"], "left")
    rank = F.coalesce("edge_rank", F.col("before") + F.col("lo") + (F.col("n") - 1) / 2.0)
    return ranked.groupBy("id").agg(*[F.max(F.when(F.col("c") == i, rank)).alias(f"r{i}") for i in range(len(columns))])


def _spearman_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman rho over the complete rows of each pair: the marginal counts of
    the pair's cells give the ranks, and rho is sum o * (ra - m)(rb - m) /
    sqrt(...) with m = (n + 1) / 2."""
    cells = materialize(numeric_cells(df, pairs))
    ra = average_ranks(cells.groupBy("pid", "a").agg(F.sum("o").alias("count")), ["pid"], "a").select("pid", "a", F.col("rank").alias("ra"), F.col("total_count").alias("n"))
    rb = average_ranks(cells.groupBy("pid", "b").agg(F.sum("o").alias("count")), ["pid"], "b").select("pid", "b", F.col("rank").alias("rb"))
    m = (F.col("n") + 1) / 2.0
    da, db = F.col("ra") - m, F.col("rb") - m
    agg = cells.join(ra, ["pid", "a"]).join(rb, ["pid", "b"]).groupBy("pid").agg(
        F.sum(F.col("o") * da * db).alias("sab"), F.sum(F.col("o") * da * da).alias("saa"), F.sum(F.col("o") * db * db).alias("sbb"),
        F.sum("o").alias("n"),
    )
    rho = F.when((F.col("saa") > 0) & (F.col("sbb") > 0) & (F.col("n") >= 2), F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb")))
    return _named(df, pairs, agg.select("pid", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("value")))


def _named(df: DataFrame, pairs: list[tuple[str, str]], values: DataFrame) -> DataFrame:
    """Every pair with its values; pairs without a complete row stay NULL."""
    want = df.sparkSession.createDataFrame([(i,) for i in range(len(pairs))], "pid int")
    return _name_pairs(want.join(values, "pid", "left"), pairs)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]], values: dict | None = None) -> DataFrame:
    """(var1, var2, value) Pearson r of the given pairs."""
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], _pair_schema())
    r = pairwise_pearson(df, pairs, values)
    return spark.createDataFrame([(a, b, r[(a, b)]) for a, b in pairs], _pair_schema())


# ---------------------------------------------------------------- E3 Kendall

def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], batch: int = KENDALL_BATCH) -> DataFrame:
    """Kendall tau-b of numeric pairs (pairwise deletion), exact, ``batch``
    columns in one plan."""
    if not pairs:
        return df.sparkSession.createDataFrame([], _pair_schema())
    return _kendall(df, pairs, batch)


def _kendall(df: DataFrame, pairs: list[tuple[str, str]], batch: int) -> DataFrame:
    """S = 2 C - (n0 - n1 - n2 + n3) with C the concordant pairs of rows, n0
    all of them, n1, n2 and n3 those tied in x, in y and in both.

    Each column's values are cut into blocks (see ``functions.blocks``). Two
    concordant rows lie in different blocks of both columns, which a table of
    counts by blocks answers, or in one block of x, or in one block of y and
    different ones of x. So each row goes to one task a column, the rows of
    that block of the column, ``batch`` columns in one plan; no pairs of rows
    or distinct value pairs are ever formed."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(cols)}
    ij = [(at[a], at[b]) for a, b in pairs]
    rows = materialize(df.select(*[ty.numeric_value(df, c).alias(f"v{i}") for i, c in enumerate(cols)]))
    found = cut_points(rows, rows.columns)
    cuts = [found[c] for c in rows.columns]
    several, total = set(), [[0, 0, 0, 0, 0] for _ in pairs]
    tables = _block_tables(rows, ij, cuts)
    for r in tables.collect():  # one row a pair
        i, j = ij[r["pid"]]
        several |= ({i} if r["x_several"] else set()) | ({j} if r["y_several"] else set())
        total[r["pid"]] = [r["n"], r["c"], r["n1"], r["n2"], r["n3"]]
    todo = sorted(several)
    for k in range(0, len(todo), batch):
        parts = _union([_in_blocks(rows, i, ij, cuts) for i in todo[k:k + batch]])
        wide = "decimal(38,0)"
        for r in parts.groupBy("pid").agg(*[F.sum(F.col(c).cast(wide)).alias(c) for c in ("c", "n1", "n2", "n3")]).collect():
            for m, c in enumerate(("c", "n1", "n2", "n3"), 1):
                total[r["pid"]][m] += int(r[c])
    out = []
    for (a, b), (n, c, n1, n2, n3) in zip(pairs, total, strict=True):
        n0 = n * (n - 1) // 2
        scale = (n0 - n1) * (n0 - n2)
        out.append((a, b, (2 * c - (n0 - n1 - n2 + n3)) / math.sqrt(scale) if scale > 0 else None))
    return df.sparkSession.createDataFrame(out, _pair_schema())


def _block_tables(rows: DataFrame, ij: list[tuple[int, int]], cuts: list) -> DataFrame:
    """Per pair: its complete rows, the concordant pairs of rows in different
    blocks of both columns, ties in blocks of one value (n3: of both), and
    whether there are rows in blocks of several values."""
    size = [2 * len(c) + 1 for c in cuts]

    def count(batches):
        sums = {}
        for batch in batches:
            b = [block_of(v, c) for v, c in zip(doubles(batch), cuts, strict=True)]
            for pid, (i, j) in enumerate(ij):
                both = (b[i] >= 0) & (b[j] >= 0)
                t = np.bincount(b[i][both] * size[j] + b[j][both], minlength=size[i] * size[j])
                sums[pid] = sums[pid] + t if pid in sums else t
        for pid, t in sums.items():
            cell = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), pid, dtype="int32")), pa.array(cell.astype("int64")), pa.array(t[cell].astype("int64"))], names=["pid", "cell", "n"])

    def add(group: pa.Table) -> pa.Table:
        pid = group.column("pid")[0].as_py()
        i, j = ij[pid]
        t = np.zeros(size[i] * size[j], dtype="int64")
        t[group.column("cell").to_numpy()] = group.column("n").to_numpy()
        t = t.reshape(size[i], size[j])
        tied = lambda k: int((k * (k - 1) // 2).sum())
        values = [pid, int(t.sum()), smaller_in_both(t), tied(t.sum(axis=1)[1::2]), tied(t.sum(axis=0)[1::2]), tied(t[1::2, 1::2]), bool(t[::2].any()), bool(t[:, ::2].any())]
        return pa.table({c: [v] for c, v in zip(("pid", "n", "c", "n1", "n2", "n3", "x_several", "y_several"), values, strict=True)})

    cells = rows.mapInArrow(count, "pid int, cell long, n long").groupBy("pid", "cell").agg(F.sum("n").alias("n"))
    return cells.groupBy("pid").applyInArrow(add, "pid long, n long, c long, n1 long, n2 long, n3 long, x_several boolean, y_several boolean")


def _in_blocks(rows: DataFrame, i: int, ij: list[tuple[int, int]], cuts: list) -> DataFrame:
    """(pid, c, n1, n2, n3) of each block of several values of column ``i``,
    for the pairs it belongs to. As x: all pairs of the block's rows. As y:
    concordant pairs of rows in different blocks of x, and rows tied in both
    where the block of x has one value."""
    mine = [(pid, p) for pid, p in enumerate(ij) if i in p]
    need = sorted({c for _, p in mine for c in p})
    place = {c: k for k, c in enumerate(need)}

    def mark(batches):
        for batch in batches:
            b = block_of(doubles(batch)[place[i]], cuts[i])
            kept = pa.array(b % 2 == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b.astype("int32"))], names=[*batch.schema.names, "b"]).filter(kept)

    def solve(group: pa.Table) -> pa.Table:
        v = doubles(group.drop_columns(["b"]))
        v = [c[np.argsort(v[place[i]], kind="stable")] for c in v]
        own, out = v[place[i]], []
        for pid, (a, b) in mine:
            other = v[place[b if a == i else a]]
            there = ~np.isnan(other)
            x, y = own[there], other[there]
            if a == i:
                out.append((pid, concordant(x, y), ties(x), 0, ties(y, x)))
            else:
                block = block_of(y, cuts[a])
                single = block % 2 == 1
                out.append((pid, concordant(block, x), 0, ties(x), ties(y[single], x[single])))
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["pid", "c", "n1", "n2", "n3"])

    marked = rows.select(*[f"v{c}" for c in need]).mapInArrow(mark, ", ".join(f"v{c} double" for c in need) + ", b int")
    return marked.groupBy("b").applyInArrow(solve, "pid long, c long, n1 long, n2 long, n3 long")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """E3 for one pair."""
    return kendall_pairs(df, [(x, y)])


def kendall_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """E3 for every numeric pair (upper triangle), one plan."""
    return kendall_pairs(df, _pairs(columns or ty.numeric_columns(df)))


# ---------------------------------------------------------------- contingency family

def _cat_value(df: DataFrame, c: str, missing_label: str | None) -> Column:
    v = ty.clean_col(df, c).cast("string")
    return F.coalesce(v, F.lit(missing_label)) if missing_label is not None else v


def contingency(df: DataFrame, pairs: list[tuple[str, str]], missing_label: str | None = None) -> DataFrame:
    """(var1, var2, a, b, o): counts of every value combination of every pair;
    rows with a NULL in the pair are dropped (unless ``missing_label`` turns
    NULL into a level)."""
    return _name_pairs(_level_cells(df, pairs, missing_label, coded=False), pairs)


def _level_cells(df: DataFrame, pairs: list[tuple[str, str]], missing_label: str | None = None, coded: bool = True) -> DataFrame:
    """(pid, a, b, o): one explode and one aggregation keyed by an int pair id.
    ``coded`` levels are whole numbers as they are and 64-bit hashes of other values:
    statistics only compare levels, so long texts are neither repeated per pair nor shuffled."""
    level = {c: _cat_value(df, c, missing_label) for p in pairs for c in p}
    name = {c: f"c{i}" for i, c in enumerate(level)}

    def code(c: str, v: Column) -> Column:
        if coded and missing_label is None and df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long"):
            return F.col(f"`{c}`").cast("long")
        return F.when(v.isNotNull(), F.xxhash64(v)) if coded else v

    coded_rows = df.select(*[code(c, v).alias(name[c]) for c, v in level.items()])
    structs = [F.struct(F.lit(i).alias("pid"), F.col(name[a]).alias("a"), F.col(name[b]).alias("b")) for i, (a, b) in enumerate(pairs)]
    return (
        coded_rows.select(F.explode(F.array(*structs)).alias("_p"))
        .select("_p.*")
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pid", "a", "b")
        .agg(F.count(F.lit(1)).alias("o"))
    )


def chi_square_pairs(df: DataFrame, pairs: list[tuple[str, str]], missing_label: str | None = None, yates: bool = True, batch: int = PAIR_BATCH) -> DataFrame:
    """(var1, var2, chi2, n, r, c, dof) of every pair with a complete row,
    ``batch`` pairs at a time, so that one explode multiplies rows by at most
    ``batch``."""
    parts = []
    for i in range(0, len(pairs), batch):
        some = pairs[i:i + batch]
        parts.append(_name_pairs(_chi_square(_level_cells(df, some, missing_label), ["pid"], yates), some))
    return _union(parts)


def chi_square(cells: DataFrame, yates: bool = True) -> DataFrame:
    """(var1, var2, chi2, n, r, c, dof) per pair from long contingency cells."""
    return _chi_square(cells, ["var1", "var2"], yates)


def _chi_square(cells: DataFrame, key: list[str], yates: bool) -> DataFrame:
    """chi2 = n * (sum o^2/(row*col) - 1) needs only the non-empty cells. For a
    2x2 table with ``yates`` the continuity correction is applied over the
    full 2x2 grid (empty cells included), as SciPy does."""
    cells = materialize(cells)
    rows = cells.groupBy(*key, "a").agg(F.sum("o").alias("ra"))
    colsm = cells.groupBy(*key, "b").agg(F.sum("o").alias("cb"))
    sums = cells.join(rows, [*key, "a"]).join(colsm, [*key, "b"]).groupBy(*key).agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s")
    )
    per_pair = sums.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("r")), key).join(colsm.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key)
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    plain = per_pair.select(*key, "n", "r", "c", (F.col("n") * (F.col("s") - 1)).alias("chi2_plain"))
    if not yates:
        return plain.select(*key, F.col("chi2_plain").alias("chi2"), "n", "r", "c", dof.alias("dof"))
    # full grid for the 2x2 pairs only (4 cells per such pair)
    two = plain.where((F.col("r") == 2) & (F.col("c") == 2)).select(*key, "n")
    grid = rows.join(two, key).join(colsm, key)
    grid = grid.join(cells, [*key, "a", "b"], "left").withColumn("o", F.coalesce(F.col("o"), F.lit(0)))
    e = F.col("ra") * F.col("cb") / F.col("n")
    d = F.abs(F.col("o") - e)
    term = F.pow(d - F.least(F.lit(0.5), d), 2) / e
    yts = grid.groupBy(*key).agg(F.sum(term).alias("chi2_yates"))
    return plain.join(yts, key, "left").select(*key, F.coalesce(F.col("chi2_yates"), F.col("chi2_plain")).alias("chi2"), "n", "r", "c", dof.alias("dof"))


def cramers_v_from_chi2(chi: DataFrame) -> DataFrame:
    k = F.least(F.col("r"), F.col("c")) - 1
    return chi.select(
        "var1", "var2", F.when(k <= 0, F.lit(0.0)).otherwise(F.sqrt(F.col("chi2") / (F.col("n") * k))).alias("value")
    )


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """E5: Cramer's V of one pair (NULL rows dropped, Yates on 2x2)."""
    return cramers_v_from_chi2(chi_square_pairs(df, [(a, b)]))


def cramers_v_matrix(df: DataFrame, columns: list[str] | None = None, missing_label: str | None = None, batch: int = PAIR_BATCH) -> DataFrame:
    """Cramer's V for every categorical pair (upper triangle)."""
    pairs = _pairs(columns or ty.categorical_columns(df))
    if not pairs:
        return df.sparkSession.createDataFrame([], _pair_schema())
    return cramers_v_from_chi2(chi_square_pairs(df, pairs, missing_label, batch=batch))


def strong_associations(v_long: DataFrame, threshold: float = STRONG_ASSOC) -> DataFrame:
    """V >= .5; 'Very Strong' from .8."""
    return v_long.where(F.col("value") >= threshold).select(
        F.col("var1").alias("variable_1"),
        F.col("var2").alias("variable_2"),
        F.col("value").alias("cramers_v"),
        F.when(F.col("value") >= VERY_STRONG_ASSOC, "Very Strong").otherwise("Strong").alias("strength"),
    )


def chi_square_test(df: DataFrame, columns: list[str] | None = None, yates: bool = True, with_p: bool = False) -> DataFrame:
    """chi2, dof and n per categorical pair (optionally the p-value,
    computed on the per-pair rows)."""
    cols = columns or ty.categorical_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, chi2 double, dof long, n long" + (", p_value double" if with_p else ""))
    chi = chi_square_pairs(df, _pairs(cols), yates=yates).select("var1", "var2", "chi2", "dof", "n")
    if not with_p:
        return chi
    return chi.withColumn("p_value", chi2_pvalue_udf(F.col("chi2"), F.col("dof").cast("double")))


# ---------------------------------------------------------------- E9 / E10 ANOVA, point-biserial

ANOVA_NUMERIC_BATCH = 12  # numerics per grouped aggregation (keeps codegen on)


def anova_moments(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(numeric, categorical, level, n, mean, var_pop) for every pair and
    level: one explode over the categoricals and a grouped aggregation with
    the numeric columns' moments, ANOVA_NUMERIC_BATCH numerics at a time."""
    if len(numeric) > ANOVA_NUMERIC_BATCH:
        parts = [anova_moments(df, numeric[i:i + ANOVA_NUMERIC_BATCH], categorical) for i in range(0, len(numeric), ANOVA_NUMERIC_BATCH)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    structs = [F.struct(F.lit(c).alias("categorical"), ty.clean_col(df, c).cast("string").alias("level")) for c in categorical]
    num_vals = [ty.numeric_value(df, c).alias(f"_n{i}") for i, c in enumerate(numeric)]
    x = df.select(F.explode(F.array(*structs)).alias("_g"), *num_vals).select("_g.*", *[f"_n{i}" for i in range(len(numeric))])
    x = x.where(F.col("level").isNotNull())
    aggs = []
    for i in range(len(numeric)):
        v = F.col(f"_n{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    g = x.groupBy("categorical", "level").agg(*aggs)
    return g.select(
        "categorical",
        "level",
        F.explode(F.array(*[F.struct(F.lit(c).alias("numeric"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")) for i, c in enumerate(numeric)])).alias("_s"),
    ).select("_s.numeric", "categorical", "level", "_s.n", "_s.mean", "_s.var").where(F.col("n") > 0)


def anova_f(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """One-way ANOVA F (and p) for every numeric x categorical pair;
    pairs with < 10 complete rows or < 2 groups are skipped."""
    num = numeric or ty.numeric_columns(df)
    cat = categorical or ty.categorical_columns(df)
    spark = df.sparkSession
    if not num or not cat:
        return spark.createDataFrame([], "numeric_variable string, categorical_variable string, f_statistic double, p_value double, significant boolean")
    m = anova_moments(df, num, cat)
    tot = m.groupBy("numeric", "categorical").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_groups"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm")
    )
    j = m.join(tot, ["numeric", "categorical"])
    ss = j.groupBy("numeric", "categorical", "n_total", "n_groups").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gm"), 2)).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"),
    ).where((F.col("n_total") >= ANOVA_MIN_ROWS) & (F.col("n_groups") >= 2))
    f = F.try_divide(F.col("ssb") / (F.col("n_groups") - 1), F.col("ssw") / (F.col("n_total") - F.col("n_groups")))
    out = ss.select(
        F.col("numeric").alias("numeric_variable"),
        F.col("categorical").alias("categorical_variable"),
        f.alias("f_statistic"),
        (F.col("n_groups") - 1).cast("double").alias("df_between"),
        (F.col("n_total") - F.col("n_groups")).cast("double").alias("df_within"),
    )
    if not with_p:
        return out.drop("df_between", "df_within")
    p = f_pvalue_udf(F.col("f_statistic"), F.col("df_between"), F.col("df_within"))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < ANOVA_ALPHA).drop("df_between", "df_within")


def anova_f_score(df: DataFrame, numeric: str, categorical: str) -> DataFrame:
    """Single pair F, 0.0 when fewer than 2 groups (no row-count gate)."""
    m = anova_moments(df, [numeric], [categorical])
    tot = m.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_groups"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm"))
    j = m.crossJoin(tot)
    ss = j.groupBy("n_total", "n_groups").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gm"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw")
    )
    f = F.try_divide(F.col("ssb") / (F.col("n_groups") - 1), F.col("ssw") / (F.col("n_total") - F.col("n_groups")))
    return ss.select(F.when(F.col("n_groups") < 2, F.lit(0.0)).otherwise(f).alias("f_statistic"))


def point_biserial(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None) -> DataFrame:
    """For each categorical with exactly two levels, Pearson r of the
    indicator of the larger level with each numeric column (NULL category
    rows dropped)."""
    num = numeric or ty.numeric_columns(df)
    cat = categorical or ty.categorical_columns(df)
    # exactly two levels, without count_distinct (several of them expand the rows):
    # min != max, and no value other than min and max (two narrow passes)
    mm = df.agg(*[x for i, c in enumerate(cat) for x in (F.min(ty.clean_col(df, c)).alias(f"mn{i}"), F.max(ty.clean_col(df, c)).alias(f"mx{i}"))]).first()
    two = [(i, c) for i, c in enumerate(cat) if mm[f"mn{i}"] is not None and mm[f"mn{i}"] != mm[f"mx{i}"]]
    binary = []
    if two:
        other = df.agg(*[F.count_if(~ty.clean_col(df, c).isin(mm[f"mn{i}"], mm[f"mx{i}"])).alias(f"o{i}") for i, c in two]).first()
        binary = [(c, mm[f"mx{i}"]) for i, c in two if other[f"o{i}"] == 0]
    spark = df.sparkSession
    if not binary or not num:
        return spark.createDataFrame([], "numeric_variable string, categorical_variable string, correlation double")
    values, pairs, meta = {}, [], []
    for c, top in binary:
        ind = f"__ind_{c}"
        values[ind] = F.when(ty.clean_col(df, c).isNull(), F.lit(None)).otherwise((ty.clean_col(df, c) == F.lit(top)).cast("double"))
        for nm in num:
            values.setdefault(nm, ty.numeric_value(df, nm))
            pairs.append((ind, nm))
            meta.append((nm, c))
    r = pairwise_pearson(df, pairs, values)
    return spark.createDataFrame([(nm, c, r[p]) for (nm, c), p in zip(meta, pairs)], "numeric_variable string, categorical_variable string, correlation double")


# ---------------------------------------------------------------- E11-E13 mutual information

def as_numeric_view(df: DataFrame) -> DataFrame:
    """Datetime columns as epoch seconds (double), others unchanged - the
    form in which dates take part in mutual information."""
    out = []
    for f in df.schema.fields:
        if ty.family(f.dataType) == ty.DATETIME:
            out.append((F.unix_micros(F.col(f"`{f.name}`").cast("timestamp")) / 1e6).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def discretise(
    df: DataFrame,
    columns: list[str] | None = None,
    bins: int = MI_BINS,
    fill: bool = True,
    raw: list[str] = (),
    raw_copies: dict[str, str] | None = None,
) -> DataFrame:
    """Columns as discrete levels: numerics (dates as epoch seconds) as the int
    of one of ``bins`` equal-frequency bins (bin = number of decile cut points
    strictly below the value), all others as text; with ``fill`` NULLs are
    median/mode filled first. Columns in ``raw`` keep their (filled) values
    instead of bins; ``raw_copies`` (column -> name) adds the values under that
    name next to the binned column. Cut points are one exact-quantile job (columns x
    (bins-1) rows reach the driver)."""
    from .clean import fill_median_mode

    src = as_numeric_view(df)
    cols = columns or [c for c in ty.profilable_columns(src) if ty.family(src.schema[c].dataType) in (ty.NUMERIC, ty.STRING)]
    num = [c for c in cols if ty.family(src.schema[c].dataType) == ty.NUMERIC and c not in raw]
    probs = [i / bins for i in range(1, bins)]
    nulls = {c: 0 for c in cols}
    if fill:
        row = src.agg(*[F.count_if(ty.clean_col(src, c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        nulls = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    cuts: dict[str, list] = {}
    # columns without NULLs: deciles straight away (filling changes nothing);
    # the medians of NULL-bearing columns come out of the same quantile pass
    holey = [c for c in cols if ty.family(src.schema[c].dataType) == ty.NUMERIC and nulls[c] > 0]
    first = [c for c in num if nulls[c] == 0] + holey
    med = {}
    if first:
        for row in exact_quantiles(src, first, sorted(set(probs) | {0.5})).collect():
            if row["column"] in holey:
                if row["prob"] == 0.5:
                    med[row["column"]] = row["value"]
            elif row["prob"] in probs:
                cuts.setdefault(row["column"], []).append((row["prob"], row["value"]))
    base = fill_median_mode(src.select(*[F.col(f"`{c}`") for c in cols]), medians_known=med, nulls_known=nulls) if fill else src.select(*[F.col(f"`{c}`") for c in cols])
    second = [c for c in num if c in holey]
    if second:
        for row in exact_quantiles(base, second, probs).collect():
            cuts.setdefault(row["column"], []).append((row["prob"], row["value"]))
    # each value is worked out once, then looked up among its column's cut points
    values = [(ty.numeric_value(base, c) if c in cuts else ty.clean_col(base, c).cast("string")).alias(c) for c in cols]
    copies = [ty.clean_col(base, c).cast("string").alias(name) for c, name in (raw_copies or {}).items()]
    sel = []
    for c in cols:
        v = F.col(f"`{c}`")
        if c in cuts:
            pts = sorted(p for _, p in cuts[c] if p is not None)
            v = F.when(v.isNotNull(), _cuts_below(v, pts)).alias(c)
        sel.append(v)
    return base.select(*values, *copies).select(*sel, *[F.col(f"`{name}`") for name in (raw_copies or {}).values()])


def _cuts_below(v: Column, points: list[float], first: int = 0) -> Column:
    """Number of sorted cut points strictly below ``v``, by halving."""
    if not points:
        return F.lit(first)
    mid = len(points) // 2
    return F.when(v > F.lit(points[mid]), _cuts_below(v, points[mid + 1:], first + mid + 1)).otherwise(_cuts_below(v, points[:mid], first))


def mi_pairs(d: DataFrame, pairs: list[tuple[str, str]], batch: int = PAIR_BATCH) -> DataFrame:
    """Plug-in MI (nats) per pair of discrete columns: sum o/n * ln(o*n/(row*col)),
    ``batch`` pairs at a time."""
    parts = []
    for i in range(0, len(pairs), batch):
        some = pairs[i:i + batch]
        cells = materialize(_level_cells(d, some))
        rows = cells.groupBy("pid", "a").agg(F.sum("o").alias("ra"))
        colsm = cells.groupBy("pid", "b").agg(F.sum("o").alias("cb"))
        n = cells.groupBy("pid").agg(F.sum("o").alias("n"))
        # sum o/n ln(o n / (ra cb)) = (sum o ln o - sum ra ln ra - sum cb ln cb) / n + ln n: three marginal sums, no join of cells
        xlogx = lambda f, c: f.groupBy("pid").agg(F.sum(F.col(c) * F.log(F.col(c))).alias(f"l_{c}"))
        sums = n.join(xlogx(cells, "o"), "pid").join(xlogx(rows, "ra"), "pid").join(xlogx(colsm, "cb"), "pid")
        value = (F.col("l_o") - F.col("l_ra") - F.col("l_cb")) / F.col("n") + F.log("n")
        parts.append(_name_pairs(sums.select("pid", F.greatest(value, F.lit(0.0)).alias("value")), some))
    return _union(parts)


def pairwise_mi(df: DataFrame, columns: list[str] | None = None, bins: int = MI_BINS, batch: int = PAIR_BATCH) -> DataFrame:
    """MI for every column pair (upper triangle) after median/mode fill,
    numerics in equal-frequency bins."""
    d = discretise(df, columns, bins)
    pairs = _pairs(d.columns)
    if not pairs:
        return df.sparkSession.createDataFrame([], _pair_schema())
    return mi_pairs(d, pairs, batch)


def top_mi_pairs(mi_long: DataFrame, k: int = 10) -> DataFrame:
    """Top-k pairs by MI (ties by names)."""
    return mi_long.orderBy(F.col("value").desc(), "var1", "var2").limit(k)


def infer_mi_task(df: DataFrame, target: str) -> str:
    """classification when the target is text or has <= min(20, 5 % of rows)
    distinct values, else regression."""
    if ty.family(df.schema[target].dataType) == ty.STRING:
        return "classification"
    row = df.agg(F.count_distinct(ty.clean_col(df, target)).alias("u"), F.count(F.lit(1)).alias("n")).first()
    return "classification" if row["u"] <= min(20, 0.05 * row["n"]) else "regression"


def mi_to_target(df: DataFrame, target: str, features: list[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """MI of each feature with ``target`` -> (feature, mi, task). For a
    classification target the classes are its own values (not bins)."""
    feats = features or [c for c in ty.profilable_columns(df) if c != target and ty.family(df.schema[c].dataType) in (ty.NUMERIC, ty.STRING)]
    task = infer_mi_task(df, target)
    d = discretise(df, feats + [target], bins, raw=[target] if task == "classification" else [])
    mi = mi_pairs(d, [(f, target) for f in feats])
    return mi.select(F.col("var1").alias("feature"), F.col("value").alias("mi"), F.lit(task).alias("task"))


# ---------------------------------------------------------------- E14-E16 VIF, summary

def gram(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """Uncentred cross-product matrix sum(x_i * x_j) of complete columns, in
    one scan whatever their number."""
    m = co_moments(df, [F.col(f"`{c}`") for c in cols])

    def product(v: dict) -> float:
        return v["sab"] + v["n"] * v["mean_a"] * v["mean_b"] if v["n"] else 0.0

    return [[product(m[(min(i, j), max(i, j))]) for j in range(len(cols))] for i in range(len(cols))]


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """VIF per numeric column (no intercept, so R^2 is uncentred):
    zero-variance columns dropped, NULLs median-filled, then
    VIF_i = G_ii * (G^-1)_ii from the p x p Gram matrix, scaled to a unit
    diagonal first. Only the columns that take part in an exact linear
    dependence are infinite; the others come from the pseudo-inverse."""
    import numpy as np

    from .clean import medians

    cols = columns or ty.numeric_columns(df)
    spark = df.sparkSession
    schema = "feature string, vif double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    var = batched_agg(df, [(c, F.var_samp(ty.numeric_value(df, c))) for c in cols])
    keep = [c for c in cols if var[c] is not None and var[c] > 0]
    if len(keep) < 2:
        return spark.createDataFrame([], schema)
    med = medians(df, keep)
    x = df.select(*[F.coalesce(ty.numeric_value(df, c), F.lit(med[c])).alias(f"v{i}") for i, c in enumerate(keep)])
    g = np.array(gram(x, x.columns))
    scale = np.sqrt(np.diag(g))
    root, vec = np.linalg.eigh(g / np.outer(scale, scale))
    null = root <= COLLINEAR_EIGENVALUE * len(keep)
    involved = (np.abs(vec[:, null]) > COLLINEAR_SHARE).any(axis=1)
    inverse = (vec[:, ~null] ** 2 / root[~null]).sum(axis=1)
    return spark.createDataFrame([(c, float("inf") if bad else float(v)) for c, bad, v in zip(keep, involved, inverse)], schema)


def multicollinear_columns(vif_df: DataFrame, threshold: float = VIF_HIGH) -> DataFrame:
    """E15"""
    return vif_df.where(F.col("vif") > threshold)


def relationship_summary(df: DataFrame) -> DataFrame:
    """Counts of features by type, strong Pearson / Spearman pairs,
    high-VIF columns, strong associations, significant ANOVAs -> (item, value)."""
    num = ty.numeric_columns(df)
    cat = ty.categorical_columns(df)
    spark = df.sparkSession
    items = [("total_features", float(len(df.columns))), ("numeric_features", float(len(num))), ("categorical_features", float(len(cat)))]
    base = spark.createDataFrame(items, "item string, value double")
    parts = [base]
    if len(num) >= 2:
        parts.append(strong_pairs(pearson(df, num)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("strong_pearson").alias("item"), "value"))
        parts.append(strong_pairs(spearman(df, num)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("strong_spearman").alias("item"), "value"))
        parts.append(multicollinear_columns(vif(df, num)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("high_vif").alias("item"), "value"))
    if len(cat) >= 2:
        parts.append(strong_associations(cramers_v_matrix(df, cat)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("strong_associations").alias("item"), "value"))
    if num and cat:
        parts.append(anova_f(df, num, cat).where("significant").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("significant_anova").alias("item"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
