"""Distributions: the data behind every chart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.ranking import exact_quantiles

# Class-balance thresholds.
SEVERE_MAJORITY = 0.9
IMBALANCED_MAJORITY = 0.7
MIN_MAX_RATIO_FLAG = 0.3
MANY_CLASSES = 10
DOMINANT_SHARE = 0.8


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, max, skew (G1), kurtosis (G2) per numeric
    column - shifted power sums in codegen-sized passes, finished per column."""
    from ..functions.moments import column_moments

    cols = columns or ty.numeric_columns(df)
    m = column_moments(df, cols)
    rows = [(c, m[c]["count"], m[c]["mean"], m[c]["std"], None if m[c]["min"] is None else float(m[c]["min"]),
             None if m[c]["max"] is None else float(m[c]["max"]), m[c]["skewness"], m[c]["kurtosis"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, max double, skewness double, kurtosis double"
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C4: count, mean, std, min, 25/50/75 % (linear interpolation), max."""
    cols = columns or ty.numeric_columns(df)
    m = moments(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(nm) for p, nm in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return m.join(F.broadcast(qw), "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def shape_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per numeric column."""
    return moments(df, columns).select("column", "skewness", "kurtosis")


def automatic_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Number of bins by the Freedman-Diaconis width 2 IQR / n^(1/3) or the
    Sturges width range / (log2 n + 1), whichever gives more bins (Sturges
    alone where the IQR is 0; one bin where all values are equal)."""
    if n < 1 or high <= low:
        return 1
    width = (high - low) / (math.log2(n) + 1)
    if iqr > 0:
        width = min(width, 2 * iqr / n ** (1 / 3))
    return max(1, math.ceil((high - low) / width))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int | str = 20) -> DataFrame:
    """Equal-width histogram per numeric column; top edge folded into the
    last bin, nulls dropped, empty bins reported with count 0. ``bins="auto"``
    takes each column's number from its size, range and exact IQR (see
    :func:`automatic_bins`)."""
    cols = columns or ty.numeric_columns(df)
    spark = df.sparkSession
    empty = "column string, bin int, bin_start double, bin_end double, count long"
    if not cols:
        return spark.createDataFrame([], empty)
    v = [ty.numeric_value(df, c) for c in cols]
    rng = df.agg(*[x for i in range(len(cols)) for x in (F.min(v[i]).alias(f"lo{i}"), F.max(v[i]).alias(f"hi{i}"), F.count(v[i]).alias(f"n{i}"))]).first()
    known = [i for i in range(len(cols)) if rng[f"lo{i}"] is not None]
    if not known:
        return spark.createDataFrame([], empty)
    if bins == "auto":
        q = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, [cols[i] for i in known], [0.25, 0.75]).collect()}  # two rows a column
        many = {i: automatic_bins(rng[f"n{i}"], rng[f"lo{i}"], rng[f"hi{i}"], q[(cols[i], 0.75)] - q[(cols[i], 0.25)]) for i in known}
    else:
        many = dict.fromkeys(known, int(bins))
    cells = []
    for i in known:
        lo, width = rng[f"lo{i}"], rng[f"hi{i}"] - rng[f"lo{i}"]
        at = F.when(v[i].isNotNull(), F.least(F.floor((v[i] - F.lit(lo)) / F.lit(width) * many[i]), F.lit(many[i] - 1)) if width else F.lit(0))
        cells.append(F.struct(F.lit(i).alias("i"), at.cast("int").alias("bin")))
    # int keys: combined before the shuffle
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("bin").isNotNull()).groupBy("i", "bin").agg(F.count(F.lit(1)).alias("count"))
    ranges = spark.createDataFrame([(i, cols[i], float(rng[f"lo{i}"]), float(rng[f"hi{i}"] - rng[f"lo{i}"]), many[i]) for i in known], "i int, column string, lo double, width double, bins int")
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edge = lambda k: F.col("lo") + k * F.col("width") / F.col("bins")
    return grid.join(counts, ["i", "bin"], "left").select("column", "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int, salt_col: str | None = None, salts: int = 1024) -> DataFrame:
    """Exact top-k rows per group without putting a whole group in one task:
    a first window per (group, hash salt) keeps k candidates per slice, a
    second window over the <= salts*k candidates picks the final k."""
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)) if salt_col else F.lit(0)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    cand = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt", "_r1")


def value_counts_topk(freq: DataFrame, k: int = 10, max_unique: int | None = 20) -> DataFrame:
    """Most frequent non-null values per column (ties by value), only for
    columns with at most ``max_unique`` distinct values when that is given."""
    vals = freq.where(F.col("value").isNotNull())
    if max_unique is not None:
        keep = vals.groupBy("column").agg(F.count(F.lit(1)).alias("_u")).where(F.col("_u") <= max_unique).select("column")
        vals = vals.join(F.broadcast(keep), "column")  # one row per column
    return top_k_per_group(vals, ["column"], [F.col("count").desc(), F.col("value")], k, salt_col="value").select(
        "column", "rank", "value", "count"
    )


def box_stats(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """D3: quartiles, fences, whiskers (extreme values inside the fences) and
    outlier count per numeric column."""
    cols = columns or ty.numeric_columns(df)
    q: dict = {c: {} for c in cols}
    for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect():  # three rows per column
        q[r["column"]][r["prob"]] = r["value"]
    aggs, rows = [], []
    for i, c in enumerate(cols):
        q1, median, q3 = (q[c][p] for p in (0.25, 0.5, 0.75))
        if q1 is None:
            continue
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        v = ty.numeric_value(df, c)
        inside = (v >= F.lit(low)) & (v <= F.lit(high))
        aggs += [F.min(F.when(inside, v)).alias(f"l{i}"), F.max(F.when(inside, v)).alias(f"h{i}"), F.count_if(~inside).alias(f"o{i}")]
        fixed = {"q1": q1, "median": median, "q3": q3, "lower_fence": low, "upper_fence": high}
        rows.append(F.struct(F.lit(c).alias("column"), *[F.lit(float(x)).alias(n) for n, x in fixed.items()], F.col(f"l{i}").alias("whisker_low"), F.col(f"h{i}").alias("whisker_high"), F.col(f"o{i}").alias("outlier_count")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, lower_fence double, upper_fence double, whisker_low double, whisker_high double, outlier_count long")
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, key: str | None = None, fraction: float | None = None) -> DataFrame:
    """(x, y[, color]) points; optional repeatable key-hash sample."""
    out = df
    if fraction is not None and key is not None:
        out = out.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(42)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    sel = [F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")] + ([F.col(f"`{color}`").alias("color")] if color else [])
    return out.select(*sel).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count per class (nulls excluded) and share of non-null rows."""
    v = ty.clean_col(df, target)
    counts = df.where(v.isNotNull()).groupBy(v.alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("class", "count", (F.col("count") / F.col("_total")).alias("share"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Majority share of all rows and its label, min/max count ratio, class
    count and flags (all from one grouped count, classes are few)."""
    v = ty.clean_col(df, target)
    counts = df.groupBy(v.alias("class")).agg(F.count(F.lit(1)).alias("count"))
    summary = counts.agg(
        F.sum("count").alias("n_rows"),
        F.max(F.when(F.col("class").isNotNull(), F.col("count"))).alias("max_count"),
        F.min(F.when(F.col("class").isNotNull(), F.col("count"))).alias("min_count"),
        F.count("class").alias("n_classes"),
        F.sum(F.when(F.col("class").isNotNull(), F.col("count"))).alias("n_labelled"),
    )
    major = F.try_divide(F.col("max_count"), F.col("n_rows"))
    return summary.select(
        "n_classes",
        major.alias("majority_ratio"),
        F.when(major > SEVERE_MAJORITY, "severely_imbalanced").when(major > IMBALANCED_MAJORITY, "imbalanced").otherwise("balanced").alias("class_balance"),
        F.coalesce(F.try_divide(F.col("min_count"), F.col("max_count")), F.lit(1.0)).alias("balance_ratio"),
        (F.coalesce(F.try_divide(F.col("min_count"), F.col("max_count")), F.lit(1.0)) < MIN_MAX_RATIO_FLAG).alias("imbalance_flag"),
        (F.col("n_classes") > MANY_CLASSES).alias("many_classes_flag"),
        (F.try_divide(F.col("max_count"), F.col("n_labelled")) > DOMINANT_SHARE).alias("dominant_class_flag"),
    )


def heatmap_long(pairs: DataFrame, columns: list[str], diagonal: float = 1.0, value_col: str = "value") -> DataFrame:
    """Full symmetric matrix in long form (var1, var2, value) from
    upper-triangle pair rows (var1, var2, value) plus the diagonal."""
    spark = pairs.sparkSession
    up = pairs.select("var1", "var2", F.col(value_col).alias("value"))
    low = up.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "value")
    diag = spark.createDataFrame([(c, c, float(diagonal)) for c in columns], "var1 string, var2 string, value double")
    return up.unionByName(low).unionByName(diag)
