"""Distributed cumulative counts over ordered values.

Exact quantiles, average ranks (Spearman), ROC / precision-recall curves and
equal-frequency bins all need "how many rows have a value <= v" for every
distinct v. A plain ``Window.orderBy`` would put a whole group - at worst the
whole table - into one task, so the prefix sums are built in two levels, for
groups of any size alike:

1. rows are range-partitioned by (group, value): a large group covers several
   partitions, many small ones share one. The rows are checkpointed with their
   partition number, so every later branch sees the same ranges;
2. the totals of each (group, partition) - at most groups + partitions rows -
   get a window prefix sum per group, which is the offset of that range;
3. a window over (group, partition) adds the running sum inside the range.

Groups are compared as structs, so a NULL group is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def cumulative_by_value(
    freq: DataFrame,
    group_cols: list[str],
    value_col: str,
    weight_cols: list[str],
    descending: bool = False,
    ties: list[str] = (),
) -> DataFrame:
    """Add ``cum_<w>`` = sum of ``w`` over rows of the same group whose value
    is <= this value (>= when ``descending``), this row included, and
    ``total_<w>`` = the group's sum of ``w``.

    ``freq`` must hold one row per (group, value), or per (group, value,
    *ties): equal values are then taken in the order of ``ties``.
    """
    first = F.col(value_col).desc() if descending else F.col(value_col).asc()
    order = [first, *[F.col(t) for t in ties]]
    parts = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = freq.withColumn("_key", F.struct(*group_cols) if group_cols else F.struct(F.lit(0)))
    dealt = materialize(dealt.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_key", "_part").agg(*[F.sum(w).alias(f"_tot_{w}") for w in weight_cols])
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = totals.select(
        "_key",
        "_part",
        *[F.coalesce(F.sum(f"_tot_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weight_cols],
        *[F.sum(f"_tot_{w}").over(whole).alias(f"total_{w}") for w in weight_cols],
    )
    within = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.select("*", *[F.sum(w).over(within).alias(f"_in_{w}") for w in weight_cols]).join(offsets, ["_key", "_part"])
    for w in weight_cols:
        out = out.withColumn(f"cum_{w}", F.col(f"_off_{w}") + F.col(f"_in_{w}"))
    return out.drop("_key", "_part", *[f"_off_{w}" for w in weight_cols], *[f"_in_{w}" for w in weight_cols])


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, count) over the non-null values of numeric ``columns``
    (aggregated on an int column index, names attached afterwards)."""
    from .types import numeric_value

    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), numeric_value(df, c).alias("v")) for i, c in enumerate(columns)]))
    freq = df.select(cells.alias("_c")).select("_c.*").where(F.col("v").isNotNull()).groupBy("ci", "v").agg(F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.lit(c) for c in columns])
    return freq.select(F.element_at(names, F.col("ci") + 1).alias("column"), "v", "count")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / SQL
    ``percentile_cont``) for every column and probability.

    Returns (column, prob, value); null value for a column with no data.
    A distinct value covers the 0-based sorted positions [cum-count, cum-1];
    rows covering floor/ceil of (n-1)*p are kept and interpolated.
    """
    plist = [float(p) for p in probs]
    grid = df.sparkSession.createDataFrame([(c, p) for c in columns for p in plist], "column string, prob double")
    return grid.join(F.broadcast(_quantiles_from_freq(df, columns, plist)), ["column", "prob"], "left")  # columns x probs rows


def _quantiles_from_freq(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    cum = cumulative_by_value(value_frequencies(df, columns), ["column"], "v", ["count"])
    start, end = F.col("cum_count") - F.col("count"), F.col("cum_count") - 1
    picks, wanted = [], F.lit(False)
    for p in probs:
        h = (F.col("total_count") - 1) * float(p)
        lo, hi = F.floor(h), F.ceil(h)
        wanted = wanted | ((start <= lo) & (lo <= end)) | ((start <= hi) & (hi <= end))
        picks.append(
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.when((start <= lo) & (lo <= end), F.col("v")).alias("x_lo"),
                F.when((start <= hi) & (hi <= end), F.col("v")).alias("x_hi"),
                (h - lo).alias("frac"),
            )
        )
    return (
        cum.where(wanted)  # at most two values a probability go on, not every value with every probability
        .select("column", F.explode(F.array(*picks)).alias("_p"))
        .select("column", "_p.*")
        .where(F.col("x_lo").isNotNull() | F.col("x_hi").isNotNull())
        .groupBy("column", "prob")
        .agg(F.max("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), F.max("frac").alias("frac"))
        .select("column", "prob", (F.col("x_lo") + F.col("frac") * (F.col("x_hi") - F.col("x_lo"))).alias("value"))
    )


def average_ranks(freq: DataFrame, group_cols: list[str], value_col: str, count_col: str = "count") -> DataFrame:
    """Average (tie-aware, 1-based) rank of each distinct value in its group."""
    cum = cumulative_by_value(freq, group_cols, value_col, [count_col])
    return cum.withColumn("rank", F.col(f"cum_{count_col}") - (F.col(count_col) - 1) / 2.0)
