"""Projections, filters and cleanup (B1-B11), quality findings.

Decisions that depend on the data (which columns are constant, medians,
modes) are taken from per-column summary rows - one row per column is all
that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.ranking import cumulative_by_value, exact_quantiles
from ..session import materialize
from . import profile as pr

MISSING_LABEL = "Missing"


def select_by_type(df: DataFrame, family: str = ty.NUMERIC) -> DataFrame:
    """B1: project the columns of one type family ('numeric', 'string', ...)."""
    return df.select(*ty.columns_of(df, family))


def drop_constant_columns(df: DataFrame, profile: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """B2: drop columns with <= 1 distinct non-null value. Returns (df, dropped)."""
    prof = profile if profile is not None else pr.column_profile(df)
    dropped = [r["column"] for r in prof.where("is_constant").select("column").collect()]
    return df.drop(*dropped), dropped


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (NULLs compare equal, as SQL DISTINCT)."""
    return df.dropDuplicates()


def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each duplicate group (one row).

    Map-side partial aggregation collapses a hot duplicate group before the
    shuffle."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs (column_1, column_2) of same-typed columns whose values are
    equal on every row (NULLs aligned).

    A first pass fingerprints every column (``bit_xor`` of value hashes and
    the non-null count - order independent, no overflow); equal columns
    must share both, so only pairs with equal type and fingerprint are
    verified row by row with ``bool_and(a <=> b)`` in a second pass."""
    from ..functions.moments import batched_agg

    spark = df.sparkSession
    schema = "column_1 string, column_2 string"
    fields = df.schema.fields
    fp = batched_agg(df, [x for f in fields for x in (
        (f"h:{f.name}", F.bit_xor(F.xxhash64(ty.clean_col(df, f.name)))),
        (f"n:{f.name}", F.count(ty.clean_col(df, f.name))),
    )])
    pairs = [
        (a.name, b.name)
        for i, a in enumerate(fields)
        for b in fields[i + 1:]
        if a.dataType == b.dataType and fp[f"h:{a.name}"] == fp[f"h:{b.name}"] and fp[f"n:{a.name}"] == fp[f"n:{b.name}"]
    ]
    if not pairs:
        return spark.createDataFrame([], schema)
    same = batched_agg(df, [(f"{a}|{b}", F.bool_and(ty.clean_col(df, a).eqNullSafe(ty.clean_col(df, b)))) for a, b in pairs])
    return spark.createDataFrame([(a, b) for a, b in pairs if same[f"{a}|{b}"] in (True, None)], schema)


def filter_target_not_null(df: DataFrame, target: str) -> DataFrame:
    """Rows with a non-null target."""
    return df.where(ty.clean_col(df, target).isNotNull())


def pairwise_dropna(df: DataFrame, a: str, b: str) -> DataFrame:
    """Complete cases of one column pair."""
    x, y = ty.clean_col(df, a), ty.clean_col(df, b)
    return df.where(x.isNotNull() & y.isNotNull()).select(x.alias(a), y.alias(b))


def drop_zero_variance(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keep the numeric columns whose sample variance is > 0."""
    num = ty.numeric_columns(df)
    if not num:
        return df.select(), []
    row = df.agg(*[F.var_samp(ty.numeric_value(df, c)).alias(f"v{i}") for i, c in enumerate(num)]).first()
    keep = [c for i, c in enumerate(num) if row[f"v{i}"] is not None and row[f"v{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep]), [c for c in num if c not in keep]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians (interpolated), one value per column."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["column"]: r["value"] for r in rows}


def fill_value(column: Column, dt: ty.T.DataType, median: float) -> Column:
    """``column`` with NULL replaced by its median. Integer and decimal columns
    become double, since a median may lie between two values."""
    if isinstance(dt, (ty.T.FloatType, ty.T.DoubleType)):
        return F.coalesce(column, F.lit(median).cast(dt))
    return F.coalesce(column.cast("double"), F.lit(float(median)))


def modes(df: DataFrame, columns: list[str], freq: DataFrame | None = None) -> dict[str, str | None]:
    """Most frequent non-null value per column; ties go to the smallest value."""
    if not columns:
        return {}
    fq = freq if freq is not None else pr.frequency_table(df, columns)
    best = (
        fq.where(F.col("value").isNotNull() & F.col("column").isin(columns))
        .groupBy("column")
        .agg(F.min_by(F.col("value"), F.struct(-F.col("count"), F.col("value"))).alias("mode"))
    )
    return {r["column"]: r["mode"] for r in best.select("column", "mode").collect()}


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """NULL (and NaN) count per column - one narrow aggregation."""
    if not columns:
        return {}
    row = df.agg(*[F.count_if(ty.clean_col(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def fill_median_mode(df: DataFrame, columns: list[str] | None = None, medians_known: dict | None = None, nulls_known: dict | None = None) -> DataFrame:
    """Numeric NULL -> median, text NULL -> first mode. Statistics are
    computed only for the columns that have NULLs."""
    cols = columns or df.columns
    nulls = nulls_known if nulls_known is not None else null_counts(df, cols)
    num = [c for c in cols if ty.family(df.schema[c].dataType) == ty.NUMERIC and nulls[c] > 0]
    cat = [c for c in cols if ty.family(df.schema[c].dataType) == ty.STRING and nulls[c] > 0]
    known = medians_known or {}
    med = {**{c: known[c] for c in num if c in known}, **medians(df, [c for c in num if c not in known])}
    mod = modes(df, cat)
    out = []
    for f in df.schema.fields:
        c = ty.clean_col(df, f.name)
        if f.name in med and med[f.name] is not None:
            out.append(fill_value(c, f.dataType, med[f.name]).alias(f.name))
        elif f.name in mod and mod[f.name] is not None:
            out.append(F.coalesce(c, F.lit(mod[f.name])).alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def fill_missing_label(df: DataFrame, columns: list[str] | None = None, label: str = MISSING_LABEL) -> DataFrame:
    """NULL category -> 'Missing'."""
    cols = set(columns or ty.categorical_columns(df))
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(label)).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): 0-based rank of each distinct non-null value in
    sorted order, per column - built with the two-level prefix sum, so no
    column's distinct values sit in one task."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    distinct = (
        df.select(cells.alias("_c")).select("_c.*").where(F.col("value").isNotNull()).distinct().withColumn("_one", F.lit(1))
    )
    cum = cumulative_by_value(distinct, ["column"], "value", ["_one"])
    return cum.select("column", "value", (F.col("cum__one") - 1).cast("long").alias("code"))


#: dictionaries of a column's levels up to this size are broadcast
DICTIONARY_BYTES = 8 << 20


def label_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text -> sorted-order code (NULL -> -1); numeric NULL -> median,
    then anything still missing -> 0. Other columns pass through."""
    cols = columns or [c for c in df.columns if ty.family(df.schema[c].dataType) in (ty.NUMERIC, ty.STRING)]
    cat = [c for c in cols if ty.family(df.schema[c].dataType) == ty.STRING]
    num = [c for c in cols if ty.family(df.schema[c].dataType) == ty.NUMERIC]
    med = medians(df, num)
    out = df
    if cat:
        codes = materialize(label_codes(df, cat))
        sizes = {r["column"]: r["b"] for r in codes.groupBy("column").agg(F.sum(F.octet_length("value") + 16).alias("b")).collect()}
        for i, c in enumerate(cat):
            m = codes.where(F.col("column") == c).select(F.col("value").alias("_level"), F.col("code").alias(f"_code_{i}"))
            if sizes.get(c, 0) <= DICTIONARY_BYTES:
                out = out.join(F.broadcast(m), F.col(f"`{c}`") == F.col("_level"), "left").drop("_level")
            else:  # rows without a value are spread, as equal keys of a join they would meet in one task
                spread = F.when(F.col(f"`{c}`").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(F.lit(0))
                out = out.withColumn("_spread", spread).join(m.withColumn("_zero", F.lit(0).cast("long")), (F.col("_spread") == F.col("_zero")) & (F.col(f"`{c}`") == F.col("_level")), "left").drop("_level", "_zero", "_spread")
    sel = []
    for f in df.schema.fields:
        c = f.name
        if c in cat:
            sel.append(F.coalesce(F.col(f"_code_{cat.index(c)}"), F.lit(-1)).cast("double").alias(c))
        elif c in num:
            filled = F.coalesce(ty.numeric_value(df, c), F.lit(med.get(c)).cast("double"))
            sel.append(F.coalesce(filled, F.lit(0.0)).alias(c))
        else:
            sel.append(F.col(f"`{c}`"))
    return out.select(*sel)


def quality_findings(df: DataFrame, key_cols: list[str] | None = None, high_missing_pct: float = 50.0) -> DataFrame:
    """Every data-quality warning as a (check, column, value) row:
    large table, constant, high missing, id-like, duplicate rows, duplicate
    columns."""
    prof = materialize(pr.column_profile(df))  # one row per column, read by three checks
    size = pr.table_size(df)
    parts = [
        size.where("is_large").select(F.lit("large_table").alias("check"), F.lit(None).cast("string").alias("column"), F.col("data_mb").alias("value")),
        pr.constant_columns(prof).select(F.lit("constant").alias("check"), "column", F.col("unique_count").cast("double").alias("value")),
        pr.high_missing_columns(prof, high_missing_pct).select(F.lit("high_missing").alias("check"), "column", F.col("missing_pct").alias("value")),
        pr.id_like_columns(prof).select(F.lit("id_like").alias("check"), "column", F.col("unique_count").cast("double").alias("value")),
        count_duplicate_rows(df).where(F.col("duplicate_rows") > 0).select(
            F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").cast("double").alias("value")
        ),
        duplicate_columns(df).select(F.lit("duplicate_column").alias("check"), F.concat_ws(",", "column_1", "column_2").alias("column"), F.lit(1.0).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
