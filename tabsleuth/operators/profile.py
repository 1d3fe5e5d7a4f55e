"""Column profile and data quality.

Design rule: one *frequency table* ``(pos, column, value, count)`` built by a
single explode + hash aggregation (partial aggregation on the map side, so a
hot value costs one row per task, not a third of the table). Distinct counts,
missing counts, modes, top-k values, class counts and the semantic type
probe all read that table instead of re-scanning the data per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.ranking import exact_quantiles
from ..session import materialize

# Thresholds used by the column-type rules.
CATEGORICAL_MAX_UNIQUE = 50
CATEGORICAL_MAX_RATIO = 0.2
ID_LIKE_RATIO = 0.95
ID_LIKE_MIN_ROWS = 100
LARGE_TABLE_MB = 500
# ISO-like date text accepted by the datetime probe.
DATE_TEXT_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def _pick(values: list, idx: Column) -> Column:
    """element at 0-based ``idx`` of a literal array (per-column metadata, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


def _value_kind(dt) -> str:
    """How a column's values are keyed in the frequency table."""
    if isinstance(dt, (ty.T.ByteType, ty.T.ShortType, ty.T.IntegerType, ty.T.LongType)):
        return "integral"
    if isinstance(dt, ty.T.FloatType):
        return "float"
    if isinstance(dt, ty.T.DoubleType):
        return "double"
    return "text"


def frequency_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pos, column, value, count): counts of every value (as text) per column,
    NULL (and NaN) counted under ``value IS NULL``.

    Integers are aggregated on a long key, other numbers on a double, and only
    turned into text after the aggregation (on the distinct values); the group
    key holds the int column position, the name is attached afterwards."""
    cols = columns or ty.profilable_columns(df)
    kinds = [_value_kind(df.schema[c].dataType) for c in cols]
    typed = lambda c, k, want, to: (ty.clean_col(df, c) if k in want else F.lit(None)).cast(to)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("pos"),
                    typed(c, k, ("integral",), "long").alias("int"),
                    typed(c, k, ("float", "double"), "double").alias("num"),
                    typed(c, k, ("text",), "string").alias("str"),
                )
                for i, (c, k) in enumerate(zip(cols, kinds))
            ]
        )
    )
    agg = df.select(cells.alias("_c")).select("_c.*").groupBy("pos", "int", "num", "str").agg(F.count(F.lit(1)).alias("count"))
    kind = _pick(kinds, F.col("pos"))
    value = (
        F.when(kind == "integral", F.col("int").cast("string"))
        .when(kind == "float", F.col("num").cast("float").cast("string"))
        .when(kind == "double", F.col("num").cast("string"))
        .otherwise(F.col("str"))
    )
    return agg.select("pos", _pick(cols, F.col("pos")).alias("column"), value.alias("value"), "count")


# Formats of dates in text beside the ISO form, each with the
# pattern that a text must match (times of day may follow all of them).
DATE_FORMATS = [
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}[- ][A-Z][a-z]{2}[- ]\d{4}", "d-MMM-yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM-d,-yyyy"),
    (r"[A-Z][a-z]{3,8} \d{1,2}, \d{4}", "MMMM-d,-yyyy"),
]
TIME_OF_DAY = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?)?$"
LONGEST_DATE = 40


def date_formats(text: Column) -> Column:
    """The formats in which a text is a date, as bits: bit 0 ISO, then those
    of ``DATE_FORMATS``. A column holds dates if one bit is set in all values."""
    iso = text.rlike(DATE_TEXT_PATTERN) & text.try_cast("timestamp").isNotNull()
    mask = F.when(iso, 1).otherwise(0)
    for i, (pattern, form) in enumerate(DATE_FORMATS, 1):
        day = F.replace(F.regexp_extract(text, f"^({pattern}){TIME_OF_DAY}", 1), F.lit(" "), F.lit("-")) if "-" in form else F.regexp_extract(text, f"^({pattern}){TIME_OF_DAY}", 1)
        fits = text.rlike(f"^{pattern}{TIME_OF_DAY}") & F.try_to_timestamp(day, F.lit(form)).isNotNull()
        mask = mask + F.when(fits, 1 << i).otherwise(0)
    return F.when((F.length(text) <= LONGEST_DATE) & text.rlike(r"\d{4}"), mask).otherwise(0)


def _distinct_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pos, count, missing, length, dates), one row per distinct value. Keys
    are typed or hashed: times as microseconds, texts as 128-bit digests with
    their length and date probe beside them, so no text is shuffled."""
    null = lambda to: F.lit(None).cast(to)
    structs = []
    for i, c in enumerate(cols):
        dt, v = df.schema[c].dataType, ty.clean_col(df, c)
        number, real, text = null("long"), null("double"), null("string")
        if _value_kind(dt) == "integral":
            number = v.cast("long")
        elif ty.is_floating(dt):
            real = v.cast("double")
        elif isinstance(dt, ty.T.TimestampNTZType):
            number = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), v)
        elif isinstance(dt, ty.T.TimestampType):
            number = F.unix_micros(v)
        elif isinstance(dt, ty.T.DateType):
            number = F.unix_date(v).cast("long")
        else:
            text = v.cast("string")
        structs.append(F.struct(F.lit(i).alias("pos"), v.isNull().alias("missing"), number.alias("number"), real.alias("real"), F.unhex(F.md5(text)).alias("digest"), F.length(text).alias("length"), (date_formats(text) if ty.family(dt) == ty.STRING else F.lit(0)).alias("dates")))
    rows = df.select(F.explode(F.array(*structs)).alias("_c")).select("_c.*")
    return rows.groupBy("pos", "missing", "number", "real", "digest").agg(F.count(F.lit(1)).alias("count"), F.max("length").alias("length"), F.max("dates").alias("dates"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column dtype, missing/unique counts and %, constant / id-like
    flags, semantic type and mean text length (strings). One row per column,
    also for an empty table."""
    cols = columns or ty.profilable_columns(df)
    fams = [ty.family(df.schema[c].dataType) for c in cols]
    dtypes = [ty.type_name(df.schema[c].dataType) for c in cols]
    there = ~F.col("missing")
    found = _distinct_cells(df, cols).groupBy("pos").agg(
        F.sum("count").alias("n_rows"),
        F.sum(F.when(F.col("missing"), F.col("count"))).alias("missing_count"),
        F.count_if(there).alias("unique_count"),
        F.bit_and(F.when(there, F.col("dates"))).alias("_formats"),
        F.try_divide(F.sum(F.when(there, F.col("length") * F.col("count"))), F.sum(F.when(there, F.col("count")))).alias("mean_length"),
    )
    base = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "pos int, column string")
    agg = base.join(found, "pos", "left").na.fill(0, ["n_rows", "missing_count", "unique_count"])
    n = F.col("n_rows")
    u = F.col("unique_count")
    fam = _pick(fams, F.col("pos"))
    small = u <= F.least(F.lit(CATEGORICAL_MAX_UNIQUE).cast("double"), CATEGORICAL_MAX_RATIO * n)
    semantic = (
        F.when(fam == ty.NUMERIC, F.when(small & (u > 1), "categorical_numeric").otherwise("numeric"))
        .when(fam == ty.STRING, F.when((F.col("_formats") != 0) & (u > 0), "datetime").when((u > 0) & small, "categorical").otherwise("text"))
        .when(fam == ty.DATETIME, "datetime")
        .otherwise("other")
    )
    return agg.select(
        "pos",
        "column",
        _pick(dtypes, F.col("pos")).alias("dtype"),
        fam.alias("family"),
        "n_rows",
        "missing_count",
        (F.try_divide(F.col("missing_count"), n) * 100).alias("missing_pct"),
        "unique_count",
        F.coalesce(F.try_divide(u, n) * 100, F.lit(0.0)).alias("unique_pct"),
        (u <= 1).alias("is_constant"),
        ((u > ID_LIKE_RATIO * n) & (n > ID_LIKE_MIN_ROWS)).alias("is_id_like"),
        semantic.alias("semantic_type"),
        F.when(fam == ty.STRING, F.col("mean_length")).alias("mean_length"),
    )


def missing_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pos, column, n_rows, missing_count, missing_pct) from one narrow pass."""
    cols = columns or ty.profilable_columns(df)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(ty.clean_col(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(cols)]))
    return counts.select(cell.alias("_c")).select("_c.*").withColumn("missing_pct", F.try_divide(F.col("missing_count"), F.col("n_rows")) * 100)


def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric / categorical column counts, missing cells and %.

    One pass, no shuffle beyond the final single-row merge."""
    cols = df.columns
    n_num = len(ty.numeric_columns(df))
    n_cat = len(ty.categorical_columns(df))
    missing = [F.count_if(ty.clean_col(df, c).isNull()) for c in cols]
    total_missing = sum(missing[1:], missing[0]) if missing else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), total_missing.alias("missing_values")).select(
        "total_rows",
        F.lit(len(cols)).cast("long").alias("total_cols"),
        F.lit(n_num).cast("long").alias("numeric_cols"),
        F.lit(n_cat).cast("long").alias("categorical_cols"),
        F.col("missing_values").cast("long").alias("missing_values"),
        (F.try_divide(F.col("missing_values"), F.col("total_rows") * len(cols)) * 100).alias("missing_percentage"),
    )


def column_info(profile: DataFrame) -> DataFrame:
    """Column, type, missing, missing % (2 dp), unique, unique %."""
    return profile.select(
        "pos",
        "column",
        F.col("dtype").alias("type"),
        F.col("missing_count").alias("missing"),
        F.round("missing_pct", 2).alias("missing_pct"),
        F.col("unique_count").alias("unique"),
        F.col("unique_pct"),
    )


def missing_by_column(profile: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and % per column (optionally only those with missing),
    from a profile or a :func:`missing_table` (as C5 and C9)."""
    out = profile.select("pos", "column", "missing_count", "missing_pct")
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out


def missing_summary(profile: DataFrame) -> DataFrame:
    """Total missing cells, columns with missing values, missing % of all cells."""
    return profile.agg(
        F.sum("missing_count").cast("long").alias("total_missing"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        (F.try_divide(F.sum("missing_count"), F.sum("n_rows")) * 100).alias("missing_percentage"),
    )


def dtype_summary(df: DataFrame) -> DataFrame:
    """Number of columns per dtype, from the schema alone."""
    names = [ty.type_name(df.schema[c].dataType) for c in ty.profilable_columns(df)]
    return df.sparkSession.createDataFrame([(t, names.count(t)) for t in sorted(set(names))], "dtype string, n_columns long")


# Fixed width in bytes per value of each fixed-size Spark type.
_FIXED_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
                "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def table_size(df: DataFrame) -> DataFrame:
    """Data bytes (UTF-8 bytes of strings + fixed width per non-null value)
    and the large-table flag (> 500 MB)."""
    parts = []
    for f in df.schema.fields:
        fam = ty.family(f.dataType)
        c = ty.clean_col(df, f.name)
        if fam == ty.STRING:
            parts.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)))
        elif ty.type_name(f.dataType) in _FIXED_WIDTH:
            parts.append(F.count(c) * _FIXED_WIDTH[ty.type_name(f.dataType)])
        elif isinstance(f.dataType, ty.T.DecimalType):
            parts.append(F.count(c) * 16)
    total = sum(parts[1:], parts[0]) if parts else F.lit(0)
    return df.agg(total.cast("long").alias("data_bytes")).select(
        "data_bytes",
        (F.col("data_bytes") / (1024 * 1024)).alias("data_mb"),
        (F.col("data_bytes") / (1024 * 1024) > LARGE_TABLE_MB).alias("is_large"),
    )


def high_missing_columns(profile: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    """Columns whose missing % is above ``threshold_pct`` (desc)."""
    return profile.where(F.col("missing_pct") > threshold_pct).select("pos", "column", "missing_count", "missing_pct")


def id_like_columns(profile: DataFrame) -> DataFrame:
    """C10"""
    return profile.where("is_id_like").select("pos", "column", "unique_count", "n_rows")


def constant_columns(profile: DataFrame) -> DataFrame:
    """C11"""
    return profile.where("is_constant").select("pos", "column", "unique_count")


def high_cardinality_columns(profile: DataFrame, limit: int = 50) -> DataFrame:
    """Text columns with more than ``limit`` distinct values (not constant)."""
    return profile.where(
        (F.col("family") == ty.STRING) & (F.col("unique_count") > limit) & ~F.col("is_constant")
    ).select("pos", "column", "unique_count")


def outliers_iqr(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """C14 summary per numeric column: Q1, Q3, IQR, bounds (strict), outlier
    count and % of all rows (nulls in the denominator)."""
    cols = columns or ty.numeric_columns(df)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lower_bound", F.col("q1") - factor * F.col("iqr")
    ).withColumn("upper_bound", F.col("q3") + factor * F.col("iqr"))
    b = {r["column"]: r for r in bounds.collect()}  # one row per column
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        lo, hi = b[c]["lower_bound"], b[c]["upper_bound"]
        v = ty.numeric_value(df, c)
        cond = (v < F.lit(lo)) | (v > F.lit(hi)) if lo is not None else F.lit(False)
        aggs.append(F.count_if(cond).alias(f"_o{i}"))
    names = ("q1", "q3", "iqr", "lower_bound", "upper_bound")
    rows = [F.struct(F.lit(c).alias("column"), *[F.lit(b[c][x]).cast("double").alias(x) for x in names], F.col(f"_o{i}").cast("long").alias("outlier_count")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select("_n", F.explode(F.array(*rows)).alias("_s")).select(
        "_s.*", F.coalesce(F.try_divide(F.col("_s.outlier_count"), F.col("_n")) * 100, F.lit(0.0)).alias("outlier_pct")
    )


def flag_outliers(df: DataFrame, column: str, bounds_row, flag: str = "is_outlier") -> DataFrame:
    """C14 row flags: add a boolean column marking outliers of ``column``, by
    its row of :func:`outliers_iqr`."""
    v = ty.numeric_value(df, column)
    outside = (v < F.lit(bounds_row["lower_bound"])) | (v > F.lit(bounds_row["upper_bound"]))
    return df.withColumn(flag, F.coalesce(outside, F.lit(False)))


STABILITY_SAMPLES, STABILITY_ROWS = 10, 1000


def repeated_samples(df: DataFrame, key_col: str, samples: int = STABILITY_SAMPLES, rows: int = STABILITY_ROWS, seed: int = 42) -> DataFrame:
    """``samples`` repeatable samples of exactly ``rows`` rows each (all rows of
    a smaller table): those with the smallest hashes of key, seed and sample
    number (``_rep``), equal hashes in the order of a hash of the row.

    The hash of a sample's last row is close to rows / n of the hash range, so
    a scan keeps the few rows below a little more than that, and only they are
    ranked; a threshold that proves too low is raised."""
    n = df.count()
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, ty.T.MapType)]
    number = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("")), F.lit(str(seed)), F.col("_rep").cast("string")))
    share = 1.0 if n <= rows else (rows + 6 * rows ** 0.5 + 20) / n
    while True:
        low = df.withColumn("_rep", number).withColumn("_hash", digest)
        if share < 1:
            low = low.where(F.col("_hash") < f"{int(share * 2 ** 52):013x}")
        best = Window.partitionBy("_rep").orderBy("_hash", F.xxhash64(*plain))  # little more than ``rows`` rows a sample
        low = materialize(low.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= rows))
        found = low.groupBy("_rep").agg(F.count(F.lit(1)).alias("n")).collect()
        if share >= 1 or (len(found) == samples and all(r["n"] == min(rows, n) for r in found)):
            return low.drop("_hash", "_place")
        share *= 4


def feature_stability(
    df: DataFrame,
    key_col: str,
    columns: list[str] | None = None,
    replicates: int = STABILITY_SAMPLES,
    seed: int = 42,
    by_key_mod: bool = False,
    rows: int = STABILITY_ROWS,
) -> DataFrame:
    """Statistics over ``replicates`` samples of ``rows`` rows, so that the
    score does not depend on the size of the table (see
    :func:`repeated_samples`; the samples are one for all columns, and
    repeatable), or over the disjoint parts ``key % replicates``. Numeric
    columns score max(0, 1 - std_pop(sample means)/|mean of means|) (1.0 when
    that mean is 0), other columns 1 - std_pop(top-value share per sample;
    denominator counts nulls). One grouped aggregation + a small regroup.
    """
    cols = columns or [c for c in ty.profilable_columns(df) if c != key_col]
    if by_key_mod:
        base = df.withColumn("_rep", F.pmod(F.col(f"`{key_col}`"), F.lit(replicates)).cast("int"))
    else:
        base = repeated_samples(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key_col, *cols])]), key_col, replicates, rows, seed)
    num = [c for c in cols if ty.family(df.schema[c].dataType) in (ty.NUMERIC, ty.BOOLEAN)]
    other = [c for c in cols if c not in num]
    pieces = []
    if num:
        means = base.groupBy("_rep").agg(*[F.avg(ty.numeric_value(df, c)).alias(f"m{i}") for i, c in enumerate(num)])
        long = means.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("m")) for i, c in enumerate(num)])).alias("_s")
        ).select("_s.*")
        pieces.append(
            long.groupBy("column").agg(F.stddev_pop("m").alias("sd"), F.avg("m").alias("mm")).select(
                "column",
                F.when((F.col("mm") == 0) | F.col("mm").isNull(), F.lit(1.0))
                .otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.abs("mm")))
                .alias("stability"),
            )
        )
    if other:
        cells = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), ty.clean_col(df, c).cast("string").alias("value")) for c in other])
        )
        counts = base.select("_rep", cells.alias("_c")).select("_rep", "_c.*").groupBy("_rep", "column", "value").agg(
            F.count(F.lit(1)).alias("cnt")
        )
        per_rep = counts.groupBy("_rep", "column").agg(
            F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("top"), F.sum("cnt").alias("n")
        ).withColumn("share", F.coalesce(F.col("top") / F.col("n"), F.lit(0.0)))
        pieces.append(per_rep.groupBy("column").agg((1 - F.stddev_pop("share")).alias("stability")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
