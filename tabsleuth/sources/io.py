"""Sources and sinks.

Readers return lazy DataFrames; only a bounded peek (the first lines of a
CSV file, for separator sniffing) is ever brought to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import batched_agg

# Encodings and separators tried, in this order, when sniffing a CSV file.
CSV_ENCODINGS = ["utf-8", "latin-1", "cp1252"]
CSV_SEPARATORS = [",", ";", "\t", "|"]
SPARK_CHARSETS = {"latin-1": "ISO-8859-1"}  # where the reader's name differs
SUPPORTED_EXTENSIONS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


class UnsupportedFormat(ValueError):
    pass


# Texts that stand for a missing value, and for true and false.
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CSV_TRUE, CSV_FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
CSV_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
CSV_NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
#: lines of the sample in which the header record is looked for
SNIFF_LINES = 100


@dataclass(frozen=True)
class CsvShape:
    """How a CSV file is to be read: its encoding and separator, and whether a
    quoted field holds a line break (such a file cannot be split between tasks)."""

    encoding: str
    separator: str
    quoted_breaks: bool


def _first_record(lines: list[str]) -> str:
    """The header record: lines are added while a quote is open."""
    record = ""
    for line in lines:
        record = f"{record}\n{line}" if record else line
        if record.strip() and record.count('"') % 2 == 0:
            break
    return record


def count_fields(record: str, sep: str) -> int:
    """Fields of a record under a separator; a field that begins with a quote
    lasts to its closing quote (doubled quotes stay inside)."""
    fields, quoted, at_start, i = 1, False, True, 0
    while i < len(record):
        c = record[i]
        if quoted:
            if c == '"':
                if record[i + 1:i + 2] == '"':
                    i += 1
                else:
                    quoted = False
        elif c == '"' and at_start:
            quoted = True
        elif c == sep:
            fields += 1
        at_start = not quoted and c == sep
        i += 1
    return fields


def sniff_csv(spark: SparkSession, path: str, encoding: str | None = None) -> CsvShape:
    """One pass over the lines tells whether all are valid UTF-8 (else the next
    encoding of the list, which maps every byte; a given ``encoding`` is taken
    as it is) and whether a quoted field goes on in the next line; then the
    first separator under which the header record has more than one field.
    Raises ValueError when none does (single-column files are rejected)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open")).first()
    enc = encoding or (CSV_ENCODINGS[0] if seen["utf8"] in (True, None) else CSV_ENCODINGS[1])
    head = _first_record([r[0].rstrip("\r") for r in lines.limit(SNIFF_LINES).collect()])  # separators are ASCII in each encoding
    for sep in CSV_SEPARATORS:
        if count_fields(head, sep) > 1:
            return CsvShape(enc, sep, bool(seen["open"]))
    raise ValueError(f"could not parse {path} as a delimited file with more than one column")


def _typed(text: DataFrame) -> DataFrame:
    """Text columns as long, double, boolean or text, whichever takes all their
    values (one aggregation; a column without a value is double)."""
    names = [f"v{i}" for i in range(len(text.columns))]
    rows = text.toDF(*names).select(*[F.when(~F.col(n).isin(CSV_MISSING), F.col(n)).alias(n) for n in names])
    checks = []
    for n in names:
        v = F.col(n)
        fits = {"l": v.rlike(CSV_INTEGER) & v.try_cast("long").isNotNull(), "d": v.rlike(CSV_NUMBER), "b": v.isin(CSV_TRUE + CSV_FALSE)}
        checks += [((n, k), F.bool_and(c)) for k, c in fits.items()] + [((n, "any"), F.count(v))]
    found = batched_agg(rows, checks)
    out = []
    for n, name in zip(names, text.columns, strict=True):
        v = F.col(n)
        if not found[(n, "any")]:
            v = v.cast("double")
        elif found[(n, "l")]:
            v = F.trim(v).cast("long")
        elif found[(n, "d")]:
            v = F.trim(v).cast("double")
        elif found[(n, "b")]:
            v = v.isin(CSV_TRUE)
        out.append(v.alias(name))
    return rows.select(*out)


def read_csv_sniff(spark: SparkSession, path: str, max_rows: int | None = None, schema: T.StructType | str | None = None, encoding: str | None = None) -> DataFrame:
    """A1: read CSV with sniffed encoding and separator and a header row.
    Fields may be quoted, hold doubled quotes and line breaks; the usual texts
    for a missing value are NULL. Types come from all values (one more pass over
    the file) unless a ``schema`` is given."""
    shape = sniff_csv(spark, path, encoding)
    options = {"sep": shape.separator, "encoding": SPARK_CHARSETS.get(shape.encoding, shape.encoding), "header": True, "quote": '"', "escape": '"', "multiLine": shape.quoted_breaks}
    df = spark.read.csv(path, schema=schema, **options) if schema is not None else _typed(spark.read.csv(path, inferSchema=False, **options))
    return row_cap(df, max_rows) if max_rows else df


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A2"""
    df = spark.read.parquet(path)
    return row_cap(df, max_rows) if max_rows else df


def row_cap(df: DataFrame, max_rows: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A3: keep at most ``max_rows`` rows (all when it is None); with
    ``order_by`` the kept rows are deterministic (top-k sort, no global sort of
    the whole table)."""
    if max_rows is None:
        return df
    if order_by:
        return df.orderBy(*order_by).limit(int(max_rows))
    return df.limit(int(max_rows))


def load_table(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A4: dispatch on the file extension."""
    lower = path.lower().rstrip("/")
    for ext, fmt in SUPPORTED_EXTENSIONS.items():
        if lower.endswith(ext):
            if fmt == "csv":
                return read_csv_sniff(spark, path, max_rows)
            if fmt == "parquet":
                return read_parquet(spark, path, max_rows)
            df = spark.read.json(path)
            return row_cap(df, max_rows) if max_rows else df
    raise UnsupportedFormat(f"Unsupported file format: {path}. Supported: CSV, Parquet, JSON")


def summary_table(df: DataFrame) -> DataFrame:
    """A5 content: Metric/Value rows - rows, columns, missing %, numeric and
    categorical column counts (one aggregation)."""
    from ..operators.profile import dataset_overview

    ov = dataset_overview(df)
    return ov.select(
        F.explode(
            F.array(
                F.struct(F.lit("Total Rows").alias("metric"), F.col("total_rows").cast("string").alias("value")),
                F.struct(F.lit("Total Columns").alias("metric"), F.col("total_cols").cast("string").alias("value")),
                F.struct(F.lit("Missing Values (%)").alias("metric"), F.format_number(F.col("missing_percentage"), 2).alias("value")),
                F.struct(F.lit("Numeric Columns").alias("metric"), F.col("numeric_cols").cast("string").alias("value")),
                F.struct(F.lit("Categorical Columns").alias("metric"), F.col("categorical_cols").cast("string").alias("value")),
            )
        ).alias("_m")
    ).select(F.col("_m.metric").alias("metric"), F.col("_m.value").alias("value"))


def write_summary_csv(df: DataFrame, path: str) -> str:
    """A5: write the Metric/Value summary as one CSV part with header."""
    summary_table(df).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_summary_json(summary: DataFrame, path: str) -> str:
    """Write a struct-typed run summary DataFrame as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in key order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


