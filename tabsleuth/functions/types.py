"""Type families and missing-value normalisation.

pandas treats NaN and None alike; Spark does not (``avg``/``corr`` over a NaN
give NaN and ``count`` counts it). Every operator therefore reads columns
through :func:`clean_col`, which turns float NaN into SQL NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
STRING = "string"
DATETIME = "datetime"
BOOLEAN = "boolean"
NESTED = "nested"
OTHER = "other"


def family(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return NESTED
    return OTHER


def columns_of(df: DataFrame, *families: str) -> list[str]:
    """Column names whose family is one of ``families`` (schema order)."""
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, STRING)


def profilable_columns(df: DataFrame) -> list[str]:
    """All columns except nested ones (arrays, maps, structs are skipped)."""
    return [f.name for f in df.schema.fields if family(f.dataType) != NESTED]


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def clean_col(df: DataFrame, name: str) -> Column:
    """Column with NaN mapped to NULL (floats only); others unchanged."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if is_floating(dt):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def numeric_value(df: DataFrame, name: str) -> Column:
    """NaN-free double view of a numeric or boolean column."""
    dt = df.schema[name].dataType
    c = clean_col(df, name)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dt, T.DecimalType) or not isinstance(dt, T.DoubleType):
        return c.cast("double")
    return c


def type_name(dt: T.DataType) -> str:
    """Spark's short type name (bigint, double, string, timestamp_ntz, ...)."""
    return dt.simpleString()
