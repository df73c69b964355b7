"""One definition of "missing" for every operator: NULL, or NaN in floating columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = FLOATING + INTEGRAL + (T.DecimalType,)
TEXTUAL = (T.StringType, T.CharType, T.VarcharType)


def is_missing(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, FLOATING):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_if_missing(column: Column, dtype: T.DataType) -> Column:
    """NaN becomes NULL; other values pass through."""
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def finite_or_null(column: Column, dtype: T.DataType) -> Column:
    """NaN and both infinities become NULL, as needed for JSON output."""
    if isinstance(dtype, FLOATING):
        infinity = F.lit(float("inf"))
        return F.when(~F.isnan(column) & (F.abs(column) != infinity), column)
    return column


def sanitize_frame(df: DataFrame) -> DataFrame:
    return df.select(
        *[finite_or_null(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema]
    )


def quoted(name: str) -> str:
    """Column reference that survives dots and spaces in names."""
    return "`" + name.replace("`", "``") + "`"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEXTUAL)]
