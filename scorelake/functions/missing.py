"""One notion of "missing": null, and NaN in floating-point columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Column name usable in an expression even with dots or slashes in it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def is_missing(df: DataFrame, name: str) -> Column:
    """True where the value is null or NaN."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_floating(df, name) else c.isNull()


def value_or_null(df: DataFrame, name: str) -> Column:
    c = col(name)
    return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType)) if is_floating(df, name) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating-point column."""
    return df.select([value_or_null(df, n).alias(n) for n in df.columns])
