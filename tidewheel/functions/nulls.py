"""Missing values. NaN becomes NULL at each source; the expressions below then follow the survey's table 1.4."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of all floating-point columns to NULL."""
    floats = {f.name: f.metadata for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*(F.when(~F.isnan(df[c]), df[c]).alias(c, metadata=floats[c]) if c in floats else df[c] for c in df.columns))


def is_true(predicate: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(predicate, F.lit(False))


def not_in(column: Column, values: Iterable) -> Column:
    """FLT-3: anti-membership that keeps missing values."""
    return column.isNull() | ~column.isin(list(values))


def differs(column: Column, value) -> Column:
    """FLT-7: inequality that keeps missing values."""
    return column.isNull() | (column != value)


def sum_or_zero(column: Column) -> Column:
    """AGG-1: the sum of nothing but missing values is 0."""
    return F.coalesce(F.sum(column), F.lit(0).cast("double"))


def max_unless_missing(column: Column) -> Column:
    """AGG-12: the maximum, missing if any value is."""
    return F.when(F.count(F.lit(1)) == F.count(column), F.max(column))


def first_unless_greater(a: Column, b: Column) -> Column:
    """DOM-13: b where it is greater than a, else a; also where either is missing."""
    return F.when(is_true(b > a), b).otherwise(a)


def clip(column: Column, low: float, high: float) -> Column:
    """PRJ-16: into [low, high]; missing stays missing."""
    return F.when(column < low, F.lit(float(low))).when(column > high, F.lit(float(high))).otherwise(column)


def sentinel_to_number(column: Column, sentinel: str = "NA") -> Column:
    """PRJ-12: text to a number; the sentinel and what is no number are missing."""
    return F.nullif(column, F.lit(sentinel)).try_cast("double")


def dash_to_zero(column: Column) -> Column:
    """PRJ-13: a dash is zero; what is no number is missing."""
    return F.when(F.trim(column) == "-", F.lit(0.0)).otherwise(column.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """PRJ-15: a / b, missing where b is 0."""
    return F.try_divide(a, b)


def finite(column: Column) -> Column:
    """MTH-2: the value, missing if NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
