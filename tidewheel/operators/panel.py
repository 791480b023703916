"""Entity by month panels: resampling, expansion, reshaping, lags, capacity repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.calendar import month_end, month_of
from tidewheel.functions.kernels import hydraulic_power
from tidewheel.functions.nulls import first_unless_greater, sum_or_zero


def aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """AGG-1, AGG-5 to AGG-8: by keys, without rows of a missing key."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


def monthly(df: DataFrame, keys: Sequence[str], date: str, value: str | Sequence[str], how: str = "mean", fill_gaps: bool = True, at_end: bool = True) -> DataFrame:
    """AGG-2, AGG-3, AGG-4: mean or sum by key and month, of one column or several; months between a key's first and last have a row as well,
    with no mean and a sum of 0. Dates are month ends, or starts."""
    values = [value] if isinstance(value, str) else list(value)
    agg = {"mean": lambda c: F.avg(c), "sum": lambda c: sum_or_zero(F.col(c))}[how]
    cells = df.dropna(subset=[*keys, date]).withColumn("month", month_of(F.col(date))).groupBy(*keys, "month").agg(*(agg(c).alias(c) for c in values))
    if fill_gaps:
        spans = cells.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
        all_months = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
        cells = all_months.join(cells, [*keys, "month"], "left")
        if how == "sum":
            cells = cells.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in values})
    return cells.withColumn("month", month_end(F.col("month"))) if at_end else cells


def month_panel(entities: DataFrame, first: str, last: str) -> DataFrame:
    """JN-12: each row for each month from first to last (ISO dates)."""
    return entities.withColumn("month", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))))


def year_to_months(df: DataFrame, year: str) -> DataFrame:
    """JN-13: each yearly row for its twelve months."""
    return df.withColumn("month", F.explode(F.sequence(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.make_date(F.col(year), F.lit(12), F.lit(1)), F.expr("interval 1 month"))))


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None, name: str, value: str) -> DataFrame:
    """RSH-1, RSH-2: wide columns as rows (of all other columns than ids, if none are named)."""
    wide = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), wide, name, value)


def wide_form(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """RSH-3: rows as columns; the names are given, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def lag_features(series: DataFrame, key: str, month: str, value: str, lags: int = 7, prefix: str = "physical_hydropower") -> DataFrame:
    """WIN-1: columns prefix_0n to prefix_6n, positional over the key's contiguous series (6n is the oldest)."""
    w = Window.partitionBy(key).orderBy(month)
    return series.select(key, month, *(F.lag(value, k).over(w).alias(f"{prefix}_{k}n") for k in range(lags)))


def lag_features_by_month(series: DataFrame, key: str, month: str, value: str, lags: int = 7, prefix: str = "physical_hydropower") -> DataFrame:
    """WIN-1 where months may be missing: a lag is the value of exactly so many months before. One exchange and sort serve all lags."""
    w = Window.partitionBy(key).orderBy(F.year(month) * 12 + F.month(month))
    return series.select(key, month, *(F.max(value).over(w.rangeBetween(-k, -k)).alias(f"{prefix}_{k}n") for k in range(lags)))


def discharge_power(series: DataFrame, flow: str = "discharge", head: str = "head_m") -> DataFrame:
    """DOM-11 as a column power_mw."""
    return series.withColumn("power_mw", hydraulic_power(F.col(flow), F.col(head)))


def repair_capacity(df: DataFrame, key: str, capacity: str, observed: str) -> DataFrame:
    """DOM-13, AGG-5: capacity at least the key's largest observation, rounded half to even; missing ones change nothing."""
    w = Window.partitionBy(key)
    most = F.bround(F.max(observed).over(w))
    return df.withColumn(capacity, first_unless_greater(F.max(capacity).over(w), most))
