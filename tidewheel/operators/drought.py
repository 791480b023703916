"""Seasonal percentiles and drought runs. All windows are partitioned by the key, so one exchange serves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.nulls import is_true


def seasonal_percentile(df: DataFrame, key: str, month: str, value: str, out: str = "percentile") -> DataFrame:
    """WIN-2: rank percentile within key and calendar month: the mean of the shares of values below and not above.

    Rows with a missing value have no percentile and don't count.
    """
    groups = [F.col(key), F.month(month), F.col(value).isNotNull()]
    below = F.rank().over(Window.partitionBy(*groups).orderBy(value)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, F.col(value)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (2 * below + ties + 1) * 50.0 / n))


def pool_gaps(df: DataFrame, key: str, month: str, flag: str, out: str) -> DataFrame:
    """WIN-3: a single 0 between two 1s becomes 1, by the original series."""
    w = Window.partitionBy(key).orderBy(month)
    gap = (F.col(flag) == 0) & (F.lag(flag).over(w) == 1) & (F.lead(flag).over(w) == 1)
    return df.withColumn(out, F.when(is_true(gap), F.lit(1)).otherwise(F.col(flag)))


def run_lengths(df: DataFrame, key: str, month: str, flag: str, run: str = "run", size: str = "run_size") -> DataFrame:
    """WIN-4, WIN-5: number of each run of equal flags (from 1, runs of 0 count as well) and its length."""
    w = Window.partitionBy(key).orderBy(month)
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_change", change).withColumn(run, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")
    return numbered.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(key, run)))


def long_runs(flag: Column, run: Column, size: Column, least: int) -> Column:
    """WIN-6: the run's number where its flag is 1 and it is long enough, else 0."""
    return F.when(is_true((flag == 1) & (size >= least)), run).otherwise(F.lit(0).cast("long"))


def drought_columns(df: DataFrame, key: str, month: str, percentile: str = "percentile", thresholds: Sequence[int] = (10, 20, 25), lengths: Sequence[int] = (1, 3, 6, 12)) -> DataFrame:
    """WIN-7: drought_{threshold}_pooled_{length}length for all thresholds (strictly below) and lengths."""
    for t in thresholds:
        df = df.withColumn("_flag", F.when(is_true(F.col(percentile) < t), 1).otherwise(0))
        df = run_lengths(pool_gaps(df, key, month, "_flag", "_pooled"), key, month, "_pooled", "_run", "_size")
        df = df.withColumns({f"drought_{t}_pooled_{n}length": long_runs(F.col("_pooled"), F.col("_run"), F.col("_size"), n) for n in lengths}).drop("_flag", "_pooled", "_run", "_size")
    return df
