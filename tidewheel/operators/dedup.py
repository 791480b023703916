"""Deduplication, unions and entity filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.nulls import is_true


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """DDP-1, DDP-2, AGG-13: the first row of each key in the order (missing last). Missing keys are equal to one another."""
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """JN-4: the last row of each key, as when a map is filled in row order. Aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def drop_ambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DDP-4, JN-7: only rows whose key occurs once."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row")).where("_n = 1")
    return one.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DDP-3, DDP-5."""
    return df.dropDuplicates(list(keys))


def union_by_priority(sources: Sequence[DataFrame], ordinal: str = "row_ordinal") -> DataFrame:
    """SET-1, SET-2: union by name (missing columns NULL), with source_priority from the order of the sources."""
    tagged = [s.withColumn("source_priority", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out if ordinal in out.columns else out.withColumn(ordinal, F.monotonically_increasing_id())


def drop_entities_with(df: DataFrame, key: str, bad: Column) -> DataFrame:
    """FLT-9: rows of entities of which no row is bad (a missing comparison isn't). Only the bad entities' keys are shuffled."""
    offenders = df.where(is_true(bad)).select(F.col(key).alias("_bad")).distinct()
    return df.join(offenders, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")


def drop_entities_by_share(df: DataFrame, key: str, condition: Column, share: float) -> DataFrame:
    """FLT-10: rows of entities where the condition holds for less than the share of all rows, missing ones included."""
    rates = df.groupBy(key).agg(F.avg(is_true(condition).cast("int")).alias("_share")).where(F.col("_share") < share).select(F.col(key).alias("_key"))
    return df.join(rates, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def drop_short_entities(df: DataFrame, key: str, least: int) -> DataFrame:
    """FLT-11: rows of entities with at least so many rows. Missing keys aren't counted, so they stay."""
    short = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") < least).select(key)
    return df.join(short, key, "left_anti").select(*df.columns)


def until_marker(df: DataFrame, group: Sequence[str], ordinal: str, marker: Column) -> DataFrame:
    """FLT-14: rows of each group up to the first marker row, all rows if it has none."""
    at = F.min(F.when(is_true(marker), F.col(ordinal))).over(Window.partitionBy(*group))
    return df.withColumn("_at", at).where(F.col("_at").isNull() | (F.col(ordinal) <= F.col("_at"))).drop("_at")
