"""Ranks and order statistics without one task for all rows of an order or a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tidewheel.operators.staging import written

#: Rows of a key beyond which its quantile is selected by digits; rows of a broadcast at most.
HOT, FEW = 1_000_000, 200_000
#: Bits of a digit. A round counts at most 2**DIGIT values for each key.
DIGIT = 16


def ranked(df: DataFrame, order: Sequence[str], out: str = "rank", parts: int | None = None) -> tuple[DataFrame, int]:
    """WIN-8, SRT-2: df with each row's place in the order, from 1, and the number of rows.

    Rows are dealt by ranges of the order and sorted there; a row's place is its place in its range after the rows of the ranges
    before, which the driver adds up from one number for each range. Equal rows have places next to each other.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")  # the range's number, then 33 bits of place
    sizes = {r["part"]: r["count"] for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()}
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(parts))])
    offset = F.element_at(F.lit(before), (F.shiftright("_at", 33) + 1).cast("int"))
    return placed.withColumn(out, offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at"), int(before[-1])


@F.pandas_udf(LongType())
def _sortable(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))


@F.pandas_udf(DoubleType())
def _double(n: pd.Series) -> pd.Series:
    bits = n.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64))


def quantile_by(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, hot: int = HOT) -> DataFrame:
    """AGG-11: the exact quantile by linear interpolation of each key's values; missing ones are left out, a key of only these has
    none. Keys of more than `hot` values never have theirs in one buffer: both neighbours of the place are found by counting
    digits of the numbers' bits, four rounds from the highest. There is one such key for `hot` rows at most.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    large = written(counts.where(F.col("_n") > hot).withColumn("_key", F.monotonically_increasing_id()), "hot")
    few = large.count()
    plain = lambda df: df.groupBy(*keys).agg(F.percentile("_v", q).alias(out))
    if not few:
        return plain(rows)
    side = F.broadcast(large) if few <= FEW else large
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rest = plain(rows.join(side, same(rows, side), "left_anti"))
    held = written(rows.where("_v is not null").join(side, same(rows, side)).select("_key", _sortable("_v").alias("_b")), "digits")
    place = (F.col("_n") - 1) * F.lit(q)
    wanted = large.select("_key", F.explode(F.array(F.floor(place), F.ceil(place))).alias("_r")).distinct()
    wanted = wanted.select("_key", "_r", F.col("_r").alias("_left"), F.lit(0).cast("long").alias("_p"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        targets = written(wanted, "targets")  # two rows for each hot key
        near = F.broadcast(targets) if few <= FEW // 2 else targets
        above = F.lit(True) if shift == 64 - DIGIT else F.shiftright("_b", shift + DIGIT) == F.col("_p")
        digits = held.join(near, "_key").where(above).groupBy("_key", "_r", "_left", F.shiftright("_b", shift).alias("_d")).count()
        upto = Window.partitionBy("_key", "_r").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        sums = digits.withColumn("_upto", F.sum("count").over(upto)).where(F.col("_upto") > F.col("_left"))
        first = sums.groupBy("_key", "_r").agg(F.min_by(F.struct("_d", (F.col("_left") - F.col("_upto") + F.col("count")).alias("left")), "_d").alias("x"))
        wanted = first.select("_key", "_r", F.col("x.left").alias("_left"), F.col("x._d").alias("_p"))
    found = wanted.select("_key", "_r", _double("_p").alias("_x")).join(large, "_key")
    low, high = (F.max(F.when(F.col("_r") == f(place), F.col("_x"))) for f in (F.floor, F.ceil))
    share = F.max(place - F.floor(place))
    return found.groupBy(*keys).agg(F.when(share == 0, low).otherwise((1 - share) * low + share * high).alias(out)).unionByName(rest)


def nearest_place(value: Column, axis: Sequence[float]) -> Column:
    """JN-15: index of the nearest point of any axis, the first of equally near ones, by bisection of the sorted axis, which is one
    literal however long it is. Missing for missing."""
    places: dict[float, int] = {}
    for i, p in enumerate(map(float, axis)):
        places.setdefault(p, i)
    if not places:
        return F.lit(None).cast("int")
    points = sorted(places)
    at, index = F.lit(np.array(points)), F.lit(np.array([places[p] for p in points], np.int64))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(points).bit_length())))

    def halve(span: Column, _: Column) -> Column:
        """How many points are at most the value lies from low to high."""
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        right = (span["low"] < span["high"]) & (F.get(at, middle) <= value)
        return F.struct(F.when(right, middle + 1).otherwise(span["low"]).alias("low"), F.when(right | (span["low"] >= span["high"]), span["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(points)).alias("high"))
    below = F.aggregate(steps, start, halve)["low"]
    near = F.transform(F.array(F.greatest(below - 1, F.lit(0)), F.least(below, F.lit(len(points) - 1))), lambda k: F.struct(F.abs(value - F.get(at, k)).alias("d"), F.get(index, k).alias("i")))
    return F.when(value.isNotNull(), F.array_min(near)["i"]).cast("int")
