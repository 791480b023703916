"""Lookups: joins with dimension tables as maps.

Dimensions are plain joins: the optimizer broadcasts those under spark.sql.autoBroadcastJoinThreshold
by their size and shuffles larger ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.dedup import drop_ambiguous, keep_first, keep_last
from tidewheel.operators.matching import best_matches


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], values: Mapping[str, str], ordinal: str | None = None) -> DataFrame:
    """JN-1, JN-2, JN-4, JN-6: left join on keys (df's: dim's), adding values (new name: dim's).

    With an ordinal, the last of dim's duplicates counts; without, dim's keys must be unique.
    """
    keys = list(on.values())
    if ordinal:
        dim = keep_last(dim, keys, ordinal)
    side = dim.select(*(dim[d].alias(f"_k_{i}") for i, d in enumerate(keys)), *(dim[v].alias(n) for n, v in values.items()))
    condition = [df[c] == side[f"_k_{i}"] for i, c in enumerate(on)]
    return df.join(side, condition, "left").drop(*(f"_k_{i}" for i in range(len(keys))))


def lookup_unique(df: DataFrame, dim: DataFrame, on: Mapping[str, str], values: Mapping[str, str]) -> DataFrame:
    """JN-7: as lookup, but keys that dim has twice give nothing."""
    return lookup(df, drop_ambiguous(dim, list(on.values())), on, values)


def lookup_first_or(df: DataFrame, dim: DataFrame, on: Mapping[str, str], values: Mapping[str, str], ordinal: str, default) -> DataFrame:
    """JN-8: the first of dim's duplicates, the default where there is none."""
    out = lookup(df, keep_first(dim, list(on.values()), [ordinal]), on, values)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(default)) for n in values})


def lookup_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, Mapping[str, str], Mapping[str, str]]]) -> DataFrame:
    """JN-5: one lookup after another."""
    for dim, on, values in steps:
        df = lookup(df, dim, on, values)
    return df


def override(df: DataFrame, dim: DataFrame, on: Mapping[str, str], column: str, value: str) -> DataFrame:
    """PRJ-8: dim's value where it has one, else the column's."""
    out = lookup(df, dim, on, {"_new": value})
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new")


def fill_from(df: DataFrame, dim: DataFrame, on: Mapping[str, str], column: str, value: str) -> DataFrame:
    """PRJ-9: dim's value only where the column has none."""
    out = lookup(df, dim, on, {"_new": value})
    return out.withColumn(column, F.coalesce(column, "_new")).drop("_new")


def invert(dim: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """JN-9: value to key; the last row of a value counts."""
    return keep_last(dim.select(value, key, ordinal), [value], ordinal).select(value, key)


def outer_total(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """JN-3: full outer join; the sum of the values, with missing ones as 0."""
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return left.join(right, list(keys), "full").select(*keys, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias(value))


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-21, FLT-2."""
    return df.join(ids.select(key), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-21, FLT-3: rows with a missing key stay."""
    return df.join(ids.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def by_source(df: DataFrame, layers: Mapping[str, DataFrame], source: str, source_id: str, manual: tuple[Column, Column]) -> DataFrame:
    """JN-17: x and y of the layer (id, x, y) that the row's source names; of any other or no source, the manual ones.

    A known source without the id gives missing coordinates.
    """
    points = None
    for name, layer in layers.items():
        part = layer.select(F.lit(name).alias("_source"), F.col("id").alias("_id"), "x", "y")
        points = part if points is None else points.unionByName(part)
    points = points.groupBy("_source", "_id").agg(F.max_by("x", F.struct("x", "y")).alias("_x"), F.max_by("y", F.struct("x", "y")).alias("_y"))
    known = F.coalesce(F.col(source).isin(list(layers)), F.lit(False))
    out = df.join(points, (df[source] == points["_source"]) & (df[source_id] == points["_id"]), "left")
    return out.withColumns({"x": F.when(known, F.col("_x")).otherwise(manual[0]), "y": F.when(known, F.col("_y")).otherwise(manual[1])}).drop("_source", "_id", "_x", "_y")


def best_names(names: DataFrame, name: str, choices: DataFrame | list[str], overrides: Mapping[str, str] | None = None) -> DataFrame:
    """JN-10, JN-11, SRT-4: (name, match, score, scored): the choice of the best token set ratio, the last by name of equal ones,
    and the number of pairs that were scored for it.

    `choices` is a list or has a column choice. Overrides replace a match. See `operators.matching` for how pairs are avoided.
    """
    if not isinstance(choices, DataFrame):
        choices = names.sparkSession.createDataFrame([(c,) for c in choices], "choice string")
    best = best_matches(names.select(F.col(name).alias("name")), choices)
    if overrides:
        fixed = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
        best = best.withColumn("match", F.coalesce(fixed[F.col("name")], "match"))
    return best
