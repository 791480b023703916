"""Queries by name, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The monthly series of an entity that stands for river discharge: each supplier's sales.
SERIES = """
    series AS (SELECT l_suppkey AS plant_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS value
               FROM lineitem GROUP BY ALL)
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("plant_id"), F.trunc("l_shipdate", "month").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
