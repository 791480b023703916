"""Ranks by ranges, quantiles by digits and nearest points by bisection, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import grid, ranking, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_in_an_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.random()) for _ in range(500)]
    for parts in (1, 7):
        got, n = ranking.ranked(spark.createDataFrame(rows, "a int, b double").repartition(3), ["a", "b"], parts=parts)
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert n == 500 and [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got.collect()) == list(range(1, 501))
    empty, n = ranking.ranked(spark.createDataFrame([], "a int"), ["a"])
    assert n == 0 and empty.collect() == []


def test_no_task_sorts_everything(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("e"), F.col("id").alias("o"), F.lit("2022-01-01").cast("date").alias("d"))
    axis = spark.createDataFrame([(10.0 * i, i) for i in range(36)], "lon double, lon_idx int")
    for out in (splits.split_by_entities(df, "e", "d", "o"), grid.wrap_and_sort(axis)):
        assert "SinglePartition" not in plan(out) and "Window" not in plan(out)
    assert [r.lon_idx for r in grid.wrap_and_sort(axis).orderBy("lon").collect()] == list(range(36))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_quantiles_of_hot_keys(spark, q):
    rng = np.random.default_rng(2)
    values = {"a": np.r_[rng.normal(size=400) * 1e5, -0.0, 0.0, 1e300, -1e300, 5e-324], "b": rng.integers(0, 5, 301) * 1.0, "c": rng.normal(size=7), None: rng.normal(size=250)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r.x for r in grid.quantile_by_cell(df, ["k"], "v", q, "x", hot=200).collect()}
    assert got == {k: pytest.approx(float(np.quantile(vs, q)), rel=1e-12) for k, vs in values.items()} | {"d": None}
    assert {r.k: r.x for r in grid.quantile_by_cell(df, ["k"], "v", q, "x").collect()} == {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in got.items()}


def test_nearest_of_3600_points(spark):
    axis = [round(-179.95 + 0.1 * i, 2) for i in range(3_600)]
    rng = random.Random(3)
    for points in (axis, rng.sample(axis, 500), [5.0], [3.0, 1.0, 3.0, 2.0, 1.0]):
        values = [rng.uniform(-200, 200) for _ in range(300)] + [axis[7], 2.0, 2.5, 1.5, None]
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", grid.nearest_on_axis(F.col("v"), points).alias("i")).collect()
        for r in got:
            assert r.i == (None if r.v is None else min(range(len(points)), key=lambda i, v=r.v: (abs(v - points[i]), i)))
    depth = lambda n: plan(spark.range(1).select(grid.nearest_on_axis(F.col("id") * 1.0, axis[:n]))).count("abs(")
    assert depth(36) == depth(3_600)
