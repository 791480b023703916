"""Points in shapes by the quadtree cover, against the crossings of a ray in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_layers import write_layer
from tidewheel.operators import grid, shapes
from tidewheel.sources import tables

RINGS = "id int, rings array<array<struct<x: double, y: double>>>"


def plain(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax
    return n % 2 == 1


def coast(n, x, y, r, rng, wild=0.4):
    return [(x + r * (1 + wild * rng.uniform(-1, 1)) * math.cos(2 * math.pi * k / n), y + r * (1 + wild * rng.uniform(-1, 1)) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_parts_holes_and_points_on_borders(spark):
    rng = random.Random(1)
    square = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a)]
    lands = {
        1: [square(0.0, 0.0, 8.0), square(2.0, 2.0, 4.0), square(3.0, 3.0, 1.0), square(20.0, -5.0, 2.0)],  # a hole, an island in it, one far off
        2: [coast(400, 10.0, 10.0, 6.0, rng), coast(100, 10.0, 10.0, 2.0, rng)],
        3: [[(float(rng.randint(-9, 9)), float(rng.randint(-9, 9))) for _ in range(80)]],  # crosses itself on whole degrees
        4: [[(5.0, 5.0)], [(1.0, 1.0), (1.0, 1.0)]],
        5: [],
    }
    places = [(x / 2, y / 2) for x in range(-24, 48) for y in range(-24, 40)] + [(rng.uniform(-12, 24), rng.uniform(-12, 20)) for _ in range(2000)]
    points = spark.createDataFrame([*places, (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "lon double, lat double").distinct()
    made = shapes.cover(spark.createDataFrame(list(lands.items()), RINGS), most=6)
    got = sorted(tuple(r) for r in shapes.members(points, made).collect())
    assert got == sorted((*p, i) for i, rings in lands.items() for p in set(places) if plain(*p, rings))
    assert {r.id for r in made.cells.select("id").distinct().collect()} == {1, 2, 3}
    assert made.cells.where("size(edges) = 0").count() > 20


def test_cells_hold_few_edges_however_long_the_ring(spark):
    rng = random.Random(2)
    for n in (500, 8_000):
        ring, places = coast(n, 0.0, 0.0, 60.0, rng, 0.02), [(rng.uniform(-70, 70), rng.uniform(-70, 70)) for _ in range(300)]
        made = shapes.cover(spark.createDataFrame([(1, [ring])], RINGS))
        got = {tuple(r)[:2] for r in shapes.members(spark.createDataFrame(places, "lon double, lat double"), made).collect()}
        assert got == {p for p in places if plain(*p, [ring])}
        assert made.cells.agg(F.max(F.size("edges"))).first()[0] <= shapes.EDGES


def test_no_shapes_and_bad_corners(spark):
    points = spark.createDataFrame([(1.0, 1.0)], "lon double, lat double")
    assert shapes.members(points, shapes.cover(spark.createDataFrame([], RINGS))).collect() == []
    with pytest.raises(Exception, match="not finite"):
        shapes.cover(spark.createDataFrame([(1, [[(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)]])], RINGS))


def test_layers_of_parts_go_straight_in(spark, tmp_path):
    outer, hole = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)], [(1.5, 1.5), (1.5, 4.5), (4.5, 4.5), (4.5, 1.5), (1.5, 1.5)]
    island = [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0), (10.0, 10.0)]
    write_layer(tmp_path / "lands", 5, [[outer, hole, island], []], ["Ringland", "Nowhere"])
    cells = spark.createDataFrame([(m, float(x), float(y), float(100 * x + y + k)) for k, m in enumerate(("m1", "m2")) for x in range(14) for y in range(14)], "month string, lon double, lat double, value double")
    got = {tuple(r)[:2]: r.mean for r in grid.mean_inside(cells, tables.read_layer(spark, str(tmp_path / "lands")), "value", "mean").collect()}
    held = [(x, y) for x in range(14) for y in range(14) if plain(float(x), float(y), [outer[:-1], hole[:-1], island[:-1]])]
    assert got == {(0, m): pytest.approx(sum(100 * x + y + k for x, y in held) / len(held)) for k, m in enumerate(("m1", "m2"))}


def test_only_missing_months_come_from_the_shape(spark):
    rows = [(0, 0, 0.5, 0.5, "m1", 2.0), (0, 0, 0.5, 0.5, "m2", None), (1, 0, 1.5, 0.5, "m1", 4.0), (1, 0, 1.5, 0.5, "m2", 6.0)]
    cells = spark.createDataFrame(rows, "lat_idx int, lon_idx int, lon double, lat double, month string, value double")
    countries = spark.createDataFrame([(0, 0, 7)], "lat_idx int, lon_idx int, country_code int")
    lands = spark.createDataFrame([(7, [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]])], RINGS)
    got = sorted(map(tuple, grid.country_mean_or_inside(cells, countries, lands, "value", "mean").collect()))
    assert got == [(7, "m1", 2.0), (7, "m2", 6.0)]
    named = lambda df, crs: df.withColumn("crs", F.lit(crs))
    assert grid.country_mean_or_inside(named(cells, "EPSG:4326"), countries, lands, "value", "mean").count() == 2
    for a, b in ((named(cells, "EPSG:3857"), lands), (cells, named(lands, "EPSG:3857")), (named(cells, "a"), named(lands, "b"))):
        with pytest.raises(Exception, match="coordinate systems"):
            grid.country_mean_or_inside(a, countries, b, "value", "mean").collect()
    two = named(lands, "EPSG:4326").union(named(lands.withColumn("id", F.lit(8)), "EPSG:3857"))
    with pytest.raises(Exception, match="coordinate systems"):
        grid.country_mean_or_inside(cells, countries, two, "value", "mean").collect()


@pytest.mark.parametrize("few", [True, False])
def test_points_of_few_latitudes_need_no_cover(spark, monkeypatch, few):
    """Edges that span the whole map gave a cover that grows with their square. Points of one latitude go to several tasks."""
    rng = random.Random(5)
    zigzag = lambda n: [(rng.uniform(-60, 60), rng.randint(-40, 40) + 0.5 * rng.randint(0, 1)) for _ in range(n)]
    lands = {1: [zigzag(150), zigzag(3)], 2: [zigzag(40)], 3: []}
    places = [(rng.uniform(-60, 60), float(y)) for y in range(-42, 43, 4) for _ in range(20)] + [(lands[2][0][0]), (1.5, -0.0), (1.5, 0.0)]
    points = spark.createDataFrame([*places, (None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))], "lon double, lat double")
    monkeypatch.setattr(shapes, "ROWS", 7)
    monkeypatch.setattr(*((shapes, "cover", lambda *a: pytest.fail("a cover was made")) if few else (shapes, "LINES", 5)))
    got = sorted(tuple(r) for r in shapes.located(points, spark.createDataFrame(list(lands.items()), RINGS)).collect())
    assert got == sorted((*p, i) for i, rings in lands.items() for p in places if plain(*p, rings))
    assert shapes.located(points.where("false"), spark.createDataFrame(list(lands.items()), RINGS)).collect() == []
    assert shapes.located(points, spark.createDataFrame([], RINGS)).collect() == []
