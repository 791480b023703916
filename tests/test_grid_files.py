"""Stored grids: order by the curve, and what is read for a few points."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewheel.functions.curve import cell_code
from tidewheel.operators import grid
from tidewheel.sources import tables


def made(spark, lats=120, lons=200, months=18):
    cells = spark.range(lats * lons * months).select((F.col("id") % lats).cast("int").alias("lat_idx"), (F.col("id") / lats % lons).cast("int").alias("lon_idx"), F.floor(F.col("id") / (lats * lons)).cast("int").alias("k"))
    return cells.select("lat_idx", "lon_idx", F.add_months(F.lit("2000-01-01").cast("date"), F.col("k")).alias("month"), F.rand(3).alias("value"))


def test_curve(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (5, 3), (1799, 3599), (2**31 - 1, 2**31 - 1)]
    got = [r.c for r in spark.createDataFrame(pairs, "a int, b int").select(cell_code(F.col("a"), F.col("b")).alias("c")).collect()]
    weave = lambda a, b: sum(((b >> k & 1) << 2 * k) | ((a >> k & 1) << 2 * k + 1) for k in range(31))
    assert got == [weave(*p) for p in pairs]


def test_a_hundred_points_read_a_few_row_groups(spark, tmp_path):
    path, rng = str(tmp_path / "grid"), random.Random(4)
    whole = made(spark).persist()
    tables.write_grid(whole, path, {"value": "unit"}, row_group=1 << 16)
    places = {(10 * rng.randrange(2) + rng.randrange(5), 100 + rng.randrange(12)) for _ in range(100)}
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(sorted(places))], "plant int, lat_idx int, lon_idx int")
    got = tables.read_cells(spark, path, points, "2000-03-01", "2001-02-01")
    want = whole.where("month between '2000-03-01' and '2001-02-01'").join(points.drop("plant"), ["lat_idx", "lon_idx"], "left_semi")
    key = lambda r: (r.lat_idx, r.lon_idx, r.month, r.value)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and set(got.columns) == set(whole.columns)
    ranges, groups, hit = tables.cell_ranges(points), 0, 0
    for file in glob.glob(f"{path}/year=*/*.parquet"):
        meta = pq.read_metadata(file)
        at = [meta.row_group(0).column(c).path_in_schema for c in range(meta.num_columns)].index("cell")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            groups, hit = groups + 1, hit + any(stats.min <= b and a <= stats.max for a, b in ranges)
    assert groups >= 40 and hit <= groups / 8
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = tables.read_cells(spark, path, points)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(cell" in plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert grid.at_points(got, points, ["month", "value"]).count() == 12 * len(places)


def test_ranges_hold_all_cells_and_are_few(spark):
    rng = random.Random(5)
    for n, most, ranges in ((300, 50, 8), (300, 4_096, 64), (1, 10, 3)):
        points = spark.createDataFrame([(rng.randrange(1_800), rng.randrange(3_600)) for _ in range(n)], "lat_idx int, lon_idx int")
        found = tables.cell_ranges(points, most, ranges)
        codes = [r.c for r in points.select(cell_code(F.col("lat_idx"), F.col("lon_idx")).alias("c")).collect()]
        assert len(found) <= ranges and all(any(a <= c <= b for a, b in found) for c in codes)
        assert all(b < c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert tables.cell_ranges(points.where("false")) == []
