"""The data source of gridded files: values, pushed bounds, bytes read, and the kinds of the format."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.sources import netcdf


def cube(t, y, x, seed=1):
    out = np.random.default_rng(seed).normal(size=(t, y, x)).astype(np.float32)
    out[0, 1, 2] = np.nan
    return out


LAT, LON = np.linspace(90, -90, 7), np.arange(0.0, 360.0, 45.0)


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("records", [True, False])
def test_values_of_several_files(spark, tmp_path, wide, records):
    cubes = {}
    for k in range(2):
        path = str(tmp_path / f"{k}.nc")
        a, b = cube(5, 7, 8, k), cube(5, 7, 8, k + 9)
        a[3, 2, 1] = -999.0
        netcdf.write_classic(path, LAT, LON, np.arange(5) * 24.0 + k, {"t2m": a, "pr": b}, -999.0, wide, records)
        cubes[path] = np.where(a == -999.0, np.nan, a)
    got = netcdf.read_gridded(spark, str(tmp_path / "*.nc"), "t2m", 60)
    rows = got.collect()
    assert len(rows) == 2 * 5 * 7 * 8 and got.rdd.getNumPartitions() == 2 * 5
    for r in rows:
        value = cubes[r.path][r.step, r.lat_idx, r.lon_idx]
        assert (r.lat, r.lon) == (LAT[r.lat_idx], LON[r.lon_idx]) and r.time == r.step * 24.0 + int(r.path[-4])
        assert r.value is None if np.isnan(value) else r.value == value
    held = got.where("step between 1 and 2 and lat > 10 and lon = 90").select("step", "lat", "lon").distinct().collect()
    assert {tuple(r) for r in held} == {(s, y, 90.0) for s in (1, 2) for y in LAT if y > 10}
    assert got.where("step > 77").count() == 0


def test_a_months_bounds_read_its_bytes_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.nc")
    netcdf.write_classic(path, LAT, LON, np.arange(40.0), {"x": cube(40, 7, 8)})
    reader = netcdf.Reader([path], "x", 1_000)
    bounds = [netcdf.GreaterThanOrEqual(("step",), 7), netcdf.LessThan(("step",), 9), netcdf.GreaterThan(("lat",), 50.0)]
    assert list(reader.pushFilters(bounds)) == bounds
    spans = []
    span = netcdf.Header.span
    monkeypatch.setattr(netcdf.Header, "span", lambda self, v, *a: spans.append((v, *span(self, v, *a))) or span(self, v, *a))
    parts = reader.partitions()
    values = [b.column("value").to_pylist() for p in parts for b in reader.read(p)]
    read = sum(size for v, _, size in spans if len(v.shape) == 3)
    assert [p.steps for p in parts] == [(7, 10)] and sum(map(len, values)) == 3 * 2 * 8 and read == 3 * 2 * 8 * 4
    wide = netcdf.Reader([path], "x", 1_000)
    assert sum(len(b) for p in wide.partitions() for b in wide.read(p)) == 40 * 7 * 8


def test_steps_as_a_grid_of_months(spark, tmp_path):
    """The chain that the monthly means take: steps since a date to months, cells to a mean."""
    path = str(tmp_path / "m.nc")
    values = cube(12, 7, 8)
    netcdf.write_classic(path, LAT, LON, np.arange(12.0), {"x": values})
    months = netcdf.read_gridded(spark, path, "x").withColumn("month", F.add_months(F.lit("2000-01-01").cast("date"), F.col("step")))
    got = {r.month.month: r.mean for r in months.where("month >= date'2000-03-01'").groupBy("month").agg(F.avg("value").alias("mean")).collect()}
    assert got == {k + 1: pytest.approx(float(np.nanmean(values[k].astype(float)))) for k in range(2, 12)}


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"HDF...")
    with pytest.raises(ValueError, match="classic"):
        netcdf.Header(str(tmp_path / "x.nc"))
    netcdf.write_classic(str(tmp_path / "y.nc"), LAT, LON, np.arange(2.0), {"x": cube(2, 7, 8)})
    with pytest.raises(ValueError, match="latitude"):
        netcdf.Reader([str(tmp_path / "y.nc")], "lat", 10).partitions()
