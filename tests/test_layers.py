"""Gridded files and vector layers as DataFrames."""

import struct

import numpy as np
from pyspark.sql import functions as F

from tidewheel.operators import grid
from tidewheel.sources import tables


def test_steps_of_several_files(spark, tmp_path):
    cubes, paths = [], []
    for k in range(3):
        cube = np.arange(24, dtype=float).reshape(2, 3, 4) + 100 * k
        cube[0, 1, 2] = np.nan
        cubes.append(cube)
        paths.append(str(tmp_path / f"{k}.npz"))
        np.savez(paths[-1], lat=np.array([10.0, 0.0, -10.0]), lon=np.array([0.0, 90.0, 180.0, 270.0]), runoff=cube)

    def reader(path, variable):
        data = np.load(path)
        return data["lat"], data["lon"], iter(data[variable])

    got = tables.read_steps(spark, paths, "runoff", reader)
    rows = got.collect()
    assert len(rows) == 72 and sum(r.value is None for r in rows) == 3
    for r in rows:
        value = cubes[paths.index(r.path)][r.step, r.lat_idx, r.lon_idx]
        assert (r.lat, r.lon) == ([10.0, 0.0, -10.0][r.lat_idx], [0.0, 90.0, 180.0, 270.0][r.lon_idx])
        assert (r.value is None and np.isnan(value)) or r.value == value
    assert tables.read_steps(spark, [], "runoff", reader).count() == 0


def write_layer(path, kind, shapes, names):
    records = b""
    for k, parts in enumerate(shapes):
        if not parts:
            body = struct.pack("<i", 0)
        elif kind == 1:
            body = struct.pack("<i2d", 1, *parts[0][0])
        else:
            points = [p for part in parts for p in part]
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            body = struct.pack("<i4d2i", kind, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + np.array(points, "<f8").tobytes()
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
    with open(f"{path}.shp", "wb") as file:
        file.write(struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", (100 + len(records)) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + records)
    with open(f"{path}.dbf", "wb") as file:
        field = lambda name, size: name.ljust(11, "\0").encode() + b"C" + bytes(4) + bytes([size]) + bytes(15)
        file.write(bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(names), 32 + 64 + 1, 1 + 12 + 4) + bytes(20) + field("NAME", 12) + field("ID", 4) + b"\r")
        for i, name in enumerate(names):
            file.write(b" " + name.encode().ljust(12) + str(i).encode().rjust(4))


def test_polygon_and_point_layers(spark, tmp_path):
    square, hole = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (0.5, 1.0), (1.0, 1.0), (0.5, 0.5)]
    write_layer(tmp_path / "lands", 5, [[square, hole], [], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]], ["Some land", "Nowhere", "Farland"])
    write_layer(tmp_path / "dams", 1, [[[(3.5, -1.25)]], [[(7.0, 8.0)]]], ["One", "Two"])
    lands = {r.id: r for r in tables.read_layer(spark, str(tmp_path / "lands")).collect()}
    assert [[tuple(p) for p in part] for part in lands[0].rings] == [square, hole] and lands[1].rings == [] and lands[2].attributes["NAME"] == "Farland"
    assert lands[0].attributes == {"NAME": "Some land", "ID": "0"}
    dams = tables.read_layer(spark, str(tmp_path / "dams")).select(F.col("attributes")["ID"].alias("id"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"))
    assert sorted(map(tuple, dams.collect())) == [("0", 3.5, -1.25), ("1", 7.0, 8.0)]
    cells = spark.createDataFrame([("m", 1.5, 1.5, 4.0), ("m", 9.0, 9.0, 8.0)], "month string, lon double, lat double, value double")
    shapes = tables.read_layer(spark, str(tmp_path / "lands")).where(F.size("rings") > 0).select("id", F.col("rings")[0].alias("ring"))
    assert [tuple(r) for r in grid.mean_inside(cells, shapes, "value", "mean").collect()] == [(0, "m", 4.0)]


def test_deleted_records_are_left_out(spark, tmp_path):
    write_layer(tmp_path / "dams", 1, [[[(3.5, -1.25)]], [[(7.0, 8.0)]], [[(9.0, 9.0)]]], ["One", "Two", "Three"])
    raw = bytearray((tmp_path / "dams.dbf").read_bytes())
    raw[32 + 64 + 1 + 17] = ord("*")
    (tmp_path / "dams.dbf").write_bytes(bytes(raw))
    assert [(r.id, r.attributes["NAME"]) for r in tables.read_layer(spark, str(tmp_path / "dams")).orderBy("id").collect()] == [(0, "One"), (2, "Three")]
