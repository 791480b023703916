"""Readers and writers (SRC-1 to SRC-17, SNK-1 to SNK-9). Formats that need a further library import it on use; Excel is in
`sources/sheets.py`, classic NetCDF in `sources/netcdf.py`."""

from __future__ import annotations

import os
import re
import struct
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.functions.curve import cell_code
from tidewheel.functions.nulls import nan_to_null


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, sep: str = ",", encoding: str = "UTF-8", date_format: str = "yyyy-MM-dd", skip_malformed: bool = False) -> DataFrame:
    """SRC-1 to SRC-4: with a header and a given schema, so nothing is read twice; NaN is NULL."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("dateFormat", date_format)
    return nan_to_null(reader.option("mode", "DROPMALFORMED" if skip_malformed else "FAILFAST").csv(paths))


def read_grid(spark: SparkSession, paths: str | Sequence[str], first: str | None = None, last: str | None = None, month: str = "month") -> DataFrame:
    """SRC-8 to SRC-12, FLT-13: a long-form Parquet grid (one or several paths), with months from first to last, both included."""
    df = nan_to_null(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)))
    if first:
        df = df.where(F.col(month) >= F.lit(first).cast("date"))
    return df.where(F.col(month) <= F.lit(last).cast("date")) if last else df


Steps = tuple[np.ndarray, np.ndarray, Iterable[np.ndarray]]


def netcdf_steps(path: str, variable: str) -> Steps:
    """Latitudes, longitudes and one matrix for each step of a NetCDF variable. Needs netCDF4."""
    import netCDF4

    data = netCDF4.Dataset(path)
    cube = data.variables[variable]
    return np.asarray(data.variables["lat"][:]), np.asarray(data.variables["lon"][:]), (np.ma.filled(cube[t].astype(float), np.nan) for t in range(cube.shape[0]))


def raster_steps(path: str, variable: str) -> Steps:
    """The centres of a raster's rows and columns, and its bands as steps. Needs rasterio; variable is not looked at."""
    import rasterio

    data = rasterio.open(path)
    t = data.transform
    return t.f + t.e * (np.arange(data.height) + 0.5), t.c + t.a * (np.arange(data.width) + 0.5), (data.read(b + 1, masked=True).astype(float).filled(np.nan) for b in range(data.count))


def read_steps(spark: SparkSession, paths: Sequence[str], variable: str, reader: Callable[[str, str], Steps] = netcdf_steps) -> DataFrame:
    """SRC-8, SRC-10, SRC-12: gridded files in long form (path, step, lat_idx, lon_idx, lat, lon, value), NaN as NULL.

    A task reads a file, by the given reader, and hands on one step at a time; paths must be readable by all executors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                lat, lon, steps = reader(path, variable)
                i, j = np.repeat(np.arange(len(lat), dtype=np.int32), len(lon)), np.tile(np.arange(len(lon), dtype=np.int32), len(lat))
                for t, values in enumerate(steps):
                    columns = [pa.array([path] * len(i)), pa.array(np.full(len(i), t, np.int32)), pa.array(i), pa.array(j), pa.array(lat[i].astype(float)), pa.array(lon[j].astype(float)), pa.array(values.ravel().astype(float), from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "step", "lat_idx", "lon_idx", "lat", "lon", "value"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, "path string, step int, lat_idx int, lon_idx int, lat double, lon double, value double")


def _dbf_rows(raw: bytes) -> list[dict[str, str] | None]:
    """The attribute table of a layer, all values as trimmed text; None for a record that is marked as deleted."""
    n, start, width = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(), raw[at + 16]))
        at += 32
    out = []
    for k in range(n):
        at, row = start + k * width + 1, {}
        for name, size in fields:
            row[name] = raw[at : at + size].decode("utf-8", "replace").strip()
            at += size
        out.append(None if raw[start + k * width] == ord("*") else row)
    return out


def _shp_rings(raw: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Of each record the parts with their points; a point is one part, an empty record has none."""
    at = 100
    while at < len(raw):
        size = struct.unpack(">i", raw[at + 4 : at + 8])[0] * 2
        body, at = raw[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield []
        elif kind in (1, 11, 21):
            yield [[struct.unpack("<2d", body[4:20])]]
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
            yield [[tuple(p) for p in xy[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"layers of type {kind} aren't read")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: a point, line or polygon layer, path.shp with path.dbf (or a pattern of several): (path, id, rings, attributes as text).

    Files come by Spark's binary reader, so from any file system; a task parses one layer. Records that are marked as deleted are
    left out; the id is the record's number, so pick an attribute where shapes are known by one.
    """
    files = spark.read.format("binaryFile").load([f"{path}.shp", f"{path}.dbf"]).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("path"), F.right("path", F.lit(3)).alias("kind"), "content")
    layers = files.groupBy("path").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer in batch.to_pylist():
                records = [(k, parts, row) for k, (parts, row) in enumerate(zip(_shp_rings(layer["shp"]), _dbf_rows(layer["dbf"]), strict=True)) if row is not None]
                shown = [[[{"x": x, "y": y} for x, y in part] for part in parts] for _, parts, _ in records]
                columns = [pa.array([layer["path"]] * len(records)), pa.array([k for k, _, _ in records], pa.int32()), pa.array(shown, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), pa.array([list(row.items()) for _, _, row in records], pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "id", "rings", "attributes"])

    return layers.mapInArrow(run, "path string, id int, rings array<array<struct<x: double, y: double>>>, attributes map<string, string>")


def positional(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    """SRC-6, PRJ-5: columns by position under new names."""
    return df.select(*(df[df.columns[i]] for i in positions)).toDF(*names)


def text_columns(df: DataFrame) -> list[str]:
    """PRJ-5: names of the string columns."""
    return [n for n, t in df.dtypes if t == "string"]


def table_rows(df: DataFrame, ordinal: str, columns: Sequence[int], names: Sequence[str], end: str = "total") -> DataFrame:
    """SRC-7 after the extraction of a PDF table: named columns by position, rows before the one that begins with the end word (not with a longer one)."""
    first = F.lower(F.trim(df[df.columns[columns[0]]]))
    stop = df.where(first.rlike(rf"^{re.escape(end)}\b")).agg(F.min(ordinal).alias("_stop"))
    kept = df.join(stop).where(F.col("_stop").isNull() | (F.col(ordinal) < F.col("_stop"))).drop("_stop")
    return positional(kept, columns, names)


def list_files(folder: str, suffix: str, recursive: bool = False) -> list[str]:
    """SRC-14: sorted paths."""
    return sorted(str(p) for p in (Path(folder).rglob if recursive else Path(folder).glob)(f"*{suffix}"))


def file_part(separator: str = "_", index: int = 0) -> Column:
    """SRC-15: a part of the row's file name without its extension, from the end if the index is negative."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return F.try_element_at(F.split(name, separator), F.lit(index + 1 if index >= 0 else index))


def guarded(path: str, missing: str = "raise", spark: SparkSession | None = None) -> bool:
    """SRC-16: whether a path is there and not empty; "raise", or "skip" if it is not. With a session the path may be in any file
    system that Spark knows."""
    if spark is None:
        there = os.path.exists(path) and (os.path.isdir(path) or os.path.getsize(path) > 0)
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = files.exists(at) and (files.getFileStatus(at).isDirectory() or files.getFileStatus(at).getLen() > 0)
    if not there and missing == "raise":
        raise FileNotFoundError(path)
    return there


def download(jobs: Mapping[str, Callable[[str], None]], attempts: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep, side: int = 4) -> list[str]:
    """SRC-13: {target path: function that writes it}, `side` at a time. Targets that exist are skipped, failures tried again; paths
    that failed are returned, in the order given.

    Credentials are the callers', from the environment. A file takes its name when it is complete.
    """

    def done(target: str, fetch: Callable[[str], None]) -> bool:
        if os.path.exists(target):
            return True
        for turn in range(attempts):
            try:
                fetch(target + ".part")
                os.replace(target + ".part", target)
                return True
            except OSError:
                if turn + 1 < attempts:
                    sleep(wait)
        return False

    with ThreadPoolExecutor(side) as pool:
        return [target for target, ok in zip(jobs, pool.map(done, jobs, jobs.values()), strict=True) if not ok]


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-1, SNK-7."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_entity(df: DataFrame, path: str, key: str) -> None:
    """SNK-3, SNK-7: one folder for each entity. Rows are dealt by the key first, so a folder has one file, or several where an
    entity has so many rows that adaptive execution splits its partition."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)


def write_grid(df: DataFrame, path: str, comments: Mapping[str, str] | None = None, month: str = "month", row_group: int = 8 << 20) -> None:
    """SNK-4 to SNK-6: Parquet with zstd, by year, with comments of columns as metadata. A grid with lat_idx and lon_idx is ordered
    by a space-filling curve over its cells (column cell) within the year, in row groups of about so many bytes, so that
    `read_cells` finds a few places in a few of them; ranges of the curve share out a year's work."""
    for name, text in (comments or {}).items():
        df = df.withMetadata(name, {"comment": text})
    df = df.withColumn("year", F.year(month))
    if {"lat_idx", "lon_idx"} <= set(df.columns):
        df = df.withColumn("cell", cell_code(F.col("lat_idx"), F.col("lon_idx")))
        df = df.repartitionByRange("year", "cell").sortWithinPartitions("year", "cell", month)
    else:
        df = df.repartition("year")
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group).partitionBy("year").parquet(path)


def cell_ranges(points: DataFrame, most: int = 4_096, ranges: int = 64) -> list[tuple[int, int]]:
    """Ranges of the curve that hold all cells (lat_idx, lon_idx) of points: at most so many, with the largest gaps left out. Many
    cells are looked at in blocks, of which the driver gets `most` numbers at most."""
    codes = points.select(cell_code(F.col("lat_idx"), F.col("lon_idx")).alias("c")).where("c is not null").distinct()
    shifts = range(0, 64, 4)
    counts = codes.agg(*(F.countDistinct(F.shiftright("c", s)).alias(f"n{s}") for s in shifts)).first()
    shift = next(s for s in shifts if counts[f"n{s}"] <= most)
    blocks = sorted(r.b for r in codes.select(F.shiftright("c", shift).alias("b")).distinct().collect())
    gaps = sorted(range(1, len(blocks)), key=lambda k: blocks[k - 1] - blocks[k])[: ranges - 1]
    cuts = [0, *sorted(k for k in gaps if blocks[k] - blocks[k - 1] > 1), len(blocks)]
    return [(blocks[a] << shift, (blocks[b - 1] + 1 << shift) - 1) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def read_cells(spark: SparkSession, path: str, points: DataFrame, first: str | None = None, last: str | None = None, month: str = "month") -> DataFrame:
    """SRC-9, FLT-13 and JN-14 for a grid that write_grid wrote: its rows at the cells (lat_idx, lon_idx) of points, within the
    months. Ranges of the curve are pushed to the files, whose row groups keep their least and largest cell."""
    df = read_grid(spark, path, None, None, month)
    near = F.lit(False)
    for low, high in cell_ranges(points):
        near = near | F.col("cell").between(low, high)
    df = df.where(near)
    for bound, keep, year in ((first, F.col(month) >= F.lit(first).cast("date"), F.col("year") >= F.year(F.lit(first).cast("date"))), (last, F.col(month) <= F.lit(last).cast("date"), F.col("year") <= F.year(F.lit(last).cast("date")))):
        df = df.where(keep & year) if bound else df
    places = points.select("lat_idx", "lon_idx").distinct()
    return df.join(places, ["lat_idx", "lon_idx"], "left_semi").drop("cell", "year")
