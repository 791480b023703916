"""Gridded files in the classic NetCDF format as a Spark data source (SRC-8 to SRC-10).

    read_gridded(spark, "/shared/era5/*.nc", "t2m").where("step between 0 and 11 and lat > 40")

Rows are (path, step, time, lat_idx, lon_idx, lat, lon, value), fill values and NaN as NULL. A partition is a file, a range of
its steps and a band of its latitudes; bounds on step, lat and lon are pushed down, so only the bytes within them are read.
The header is read by its published layout (classic, 64-bit offset and 64-bit data); files must be mounted on all machines.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

SCHEMA = "path string, step int, time double, lat_idx int, lon_idx int, lat double, lon double, value double"
#: Values of a partition, at most one step of one latitude more; values of a batch.
PARTITION, BATCH = 4_000_000, 250_000
#: Type codes of the format, in order from 1.
TYPES = dict(enumerate(("i1", "S1", ">i2", ">i4", ">f4", ">f8", "u1", ">u2", ">u4", ">i8", ">u8"), 1))
NAMES = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "time": ("time", "valid_time")}


@dataclass
class Variable:
    dims: list[str]
    attributes: dict
    kind: str
    begin: int
    record: bool
    shape: list[int]


class Header:
    """Dimensions and variables of a file; record variables lie one record after another."""

    def __init__(self, path: str):
        with open(path, "rb") as self._file:
            magic = self._file.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} isn't a classic NetCDF file")
            self._wide = ">q" if magic[3] == 5 else ">i"
            self._offset = ">i" if magic[3] == 1 else ">q"
            self.records = self._number()
            dims = self._list(lambda: (self._name(), self._number()))
            self.attributes = dict(self._list(self._attribute))
            sizes = [n for _, n in dims]
            self.dims = dict(dims)
            self.variables: dict[str, Variable] = {}
            for name, ids, attributes, kind, begin in self._list(self._variable):
                record = bool(ids) and sizes[ids[0]] == 0
                self.variables[name] = Variable([dims[i][0] for i in ids], attributes, TYPES[kind], begin, record, [sizes[i] for i in ids])
        kept = [v for v in self.variables.values() if v.record]
        widths = [int(np.prod(v.shape[1:], dtype=np.int64)) * np.dtype(v.kind).itemsize for v in kept]
        self.stride = widths[0] if len(kept) == 1 else sum(-(-w // 4) * 4 for w in widths)
        if self.records < 0 and kept:  # written as a stream
            self.records = (os.path.getsize(path) - min(v.begin for v in kept)) // self.stride
        for v in kept:
            v.shape[0] = self.records

    def _read(self, form: str) -> int:
        return struct.unpack(form, self._file.read(struct.calcsize(form)))[0]

    def _number(self) -> int:
        return self._read(self._wide)

    def _padded(self, size: int) -> bytes:
        return self._file.read(-(-size // 4) * 4)[:size]

    def _name(self) -> str:
        return self._padded(self._number()).decode()

    def _list(self, item) -> list:
        self._read(">i")
        return [item() for _ in range(self._number())]

    def _attribute(self) -> tuple[str, object]:
        name, kind, n = self._name(), self._read(">i"), self._number()
        raw = self._padded(n * np.dtype(TYPES[kind]).itemsize)
        return name, raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()

    def _variable(self) -> tuple[str, list[int], dict, int, int]:
        name = self._name()
        ids = [self._number() for _ in range(self._number())]
        attributes, kind = dict(self._list(self._attribute)), self._read(">i")
        self._number()  # its size, which follows from its shape
        return name, ids, attributes, kind, self._read(self._offset)

    def named(self, what: str) -> str | None:
        return next((n for n in NAMES[what] if n in self.variables), None)

    def span(self, v: Variable, step: int, first: int, count: int) -> tuple[int, int]:
        """Offset and length in bytes of `count` values from the flat place `first` of a step."""
        size = np.dtype(v.kind).itemsize
        per = int(np.prod(v.shape[1:], dtype=np.int64))
        return v.begin + (step * self.stride if v.record else step * per * size) + first * size, count * size

    def read(self, file, v: Variable, step: int, first: int, count: int) -> np.ndarray:
        """Values as doubles, scaled by the variable's attributes, missing ones as NaN."""
        offset, size = self.span(v, step, first, count)
        file.seek(offset)
        raw = np.frombuffer(file.read(size), v.kind)
        out = raw.astype(np.float64)
        for name in ("_FillValue", "missing_value"):
            for fill in v.attributes.get(name, []):
                out[raw == np.dtype(v.kind).type(fill)] = np.nan
        return out * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]

    def axis(self, file, name: str | None, size: int) -> np.ndarray:
        if name is None:
            return np.arange(size, dtype=np.float64)
        v = self.variables[name]
        if not v.record:
            return self.read(file, v, 0, 0, size)
        return np.array([self.read(file, v, k, 0, 1)[0] for k in range(size)])


@dataclass
class Part(InputPartition):
    path: str
    steps: tuple[int, int]
    rows: tuple[int, int]


class Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], variable: str, most: int):
        self.paths, self.variable, self.most = list(paths), variable, most
        self.low = {"step": -np.inf, "lat": -np.inf, "lon": -np.inf}
        self.high = {"step": np.inf, "lat": np.inf, "lon": np.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds narrow what is read; Spark still applies all of them to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.low and f.value is not None:
                name = f.attribute[0]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], float(f.value))
            yield f

    def _cube(self, header: Header) -> tuple[Variable, int, int, int]:
        v = header.variables[self.variable]
        lat, lon = (header.dims[header.variables[n].dims[0]] if (n := header.named(k)) else v.shape[d] for k, d in (("lat", -2), ("lon", -1)))
        if len(v.shape) not in (2, 3) or v.shape[-2:] != [lat, lon]:
            raise ValueError(f"{self.variable} isn't a grid by latitude and longitude")
        return v, v.shape[0] if len(v.shape) == 3 else 1, lat, lon

    def _inside(self, values: np.ndarray, name: str) -> tuple[int, int]:
        """The first and last place + 1 of what is within the bounds."""
        at = np.flatnonzero((values >= self.low[name]) & (values <= self.high[name]))
        return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            header = Header(path)
            _, steps, lats, lons = self._cube(header)
            with open(path, "rb") as file:
                rows = self._inside(header.axis(file, header.named("lat"), lats), "lat")
            a, b = self._inside(np.arange(steps), "step")
            band = max(1, min(rows[1] - rows[0], self.most // max(1, lons)))
            run = max(1, self.most // max(1, band * lons))
            out += [Part(path, (s, min(b, s + run)), (r, min(rows[1], r + band))) for s in range(a, b, run) for r in range(*rows, band)]
        return out or [Part("", (0, 0), (0, 0))]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        header = Header(part.path)
        v, steps, lats, lons = self._cube(header)
        flat = len(v.shape) == 2
        with open(part.path, "rb") as file:
            lat, lon = header.axis(file, header.named("lat"), lats), header.axis(file, header.named("lon"), lons)
            name = header.named("time")
            time = header.axis(file, name, steps) if name and not flat else np.arange(steps, dtype=np.float64)
            west, east = self._inside(lon, "lon")
            first, last = part.rows
            rows = max(1, BATCH // max(1, lons))
            for step in range(*part.steps):
                for r in range(first, last, rows):
                    n = min(last, r + rows) - r
                    values = header.read(file, v, 0 if flat else step, r * lons, n * lons) if not flat else self._plane(header, file, v, r * lons, n * lons)
                    values = values.reshape(n, lons)[:, west:east].ravel()
                    i, j = np.repeat(np.arange(r, r + n), east - west), np.tile(np.arange(west, east), n)
                    k = len(values)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * k, pa.string()), pa.array(np.full(k, step, np.int32)), pa.array(np.full(k, time[step])), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(lat[i]), pa.array(lon[j]), pa.array(values, from_pandas=True)],
                        names=["path", "step", "time", "lat_idx", "lon_idx", "lat", "lon", "value"],
                    )

    @staticmethod
    def _plane(header: Header, file, v: Variable, first: int, count: int) -> np.ndarray:
        """A grid without steps is one run of values."""
        one = Variable(v.dims, v.attributes, v.kind, v.begin, False, [1, *v.shape])
        return header.read(file, one, 0, first, count)


class GriddedFiles(DataSource):
    """Options: variable; values (of a partition); the path may have patterns, or be a list with commas."""

    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        patterns = str(self.options.get("path", "")).split(",")
        paths = sorted({p for pattern in patterns for p in glob.glob(pattern.removeprefix("file://"))})
        return Reader(paths, self.options["variable"], int(self.options.get("values", PARTITION)))


def read_gridded(spark: SparkSession, paths: str, variable: str, values: int = PARTITION) -> DataFrame:
    """A variable of classic NetCDF files (a pattern, or several with commas) in long form. Registers the source in the session and
    lets it see filters, without which Spark refuses a reader that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GriddedFiles)
    return spark.read.format(GriddedFiles.name()).option("variable", variable).option("values", values).load(paths)


def write_classic(path: str, lat: np.ndarray, lon: np.ndarray, time: np.ndarray, cubes: dict[str, np.ndarray], fill: float | None = None, wide: bool = True, records: bool = True) -> None:
    """SNK-4, SNK-5 for other tools: a classic file with (time, lat, lon) variables, time as the record dimension if asked for.

    For one grid of a size that a task holds; cubes beyond that are written as Parquet by `tables.write_grid`.
    """
    pad = lambda raw: raw + bytes(-len(raw) % 4)
    text = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    axes = {"time": np.asarray(time, ">f8"), "lat": np.asarray(lat, ">f8"), "lon": np.asarray(lon, ">f8")}
    dims = list(axes)
    variables = [(n, [k], a, b"") for k, (n, a) in enumerate(axes.items())]
    mark = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, fill) if fill is not None else struct.pack(">ii", 0, 0)
    variables += [(n, [0, 1, 2], np.asarray(c, ">f4"), mark) for n, c in cubes.items()]
    is_record = lambda ids: records and ids[0] == 0
    width = lambda ids, a: len(pad(a[:1].tobytes())) if is_record(ids) else len(pad(a.tobytes()))
    begins: dict[str, int] = {}

    def header() -> bytes:
        out = b"CDF" + bytes([2 if wide else 1]) + struct.pack(">i", len(time) if records else 0)
        out += struct.pack(">ii", 10, len(dims)) + b"".join(text(d) + struct.pack(">i", 0 if records and d == "time" else len(axes[d])) for d in dims)
        out += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))
        for name, ids, a, attributes in variables:
            out += text(name) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + (attributes or struct.pack(">ii", 0, 0))
            out += struct.pack(">ii", 6 if a.dtype.itemsize == 8 else 5, width(ids, a)) + struct.pack(">q" if wide else ">i", begins.get(name, 0))
        return out

    at = len(header())
    for want in (False, True):
        for name, ids, a, _ in variables:
            if is_record(ids) == want:
                begins[name], at = at, at + width(ids, a)
    with open(path, "wb") as file:
        file.write(header())
        for _, ids, a, _ in variables:
            if not is_record(ids):
                file.write(pad(a.tobytes()))
        for k in range(len(time) if records else 0):
            for _, ids, a, _ in variables:
                if is_record(ids):
                    file.write(pad(a[k : k + 1].tobytes()))
