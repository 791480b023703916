"""Grids in long form (lat_idx, lon_idx, lat, lon, month, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.kernels import potential_power, wrap_longitude
from tidewheel.operators.ranking import HOT, nearest_place, quantile_by, ranked
from tidewheel.operators.shapes import cover, members


def wrap_and_sort(grid: DataFrame, lon: str = "lon", lon_idx: str = "lon_idx") -> DataFrame:
    """DOM-1, SRT-2: wrapped longitudes, with indices in their order, which a table of one row for each longitude has."""
    wrapped = grid.withColumn(lon, wrap_longitude(F.col(lon)))
    axis, _ = ranked(wrapped.select(lon).distinct(), [lon], "_new")
    return wrapped.join(axis, lon).withColumn(lon_idx, (F.col("_new") - 1).cast(grid.schema[lon_idx].dataType)).drop("_new").select(*grid.columns)


def reverse_axis(grid: DataFrame, idx: str, size: int) -> DataFrame:
    """SRT-3."""
    return grid.withColumn(idx, F.lit(size - 1) - F.col(idx))


def nearest_regular(value: Column, first: float, step: float, size: int) -> Column:
    """JN-15 on a regular axis: index of the nearest point, the lower one of a tie; ends for values outside; missing for missing."""
    at = F.ceil((value - first) / step - 0.5)
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(size - 1), at)).cast("int"))


def nearest_on_axis(value: Column, axis: Sequence[float]) -> Column:
    """JN-15 on any axis: index of the least distance, the first of equal ones; by bisection, see `ranking.nearest_place`."""
    return nearest_place(value, axis)


def at_points(grid: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JN-14: the grid's values at each point's cell (lat_idx, lon_idx). Cells without a point never reach a shuffle of the values
    where the optimizer broadcasts the points. For a stored grid, `tables.read_cells` reads the row groups of the points only."""
    return points.join(grid.select("lat_idx", "lon_idx", *columns), ["lat_idx", "lon_idx"], "left")


def neighbourhood(points: DataFrame, radius: int = 1) -> DataFrame:
    """JN-16: a row for each cell within the radius, by true offsets (di, dj); an equi-join follows, never a range join."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    out = points.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    return out.withColumns({"cell_lat": F.col("lat_idx") + F.col("di"), "cell_lon": F.col("lon_idx") + F.col("dj")})


def quantile_by_cell(grid: DataFrame, keys: Sequence[str], value: str, q: float, out: str, hot: int = HOT) -> DataFrame:
    """AGG-11: exact quantile with linear interpolation; see `ranking.quantile_by` for cells of very many values."""
    return quantile_by(grid, keys, value, q, out, hot)


def best_cell(candidates: DataFrame, key: str, simulated: str, capacity: str) -> DataFrame:
    """SEL-1, SRT-5: of each key's cells (di, dj) the one whose power fits best: the smallest positive relative excess, else the
    largest that isn't positive; the first in row order of equal ones. If the first cell has no value, it is the one."""
    r = (F.col(simulated) - F.col(capacity)) / F.col(capacity)
    order = F.struct(F.col("di"), F.col("dj"))
    rank = F.struct(F.when(r > 0, 0).otherwise(1).alias("a"), F.abs(r).alias("b"), order.alias("c"))
    first = F.min_by(F.struct(r.alias("r"), order.alias("at")), order)
    best = F.min(F.when(r.isNotNull(), rank))
    out = candidates.groupBy(key).agg(first.alias("_first"), best.alias("_best"))
    chosen = F.when(F.col("_first.r").isNull(), F.col("_first.at")).otherwise(F.col("_best.c"))
    return out.select(key, chosen["di"].alias("di"), chosen["dj"].alias("dj"))


def match_cells(points: DataFrame, flow: DataFrame, key: str, head: str, capacity: str, radius: int = 1, q: float = 0.9) -> DataFrame:
    """JN-15, JN-16, AGG-11, DOM-12 and SEL-1 in one: (key, lat_idx, lon_idx) of the best cell near each point.

    flow is (lat_idx, lon_idx, value) over time; only cells near a point are aggregated.
    """
    near = neighbourhood(points, radius).select(key, "lat_idx", "lon_idx", "di", "dj", "cell_lat", "cell_lon", F.col(head).alias("_head"), F.col(capacity).alias("_capacity"))
    wanted = near.select(F.col("cell_lat").alias("lat_idx"), F.col("cell_lon").alias("lon_idx")).distinct()
    q90 = quantile_by_cell(flow.join(wanted, ["lat_idx", "lon_idx"], "left_semi"), ["lat_idx", "lon_idx"], "value", q, "_flow")
    q90 = q90.withColumnsRenamed({"lat_idx": "cell_lat", "lon_idx": "cell_lon"})
    power = near.join(q90, ["cell_lat", "cell_lon"], "left").withColumn("_power", potential_power(F.col("_flow"), F.col("_head")))
    best = best_cell(power, key, "_power", "_capacity")
    return points.join(best, key).select(key, (F.col("lat_idx") + F.col("di")).alias("lat_idx"), (F.col("lon_idx") + F.col("dj")).alias("lon_idx"))


def country_mean(grid: DataFrame, countries: DataFrame, value: str, out: str) -> DataFrame:
    """AGG-9, JN-18: unweighted mean by country_code and month, missing values left out; one aggregation for all rows."""
    return grid.join(countries.select("lat_idx", "lon_idx", "country_code"), ["lat_idx", "lon_idx"]).groupBy("country_code", "month").agg(F.avg(value).alias(out))


def country_area(countries: DataFrame) -> DataFrame:
    """AGG-10: sum of cell areas by country_code."""
    return countries.groupBy("country_code").agg(F.sum("area").alias("country_area"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """JN-19 for one short ring (array of x, y structs): whether a point is inside, by the crossings of a ray. For shapes see
    `operators.shapes`."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n) + 1)
        over = (a["y"] > y) != (b["y"] > y)
        return F.when(over, (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def _rings(shapes: DataFrame) -> DataFrame:
    return shapes if "rings" in shapes.columns else shapes.withColumn("rings", F.array("ring"))


def mean_inside(grid: DataFrame, shapes: DataFrame, value: str, out: str, skip: DataFrame | None = None) -> DataFrame:
    """AGG-9's fallback, JN-19: mean by shape id and month over cells whose centre is inside the shape.

    shapes: (id, rings) with parts, islands and holes as read_layer gives them, or (id, ring) of one ring. Each place is
    looked up once, not once for each month. Months (id, month) of `skip` are left out before anything is summed.
    """
    places = grid.select("lon", "lat").distinct()
    held = members(places, cover(_rings(shapes)))
    rows = grid.select("lon", "lat", "month", value).join(held, ["lon", "lat"])
    if skip is not None:
        rows = rows.join(skip, ["id", "month"], "left_anti")
    return rows.groupBy("id", "month").agg(F.avg(value).alias(out))


#: The coordinate system of a grid or a layer that has no column crs: longitudes and latitudes in degrees.
DEGREES = "EPSG:4326"


def same_crs(grid: DataFrame, shapes: DataFrame) -> DataFrame:
    """JN-20: the grid, whose rows fail unless they and all shapes have one coordinate system. Nothing is reprojected. A table
    without a column crs, or a row without a value there, is taken for degrees."""
    of = lambda df: F.coalesce(df["crs"].cast("string"), F.lit(DEGREES)) if "crs" in df.columns else F.lit(DEGREES)
    if "crs" not in grid.columns and "crs" not in shapes.columns:
        return grid
    least, most = (shapes.select(f(of(shapes))).scalar() for f in (F.min, F.max))
    fits = least.isNull() | ((of(grid) == least) & (of(grid) == most))
    return grid.where(F.assert_true(fits, "grid and shapes have different coordinate systems").isNull())


def country_mean_or_inside(grid: DataFrame, countries: DataFrame, shapes: DataFrame, value: str, out: str) -> DataFrame:
    """AGG-9 with its fallback, JN-19: the mean by country_code and month over the code's cells; where they have no value, that
    over cells inside the shape whose id is the code. JN-20: see `same_crs`.

    grid: (lat_idx, lon_idx, lat, lon, month, value). Only the months that a code lacks are summed over its shape.
    """
    grid = same_crs(grid, shapes)
    by_code = country_mean(grid, countries, value, out)
    known = by_code.where(F.col(out).isNotNull()).select(F.col("country_code").alias("id"), "month")
    inner = mean_inside(grid, shapes, value, "_inside", known).withColumnRenamed("id", "country_code")
    found = by_code.join(inner, ["country_code", "month"], "full")
    return found.select("country_code", "month", F.coalesce(out, "_inside").alias(out))


def resample_nearest(grid: DataFrame, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """DOM-10: cells of the given step, each with the value of the source cell whose centre is nearest to its own.

    The source is coarser or equal; a target cell of which no source cell lies within one source step has no row.
    """
    n = F.countDistinct(lat)
    wide = F.when(n > 1, (F.max(lat) - F.min(lat)) / F.greatest(n - 1, F.lit(1))).otherwise(step)
    reach = grid.select(F.greatest(F.bround(wide / step / 2 + 0.5).cast("int"), F.lit(1))).scalar()
    offsets = F.sequence(-reach, reach)
    near = grid.withColumn("_i", F.explode(offsets)).withColumn("_j", F.explode(offsets))
    near = near.withColumns({"i": F.round(F.col(lat) / step).cast("long") + F.col("_i"), "j": F.round(F.col(lon) / step).cast("long") + F.col("_j")})
    d = F.struct(((F.col("i") * step - F.col(lat)) ** 2 + (F.col("j") * step - F.col(lon)) ** 2).alias("d"), F.col(lat).alias("a"), F.col(lon).alias("b"))
    return near.groupBy("i", "j").agg(F.min_by("value", d).alias("value")).select((F.col("i") * step).alias(lat), (F.col("j") * step).alias(lon), "value")
