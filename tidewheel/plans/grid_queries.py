"""Queries over grids: axes, neighbourhoods, country means, degree days, power curves, areas, shapes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewheel.functions import kernels
from tidewheel.functions.kernels import POWER_CURVE
from tidewheel.operators import grid, lookup, panel, shapes
from tidewheel.plans.registry import query, table

#: A grid from the parts: a cell for each size and key remainder, months from the orders' dates.
_GRID = """cells AS (SELECT p_size AS lat_idx, CAST(p_partkey % 12 AS INT) AS lon_idx, round(avg(p_retailprice), 6) AS value FROM part GROUP BY ALL)"""


def cells(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("lat_idx"), (F.col("p_partkey") % 12).cast("int").alias("lon_idx")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))


@query("""SELECT c_custkey, round(((c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360)) - 180, 6) AS lon FROM customer""")
def lon_wrap(spark, sf_dir):
    """DOM-1."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(kernels.wrap_longitude(F.col("c_acctbal")), 6).alias("lon"))


@query("""WITH g AS (SELECT DISTINCT p_size * 7.25 AS lon0, p_size FROM part), w AS (SELECT p_size, round((lon0 + 180) - 360 * floor((lon0 + 180) / 360) - 180, 6) AS lon FROM g)
    SELECT p_size AS old_idx, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS lon_idx, lon FROM w""")
def lon_axis_sorted(spark, sf_dir):
    """DOM-1, SRT-2."""
    axis = table(spark, sf_dir, "part").select((F.col("p_size") * 7.25).alias("lon"), F.col("p_size").alias("old_idx"), F.lit(0).alias("lon_idx")).distinct()
    return grid.wrap_and_sort(axis).select("old_idx", F.col("lon_idx").cast("int").alias("lon_idx"), F.round("lon", 6).alias("lon"))


@query(f"WITH {_GRID} SELECT 60 - lat_idx AS lat_idx, lon_idx, value FROM cells")
def reversed_axis(spark, sf_dir):
    """SRT-3."""
    return grid.reverse_axis(cells(spark, sf_dir), "lat_idx", 61)


_AXIS = [-900.0, -250.0, 0.0, 10.0, 500.0, 1200.0, 1200.0, 5000.0, 9000.0]


@query(f"""WITH a AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(_AXIS))}) t(i, v)), d AS (SELECT c_custkey, c_acctbal, i, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - v), i) AS r FROM customer, a)
    SELECT c_custkey, CAST(i AS INT) AS idx, CAST(greatest(0, least(40, ceil((c_acctbal + 1000) / 250 - 0.5))) AS INT) AS regular FROM d WHERE r = 1""")
def nearest_axis_cell(spark, sf_dir):
    """JN-15."""
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", grid.nearest_on_axis(x, _AXIS).alias("idx"), grid.nearest_regular(x, -1000, 250, 41).alias("regular"))


@query(f"""WITH {_GRID}, p AS (SELECT s_suppkey, CAST(2 + s_suppkey % 45 AS INT) AS lat_idx, CAST(1 + s_suppkey % 10 AS INT) AS lon_idx, abs(s_acctbal) / 20 + 1 AS capacity FROM supplier),
    o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj)),
    n AS (SELECT p.s_suppkey, p.lat_idx, p.lon_idx, di, dj, (c.value - capacity) / capacity AS r FROM p, o LEFT JOIN cells c ON c.lat_idx = p.lat_idx + di AND c.lon_idx = p.lon_idx + dj),
    k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN r IS NULL THEN 2 WHEN r > 0 THEN 0 ELSE 1 END, abs(r), di, dj) AS rank, bool_or(di = -1 AND dj = -1 AND r IS NULL) OVER (PARTITION BY s_suppkey) AS stuck FROM n)
    SELECT s_suppkey, CASE WHEN stuck THEN -1 ELSE di END AS di, CASE WHEN stuck THEN -1 ELSE dj END AS dj FROM k WHERE rank = 1""")
def neighbour_best_fit(spark, sf_dir):
    """JN-14, JN-16, SEL-1, SRT-5."""
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(s, (2 + s % 45).cast("int").alias("lat_idx"), (1 + s % 10).cast("int").alias("lon_idx"), (F.abs("s_acctbal") / 20 + 1).alias("capacity"))
    near = grid.neighbourhood(points).drop("lat_idx", "lon_idx").withColumnsRenamed({"cell_lat": "lat_idx", "cell_lon": "lon_idx"})
    return grid.best_cell(grid.at_points(cells(spark, sf_dir), near, ["value"]), "s_suppkey", "value", "capacity")


@query("""WITH q AS (SELECT p_size, quantile_cont(p_retailprice, 0.9) AS flow FROM part GROUP BY 1) SELECT p_size, round(flow, 6) AS flow, round(flow * 30 * 997 * 9.81 / 1e6, 6) AS potential, round(flow * 30 * 9.81 / 1000, 6) AS feature FROM q""")
def quantile90_power(spark, sf_dir):
    """AGG-11, DOM-11, DOM-12."""
    q = grid.quantile_by_cell(table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", 0.9, "flow")
    flow, head = F.col("flow"), F.lit(30)
    return q.select("p_size", F.round(flow, 6).alias("flow"), F.round(kernels.potential_power(flow, head), 6).alias("potential"), F.round(kernels.hydraulic_power(flow, head), 6).alias("feature"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def hot_quantile(spark, sf_dir):
    """AGG-11 with a third of all rows in one key, by digits."""
    return grid.quantile_by_cell(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "q90", hot=10_000).withColumn("q90", F.round("q90", 6))


_MONTHS = "g AS (SELECT CAST(o_custkey % 40 AS INT) AS lat_idx, CAST(o_custkey % 12 AS INT) AS lon_idx, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS value FROM orders)"


def monthly_grid(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select((c % 40).cast("int").alias("lat_idx"), (c % 12).cast("int").alias("lon_idx"), F.trunc("o_orderdate", "month").alias("month"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"))


@query(f"""WITH {_MONTHS}, c AS (SELECT lat_idx, lon_idx, (lat_idx * 3 + lon_idx) % 7 AS country_code FROM (SELECT CAST(unnest(range(40)) AS INT) AS lat_idx), (SELECT CAST(unnest(range(12)) AS INT) AS lon_idx))
    SELECT country_code, month, round(avg(value), 6) AS country_mean FROM g JOIN c USING (lat_idx, lon_idx) GROUP BY ALL""")
def country_mean(spark, sf_dir):
    """AGG-9, JN-18."""
    countries = spark.range(480).select((F.col("id") % 40).cast("int").alias("lat_idx"), F.floor(F.col("id") / 40).cast("int").alias("lon_idx")).withColumn("country_code", (F.col("lat_idx") * 3 + F.col("lon_idx")) % 7)
    return grid.country_mean(monthly_grid(spark, sf_dir), countries, "value", "country_mean").withColumn("country_mean", F.round("country_mean", 6))


@query("SELECT n_regionkey AS country_code, round(sum(s_acctbal), 2) AS country_area FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def country_area_sum(spark, sf_dir):
    """AGG-10."""
    rows = lookup.lookup(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), {"s_nationkey": "n_nationkey"}, {"country_code": "n_regionkey"}).withColumnRenamed("s_acctbal", "area")
    return grid.country_area(rows).withColumn("country_area", F.round("country_area", 2))


@query("""WITH t AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 280 + value % 30 END AS k FROM events)
    SELECT user_id, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(CASE WHEN k > 293.45 THEN k - 293.45 ELSE 0 END), 6) AS cdd, round(sum(CASE WHEN k < 293.45 THEN 293.45 - k ELSE 0 END), 6) AS hdd FROM t GROUP BY ALL""")
def degree_days(spark, sf_dir):
    """DOM-2, DOM-3, AGG-4."""
    k = F.when(F.col("event_id") % 13 != 0, 280 + F.col("value") % 30)
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), kernels.cooling_degree(k).alias("cdd"), kernels.heating_degree(k).alias("hdd"))
    both = panel.monthly(days, ["user_id"], "day", ["cdd", "hdd"], "sum", fill_gaps=False, at_end=False)
    return both.select("user_id", "month", F.round("cdd", 6).alias("cdd"), F.round("hdd", 6).alias("hdd"))


_POLY = " + ".join(f"({c}) * pow(s, {i})" if i else f"({c})" for i, c in enumerate(POWER_CURVE))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, sqrt(l_quantity * l_quantity / 16 + l_discount * l_discount * 100) AS speed FROM lineitem), h AS (SELECT *, speed * pow(10.0, 0.14) AS hub FROM v),
    c AS (SELECT *, CASE WHEN hub < 3 OR hub > 25 THEN 0.0 WHEN hub > 12.5 THEN 12.5 ELSE hub END AS s FROM h) SELECT l_orderkey, l_linenumber, round(hub, 6) AS hub, round(({_POLY}) / 1000 / 2, 6) AS factor FROM c""")
def wind_curve(spark, sf_dir):
    """DOM-4 to DOM-7."""
    hub = kernels.hub_height_speed(kernels.wind_speed(F.col("l_quantity") / 4, F.col("l_discount") * 10))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(hub, 6).alias("hub"), F.round(kernels.wind_capacity_factor(hub), 6).alias("factor"))


@query("""WITH f AS (SELECT *, l_extendedprice * 500 / (1000 * 86400) * 0.9 * 0.95 AS x FROM lineitem), e AS (SELECT *, x * l_quantity * day(last_day(l_shipdate)) * 24 AS energy FROM f)
    SELECT l_orderkey, l_linenumber, x AS factor, energy, energy / 1234.5 AS density FROM e""")
def solar_curve(spark, sf_dir):
    """DOM-8, PRJ-19, PRJ-20."""
    factor = kernels.solar_capacity_factor(F.col("l_extendedprice") * 500)
    energy = kernels.month_energy(factor, F.col("l_quantity"), F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", factor.alias("factor"), energy.alias("energy"), kernels.energy_density(energy, F.lit(1234.5)).alias("density"))


@query("""SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum((l_quantity + l_extendedprice / 100) / 400) / 10, 9) AS energy FROM lineitem WHERE regexp_full_match(CAST(CAST(l_quantity AS INT) AS VARCHAR), '[0-9]+') GROUP BY ALL""")
def block_energy_monthly(spark, sf_dir):
    """DOM-15."""
    rows = table(spark, sf_dir, "lineitem").withColumn("e", kernels.block_energy(F.col("l_quantity"), F.col("l_extendedprice") / 100))
    return panel.monthly(rows, ["l_suppkey"], "l_shipdate", "e", "sum", fill_gaps=False, at_end=False).select("l_suppkey", "month", F.round(F.col("e") / 10, 9).alias("energy"))


_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
_E = math.sqrt(_E2)
_ZONE = "(sin(radians({x})) / (1 - {e2} * pow(sin(radians({x})), 2)) + ln((1 + {e} * sin(radians({x}))) / (1 - {e} * sin(radians({x})))) / (2 * {e}))"


def _zone(x):
    return _ZONE.format(x=x, e=repr(_E), e2=repr(_E2))


@query(f"SELECT p_size, round({(6378.137 * (1 - 1 / 298.257223563)) ** 2 * math.radians(0.1) / 2!r} * ({_zone('p_size - 25 + 0.05')} - {_zone('p_size - 25 - 0.05')}), 6) AS km2 FROM (SELECT DISTINCT p_size FROM part)")
def cell_area(spark, sf_dir):
    """DOM-9."""
    lat = F.col("p_size") - 25
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.round(kernels.cell_area(lat, 0.05, 0.1), 6).alias("km2"))


_RING = [(0.5, 0.5), (30.5, 2.5), (35.5, 9.5), (20.5, 5.5), (3.5, 10.5)]


def _crossing(a, b):
    (ax, ay), (bx, by) = a, b
    return f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by - ay}) + {ax} THEN 1 ELSE 0 END"


@query(f"""WITH {_MONTHS}, xy AS (SELECT lat_idx * 1.0 AS x, lon_idx * 1.0 AS y, month, value FROM g)
    SELECT 1 AS id, month, round(avg(value), 6) AS inside_mean FROM xy WHERE ({' + '.join(_crossing(a, b) for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))}) % 2 = 1 GROUP BY month""")
def polygon_mean(spark, sf_dir):
    """JN-19."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))
    shapes = spark.range(1).select(F.lit(1).alias("id"), ring.alias("ring"))
    points = monthly_grid(spark, sf_dir).withColumns({"lon": F.col("lat_idx").cast("double"), "lat": F.col("lon_idx").cast("double")})
    return grid.mean_inside(points, shapes, "value", "inside_mean").withColumn("inside_mean", F.round("inside_mean", 6))


@query(f"""WITH {_MONTHS}, c AS (SELECT CAST(unnest(range(40)) AS INT) AS lat_idx, 5 AS lon_idx, 9 AS country_code),
    xy AS (SELECT lat_idx * 1.0 AS x, lon_idx * 1.0 AS y, month, value FROM g),
    inner_ AS (SELECT 1 AS country_code, month, avg(value) AS m FROM xy WHERE ({' + '.join(_crossing(a, b) for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))}) % 2 = 1 GROUP BY month),
    outer_ AS (SELECT country_code, month, avg(value) AS m FROM g JOIN c USING (lat_idx, lon_idx) GROUP BY ALL)
    SELECT country_code, month, round(m, 6) AS mean FROM outer_ UNION ALL SELECT country_code, month, round(m, 6) FROM inner_""")
def country_mean_fallback(spark, sf_dir):
    """AGG-9 with JN-19: country 9 has cells, country 1 only a shape."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))
    shapes = spark.range(1).select(F.lit(1).alias("id"), ring.alias("ring"))
    countries = spark.range(40).select(F.col("id").cast("int").alias("lat_idx"), F.lit(5).alias("lon_idx"), F.lit(9).alias("country_code"))
    points = monthly_grid(spark, sf_dir).withColumns({"lon": F.col("lat_idx").cast("double"), "lat": F.col("lon_idx").cast("double")})
    return grid.country_mean_or_inside(points, countries, shapes, "value", "mean").withColumn("mean", F.round("mean", 6))


@query("""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'GranD' WHEN 1 THEN 'GeoDAR' WHEN 2 THEN 'other' END AS source, s_nationkey + 5 AS source_id, s_acctbal FROM supplier)
    SELECT s_suppkey, CASE WHEN source IN ('GranD', 'GeoDAR') THEN n_nationkey + (CASE source WHEN 'GranD' THEN 0.5 ELSE 0.25 END) ELSE s_acctbal END AS x, CASE WHEN source IN ('GranD', 'GeoDAR') THEN n_regionkey * 1.0 ELSE -1.0 END AS y FROM r LEFT JOIN nation ON source_id = n_nationkey AND source IN ('GranD', 'GeoDAR')""")
def source_coordinates(spark, sf_dir):
    """JN-17: an id that the layer lacks gives no coordinates."""
    nation = table(spark, sf_dir, "nation")
    layer = lambda shift: nation.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + shift).alias("x"), (F.col("n_regionkey") * 1.0).cast("double").alias("y"))
    kind = F.col("s_suppkey") % 4
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.when(kind == 0, "GranD").when(kind == 1, "GeoDAR").when(kind == 2, "other").alias("source"), (F.col("s_nationkey") + 5).alias("source_id"))
    return lookup.by_source(rows, {"GranD": layer(0.5), "GeoDAR": layer(0.25)}, "source", "source_id", (F.col("s_acctbal"), F.lit(-1.0))).select("s_suppkey", "x", "y")


@query(f"""WITH {_GRID}, t AS (SELECT lat_idx * 0.5 AS lat, lon_idx * 0.5 AS lon, value FROM cells), n AS (SELECT lat, lon, value, i, j FROM t, (SELECT unnest(range(0, 400)) AS i) a, (SELECT unnest(range(-20, 100)) AS j) b WHERE abs(i * 0.25 - lat) <= 0.5 AND abs(j * 0.25 - lon) <= 0.5)
    SELECT i * 0.25 AS lat, j * 0.25 AS lon, value FROM n QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY pow(i * 0.25 - lat, 2) + pow(j * 0.25 - lon, 2), lat, lon) = 1""")
def resample_grid(spark, sf_dir):
    """DOM-10."""
    coarse = cells(spark, sf_dir).select((F.col("lat_idx") * 0.5).cast("double").alias("lat"), (F.col("lon_idx") * 0.5).cast("double").alias("lon"), "value")
    return grid.resample_nearest(coarse, 0.25)


@query("""WITH corner AS (SELECT s_nationkey AS id, s_suppkey % 3 AS part, s_suppkey, s_acctbal / 60 AS x, CAST(s_suppkey * 37 % 179 - 89 AS DOUBLE) + 0.5 AS y FROM supplier),
    edge AS (SELECT id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM corner WINDOW w AS (PARTITION BY id, part ORDER BY s_suppkey)),
    place AS (SELECT c_custkey, c_acctbal / 60 AS x, CAST(c_custkey * 7 % 180 - 90 AS DOUBLE) AS y, c_acctbal FROM customer)
    SELECT id, c_custkey FROM place JOIN edge ON (ay > y) <> (by_ > y) AND x < (bx - ax) * ((y - ay) / (by_ - ay)) + ax GROUP BY ALL HAVING count(*) % 2 = 1""")
def points_in_shapes(spark, sf_dir):
    """JN-19 over shapes of several crossing rings, so with islands and holes: a nation's suppliers are the corners."""
    corners = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id"), (F.col("s_suppkey") % 3).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", (F.col("s_acctbal") / 60).alias("x"), ((F.col("s_suppkey") * 37 % 179 - 89).cast("double") + 0.5).alias("y")))).alias("p")
    )
    rings = corners.groupBy("id").agg(F.collect_list(F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"))
    places = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 60).alias("lon"), (F.col("c_custkey") * 7 % 180 - 90).cast("double").alias("lat"))
    return shapes.located(places, rings).select("id", "c_custkey")
