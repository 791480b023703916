"""The three chains from sources to results, each one lazy plan; and the same chains on the driver's tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions import calendar, kernels, nulls
from tidewheel.operators import dedup, drought, grid, lookup, models, panel, splits
from tidewheel.operators.staging import written
from tidewheel.plans.registry import SERIES, series, table

#: Plants left out after manual inspection.
DENIED_PLANTS = (
    "GHR00387", "GHR00388", "GHR00394", "GHR00405", "GHR00412", "GHR00420", "GHR00432", "GHR00435", "GHR00439", "GHR00552",
    "GHR00594", "GHR00599", "GHR00617", "GHR00628", "GHR00643", "GHR00644", "GHR00649", "GHR00667", "GHR00740", "GHR00852",
    "GHR00926", "GHR00931", "GHR03412", "GHR03446", "GHR03459", "GHR03461", "GHR03468", "GHR03488", "GHR03511", "GHR03533",
    "GHR03595", "GHR06434", "GHR06512", "GHR06518", "GHR06524", "GHR06540", "GHR06542", "GHR06554", "GHR06563", "GHR06596",
    "GHR06615", "GHR06651", "GHR06664", "GHR06687", "GHR06689", "GHR06702", "GHR06709", "GHR06739", "GHR06772", "GHR06773",
    "GHR06825", "GHR06852", "GHR06855", "GHR06871", "GHR06929", "GHR06942", "GHR06950", "GHR06960", "GHR06980", "GHR07010",
    "GHR07069", "GHR07133", "GHR07140", "GHR07147", "GHR07158", "GHR07206", "GHR07208", "GHR07266", "GHR07273", "GHR07302",
    "GHR07330", "GHR07344", "GHR07366", "GHR07372", "GHR07386", "GHR07396", "GHR07442", "GHR07457", "GHR07474", "GHR07511",
    "GHR07530", "GHR07536",
)
#: Country names and their counterparts in the capacity tables, where the best score is wrong.
COUNTRY_OVERRIDES = {
    "China": "China", "Congo": "Congo (the)", "Czech Republic": "Czechia", "Equatorial Guinea": "Equatorial Guinea", "Georgia": "Georgia",
    "Guinea": "Guinea", "Ireland": "Ireland", "Laos": "Lao People's Democratic Republic (the)", "North Korea": "Democratic People's Republic of Korea (the)",
    "Russia": "Russian Federation (the)", "South Korea": "Republic of Korea (the)", "Taiwan": "Chinese Taipei", "Vietnam": "Viet Nam",
}


def harmonise(sources: Sequence[DataFrame], key: str = "plant_id", before: str = "2023-01-01", zero_share: float = 0.2, drop: Column | None = None) -> DataFrame:
    """Sources (date, generation_value, generation_unit, ...) in order of priority as one row for each plant and month.

    The first source's first row counts; values become mean MW; plants with a negative value, or with
    zeros in a share of their months, are left out; so are rows that `drop` marks. A plant has a few
    hundred rows, so all three windows share one exchange by plant.
    """
    df = dedup.union_by_priority(sources).where(F.col(key).isNotNull())
    df = df.withColumn("month", calendar.month_of(F.col("date"))).where(F.col("month") < F.lit(before).cast("date"))
    if drop is not None:
        df = df.where(~nulls.is_true(drop))
    df = dedup.keep_first(df.repartition(key), [key, "month"], ["source_priority", "row_ordinal"])
    df = df.withColumn("observed_generation_mw", kernels.mean_power_mw(F.col("generation_value"), F.col("generation_unit"), F.col("month")))
    w, mw = Window.partitionBy(key), F.col("observed_generation_mw")
    df = df.withColumns({"_bad": F.max(nulls.is_true(mw < 0)).over(w), "_zeros": F.avg(nulls.is_true(mw == 0).cast("int")).over(w)})
    return df.where(~F.col("_bad") & (F.col("_zeros") < zero_share)).drop("_bad", "_zeros")


def with_attributes(df: DataFrame, plants: DataFrame, key: str = "plant_id", ordinal: str | None = None) -> DataFrame:
    """Plant attributes by lookup, head from the dam's height, no volume for run-of-river plants, rows with a head, repaired capacity and its factor."""
    names = ("plant_type", "capacity_mw", "head_m", "dam_height_m", "res_vol_km3", "plant_lat")
    out = lookup.lookup(df, plants, {key: "ID"}, {n: n for n in names}, ordinal)
    out = out.withColumns({"head_m": kernels.or_else(F.col("head_m"), F.col("dam_height_m")), "res_vol_km3": kernels.zero_where(F.col("res_vol_km3"), F.col("plant_type") == "ROR")})
    out = out.where(nulls.not_in(F.col("plant_type"), ["PS", "Canal"]) & F.col("head_m").isNotNull())
    out = panel.repair_capacity(out, key, "capacity_mw", "observed_generation_mw").withColumnRenamed("capacity_mw", "installed_capacity_mw")
    return out.withColumn("capacity_factor", nulls.clip(nulls.ratio(F.col("observed_generation_mw"), F.col("installed_capacity_mw")), 0, 1))


def with_power_lags(df: DataFrame, flow: DataFrame, cells: DataFrame, heads: DataFrame, key: str = "plant_id") -> DataFrame:
    """Seven monthly lags of hydraulic power at each plant's cell, made on the whole flow series before the join.

    flow: (lat_idx, lon_idx, month, value); cells: (key, lat_idx, lon_idx); heads: (key, head_m).
    """
    at = cells.select(key, "lat_idx", "lon_idx").join(heads.select(key, "head_m"), key)
    power = flow.join(at, ["lat_idx", "lon_idx"]).select(key, "month", kernels.hydraulic_power(F.col("value"), F.col("head_m")).alias("mw"))
    return df.join(panel.lag_features(power, key, "month", "mw"), [key, "month"], "left")


def with_country_means(df: DataFrame, grids: Mapping[str, DataFrame], countries: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """For each named grid the mean of the row's country_code and month; one aggregation for each grid. Where the code's cells
    give none, and shapes are given, it is the mean inside the country's shape."""
    for name, cells in grids.items():
        means = grid.country_mean(cells, countries, "value", name) if shapes is None else grid.country_mean_or_inside(cells, countries, shapes, "value", name)
        df = df.join(means, ["country_code", "month"], "left")
    return df


def drought_labels(flow: DataFrame, cells: DataFrame, key: str = "plant_id") -> DataFrame:
    """Percentiles and drought runs of the flow at each plant's cell: one exchange by plant serves all windows."""
    at = flow.join(cells.select(key, "lat_idx", "lon_idx"), ["lat_idx", "lon_idx"]).select(key, "month", F.col("value").alias("streamflow_data"))
    return drought.drought_columns(drought.seasonal_percentile(at.repartition(key), key, "month", "streamflow_data"), key, "month")


def train_and_score(training: DataFrame, everywhere: DataFrame, columns: Sequence[str], key: str, label: str, capacity: str, params: Mapping | None = None) -> DataFrame:
    """A forest on the prepared panel's standardised columns; predictions for all rows elsewhere, times capacity.

    Rows elsewhere use their plant's scales from training, or else their own.
    """
    names = [f"{c}_plant_std" for c in columns]
    fitted = splits.entity_scales(training, key, columns)
    model = models.random_forest(training.where("split = 'train'"), names, label, params)
    scored = splits.standardise_with(everywhere.dropna(subset=list(columns)), fitted, key, columns)
    return models.predict(model, scored, names, capacity)


def _table_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part = lambda rows, unit: rows.groupBy(F.col("l_suppkey").alias("plant_id"), F.trunc("l_shipdate", "month").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("generation_value")).withColumns({"generation_unit": F.lit(unit), "row_ordinal": F.col("plant_id")})
    return [part(lines.where("l_returnflag = 'R'"), "MWH"), part(lines.where("l_returnflag <> 'R'"), "GWH")]


_YEARS = {c: (1997, 1998, 1999) for c in (f"NATION_{i}" for i in range(0, 24, 2))}

_SCALED = [*(f"physical_hydropower_{k}n" for k in range(7)), "country_mean"]

TRAINING_SQL = f"""WITH {SERIES},
    src AS (SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS source_priority, l_suppkey AS plant_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL),
    one AS (SELECT * FROM src WHERE month < DATE '2001-01-01' QUALIFY row_number() OVER (PARTITION BY plant_id, month ORDER BY source_priority) = 1),
    mw AS (SELECT plant_id, month, CASE source_priority WHEN 0 THEN v / (day(last_day(month)) * 24) ELSE v * 1000 / (day(last_day(month)) * 24) END AS observed FROM one),
    cap AS (SELECT plant_id, CASE WHEN round_even(max(observed), 0) > any_value(c) THEN round_even(max(observed), 0) ELSE any_value(c) END AS capacity FROM mw JOIN (SELECT s_suppkey, s_acctbal / 20 AS c FROM supplier WHERE s_acctbal > 0) ON plant_id = s_suppkey GROUP BY 1),
    lags AS (SELECT plant_id, month, {', '.join(f'lag(value, {k}) OVER w AS physical_hydropower_{k}n' for k in range(7))} FROM series WINDOW w AS (PARTITION BY plant_id ORDER BY month))
    SELECT n_name AS country, mw.plant_id, mw.month, round(observed, 6) AS observed, round(capacity, 6) AS capacity, round(least(greatest(observed / capacity, 0), 1), 6) AS capacity_factor, lags.* EXCLUDE (plant_id, month),
        CASE WHEN year(mw.month) <= 1997 THEN 'train' WHEN year(mw.month) = 1998 THEN 'valid' ELSE 'test' END AS split
    FROM mw JOIN cap USING (plant_id) JOIN lags ON lags.plant_id = mw.plant_id AND lags.month = mw.month JOIN supplier ON mw.plant_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE n_name IN ({', '.join(f"'{c}'" for c in _YEARS)}) AND physical_hydropower_6n IS NOT NULL"""


def _panel(spark, sf_dir):
    plants = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 0")
    plants = plants.select(F.col("s_suppkey").alias("plant_id"), F.col("n_name").alias("country"), (F.col("s_acctbal") / 20).alias("capacity"))
    rows = harmonise(_table_sources(spark, sf_dir), "plant_id", "2001-01-01").withColumnRenamed("observed_generation_mw", "observed").select("plant_id", "month", "observed").join(plants, "plant_id")
    rows = panel.repair_capacity(rows, "plant_id", "capacity", "observed")
    rows = rows.withColumn("capacity_factor", nulls.clip(nulls.ratio(F.col("observed"), F.col("capacity")), 0, 1))
    return rows.join(panel.lag_features(series(spark, sf_dir), "plant_id", "month", "value"), ["plant_id", "month"]).dropna()


def training_panel_from_tables(spark, sf_dir: str) -> DataFrame:
    out = splits.split_by_years(_panel(spark, sf_dir), "country", "month", _YEARS)
    rounded = [F.round(c, 6).alias(c) for c in ("observed", "capacity", "capacity_factor")]
    return out.select("country", "plant_id", "month", *rounded, *(f"physical_hydropower_{k}n" for k in range(7)), "split")


#: Suppliers that stand for plants left out by hand.
_DENIED = (7, 21, 30)

PREPARED_SQL = f"""WITH panel AS ({TRAINING_SQL}),
    means AS (SELECT n_name AS country, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 6) AS country_mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    joined AS (SELECT plant_id, month, split, {', '.join(f'physical_hydropower_{k}n' for k in range(7))}, country_mean FROM panel JOIN means USING (country, month)
        WHERE plant_id NOT IN ({', '.join(map(str, _DENIED))}) AND capacity > 300 QUALIFY count(*) OVER (PARTITION BY plant_id) >= 24),
    n AS (SELECT *, count(*) FILTER (split = 'train') OVER w AS trains, count(*) FILTER (split = 'valid') OVER w AS valids FROM joined WINDOW w AS (PARTITION BY plant_id)),
    dealt AS (SELECT * EXCLUDE (split, trains, valids), CASE WHEN (trains > 0 AND trains < 24) OR (trains = 0 AND valids > 0 AND valids < 24) THEN 'train' ELSE split END AS split FROM n),
    stats AS (SELECT plant_id, split, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALED)} FROM dealt GROUP BY ALL HAVING count(*) > 1),
    fitted AS (SELECT * EXCLUDE (split) FROM stats QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) = 1),
    z AS (SELECT plant_id, month, split, count(*) OVER (PARTITION BY plant_id, split) AS rows, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}' for c in _SCALED)} FROM dealt JOIN fitted USING (plant_id))
    SELECT plant_id, month, split, {', '.join(f'round({c}, 6) AS {c}_plant_std' for c in _SCALED)} FROM z WHERE rows > 1 AND {' AND '.join(f'{c} BETWEEN -3 AND 3' for c in _SCALED)}"""


def prepared_panel_from_tables(spark, sf_dir: str) -> DataFrame:
    """The panel with the mean of its country and month, of which orders stand for the grid, made ready for the models."""
    cells = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("lat_idx"), F.lit(0).alias("lon_idx"), F.col("n_name").alias("country_code"))
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lat_idx"), F.lit(0).alias("lon_idx"), F.trunc("o_orderdate", "month").alias("month"), F.col("o_totalprice").alias("value"))
    rows = training_panel_from_tables(spark, sf_dir).withColumnRenamed("country", "country_code")
    means = grid.country_mean(values, cells, "value", "country_mean").withColumn("country_mean", F.round("country_mean", 6))
    rows = rows.join(means, ["country_code", "month"])
    out = splits.prepare(rows, "plant_id", _SCALED, _DENIED, "capacity", "observed", least_capacity=300)
    return out.select("plant_id", "month", "split", *(F.round(f"{c}_plant_std", 6).alias(f"{c}_plant_std") for c in _SCALED))


def global_scores_from_tables(spark, sf_dir: str) -> DataFrame:
    columns = [f"physical_hydropower_{k}n" for k in range(7)]
    rows = written(_panel(spark, sf_dir), "panel")  # read for the fit, its scales and the scores
    training = splits.standardise(splits.reallocate(splits.split_by_years(rows, "country", "month", _YEARS), "plant_id"), "plant_id", columns)
    training = splits.within(training, [f"{c}_plant_std" for c in columns])
    scored = train_and_score(training, rows, columns, "plant_id", "capacity_factor", "capacity", {"n_estimators": 20, "max_depth": 8})
    return scored.select("plant_id", "month", "prediction")
