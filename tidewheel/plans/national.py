"""National sources as harmonised generation tables, plant matching and renewable densities.

All functions give, or start from, rows of (plant_id, date, generation_value,
generation_unit, country, generation_source, ...). Where the survey's appendix finds a defect in the
described behaviour, its evident intent is built and named by its number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import calendar, kernels, nulls, text
from tidewheel.operators import dedup, grid, lookup, panel

HYDRO_TYPES = ("Hydro Pumped Storage", "Hydro Run-of-river and poundage", "Hydro Water Reservoir")
#: Names of the hourly source's columns in English.
HOURLY_NAMES = {
    "din_instante": "datetime", "id_subsistema": "subsystem_id", "nom_subsistema": "subsystem_name", "id_estado": "state_id", "nom_estado": "state_name",
    "cod_modalidadeoperacao": "operation_mode_code", "nom_tipousina": "plant_type_name", "nom_tipocombustivel": "fuel_type_name", "nom_usina": "plant_name", "val_geracao": "generation_value",
}
#: Plants of the daily block sheets.
BLOCK_PLANTS = ("baspa", "larji", "bhaba", "bassi", "giri", "kashang", "malana")


def tagged(df: DataFrame, unit: str, country: str, source: str) -> DataFrame:
    """PRJ-4."""
    return df.withColumns({"generation_unit": F.lit(unit), "country": F.lit(country), "generation_source": F.lit(source)})


def brazil(hourly: DataFrame, names: DataFrame) -> DataFrame:
    """Hourly rows (D8: read as UTF-8) of hydropower to monthly means by plant name, with ids of names (ons_plant_name,
    hydropower_plant_id, ordinal); plants without an id are left out. D25: times of day are parsed as well."""
    rows = hourly.withColumnsRenamed(HOURLY_NAMES).where("fuel_type_name = 'Hidráulica'")
    rows = rows.withColumn("datetime", calendar.parse_date(F.substring(F.col("datetime").cast("string"), 1, 10), "yyyy-MM-dd")).select("datetime", "plant_name", "generation_value")
    monthly = panel.monthly(rows, ["plant_name"], "datetime", "generation_value", "mean")
    known = names.where(F.col("hydropower_plant_id").isNotNull())
    out = lookup.lookup(monthly, known, {"plant_name": "ons_plant_name"}, {"plant_id": "hydropower_plant_id"}, "ordinal")
    out = out.where(F.col("plant_id").isNotNull()).withColumnRenamed("month", "date")
    return tagged(out, "MW", "Brazil", "https://dados.ons.org.br/dataset/geracao-usina-2/resource/b56e215c-074e-418f-83c7-3d7a6d1292ff")


def europe_units(hourly: DataFrame, registry: DataFrame) -> DataFrame:
    """Hourly output of hydropower units to monthly plant sums (eic_p, eic_plant_name, eic_country_name, date, values).

    D7: files are united before the monthly mean. D4: units of the registry are kept. The registry has a column ordinal.
    """
    units = hourly.where(F.col("ProductionType").isin(*HYDRO_TYPES))
    keys = ["PowerSystemResourceName", "ProductionType", "MapCode", "AreaName", "GenerationUnitEIC"]
    monthly = panel.monthly(units, keys, "DateTime", ["ActualGenerationOutput", "InstalledGenCapacity"], "mean").withColumnRenamed("month", "date")
    known = registry.where(F.col("type_g").isin(*HYDRO_TYPES))
    named = lookup.lookup(monthly, known, {"GenerationUnitEIC": "eic_g"}, {"eic_p": "eic_p", "eic_plant_name": "name_p"}, "ordinal")
    sums = panel.aggregate(named, ["eic_p", "eic_plant_name", "date"], {v: nulls.sum_or_zero(F.col(v)) for v in ("ActualGenerationOutput", "InstalledGenCapacity")})
    return lookup.lookup(sums, known, {"eic_p": "eic_p"}, {"eic_country_name": "country"}, "ordinal")


def europe_review(units: DataFrame, plants: DataFrame, choices: Sequence[str]) -> DataFrame:
    """For a manual review: each registry name with its best match by name (D5), both countries and capacities."""
    best = lookup.best_names(units, "eic_plant_name", list(choices))
    first = dedup.keep_first(units, ["eic_plant_name"], ["eic_p", "date"]).select("eic_plant_name", "eic_country_name", "InstalledGenCapacity")
    out = best.join(first, best["name"] == first["eic_plant_name"]).drop("eic_plant_name")
    return lookup.lookup(out, plants, {"match": "name"}, {"plant_country": "country", "plant_capacity": "capacity_mw"}, "ordinal")


def europe(units: DataFrame, mapping: DataFrame, plants: DataFrame) -> DataFrame:
    """Plant sums by the reviewed mapping (eic_plant_name, plant_name, country; D6) and the plants (ID, name, country, ordinal).

    Names that the review leaves out, and pairs of name and country without a plant, vanish.
    """
    ids = lookup.lookup(mapping, plants, {"plant_name": "name", "country": "country"}, {"plant_id": "ID"}, "ordinal").select("eic_plant_name", "plant_id")
    rows = units.join(ids, "eic_plant_name")
    sums = panel.aggregate(rows, ["plant_id", "date"], {"generation_value": nulls.sum_or_zero(F.col("ActualGenerationOutput")), "installed_capacity_mw": nulls.sum_or_zero(F.col("InstalledGenCapacity"))})
    out = lookup.lookup(sums, plants, {"plant_id": "ID"}, {"plant_name": "name", "country": "country"}, "ordinal")
    return out.withColumns({"generation_unit": F.lit("MW"), "generation_source": F.lit("ENTSOE")})


def usa(monthly: DataFrame, crosswalk: DataFrame, plants: DataFrame) -> DataFrame:
    """Monthly MWh by the recommended of two series; ids through a crosswalk without ambiguous plants and the plants' source ids.

    Only crosswalk rows of plants that occur count, before ambiguity is judged.
    """
    walk = crosswalk.withColumn("eia", nulls.sentinel_to_number(F.col("eia_ptid"))).where("eia is not null")
    walk = walk.join(monthly.select(F.col("EIA_ID").cast("double").alias("eia")).distinct(), "eia", "left_semi")
    rows = monthly.withColumns({"_eia": F.col("EIA_ID").cast("double"), "plant_source": F.lit("EHA")})
    rows = lookup.lookup_unique(rows, walk, {"_eia": "eia"}, {"eha_ptid": "eha_ptid"})
    rows = lookup.lookup(rows, plants, {"plant_source": "plant_source", "eha_ptid": "plant_source_id"}, {"plant_id": "ID"}, "ordinal").where(F.col("plant_id").isNotNull())
    value = F.when(F.col("recommended_data") == "RectifHyd", F.col("RectifHyd_MWh")).otherwise(F.col("EIA_MWh"))
    out = rows.select(F.col("plant").alias("plant_name"), "plant_id", calendar.month_from_parts(F.col("year").cast("int"), calendar.month_number(F.col("month"))).alias("date"), value.alias("generation_value"))
    return tagged(out, "MWH", "USA", "https://www.nature.com/articles/s41597-022-01748-x")


def india_state_months(rows: DataFrame, ids: Mapping[str, str], month: str, year: str, source: str = "https://www.ujvnl.com/") -> DataFrame:
    """Monthly rows (plant_name, actual_generation) with year and month, which sources.tables.file_part takes from file names."""
    table = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    out = rows.select("plant_name", calendar.month_from_parts(F.col(year).cast("int"), F.col(month).cast("int")).alias("date"), F.col("actual_generation").alias("generation_value"), table[F.col("plant_name")].alias("plant_id"))
    return tagged(out.where(F.col("plant_id").isNotNull()), "GWH", "India", source)


def india_daily_blocks(cells: DataFrame, ids: Mapping[str, str], plants: Sequence[str] = BLOCK_PLANTS, after: int = 2004, source: str = "https://hpaldc.org/index.asp?pg=dgoph") -> DataFrame:
    """Daily sheets in long form (sheet `ddmmyyyy...`, row_no, column_no, cell, marker) to monthly GWH.

    A plant's two columns are the first ones that hold its name; rows up to the first marker 12:00 count (the whole sheet
    is looked at for names), digits only. A day is (half1 + half2) / 400, a plant without a column 0; sheets without the
    marker are left out. Months are sums / 10, gaps are 0.
    """
    rows = cells.withColumns({"date": calendar.parse_date(F.element_at(F.split("sheet", r"\."), 1), "ddMMyyyy"), "label": text.canonical_label(text.clean_label(F.col("cell")), ["total", *plants])})
    stops = rows.where(F.col("marker").startswith("12:00")).groupBy("sheet").agg(F.min("row_no").alias("stop"))
    held = rows.where(F.col("label").isin(*plants)).groupBy("sheet", F.col("label").alias("plant_name")).agg(F.array_sort(F.collect_set("column_no")).alias("columns"))
    mine = held.select("sheet", "plant_name", F.explode(F.slice("columns", 1, 2)).alias("column_no"))
    used = rows.join(stops, "sheet").where("row_no <= stop and date is not null")
    number = F.when(text.digits_only(F.col("cell")), F.col("cell").try_cast("double"))
    daily = used.join(mine, ["sheet", "column_no"]).groupBy("date", "plant_name").agg(nulls.sum_or_zero(number).alias("both"))
    days = used.select("date").distinct().withColumn("plant_name", F.explode(F.array(*map(F.lit, plants))))
    whole = days.join(daily, ["date", "plant_name"], "left").where(F.year("date") > after).withColumn("generation_value", kernels.block_energy(F.coalesce("both", F.lit(0.0)), F.lit(0.0)))
    table = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    monthly = panel.monthly(whole, ["plant_name"], "date", "generation_value", "sum", at_end=False).withColumns({"generation_value": F.col("generation_value") / 10, "plant_id": table[F.col("plant_name")]})
    return tagged(monthly.where(F.col("plant_id").isNotNull()).withColumnRenamed("month", "date"), "GWH", "India", source)


def india_national(plants: DataFrame, reports: DataFrame, source: str = "https://npp.gov.in/") -> DataFrame:
    """Monthly reports (plant_name, installed_capacity_mw, date, value, ordinal) for the listed plants (plant_name, installed_capacity_mw,
    plant_id): the first report of equal name and capacity, 0 if a month has none (RSH-3 stays long, D21).

    Values are rounded to one decimal, half to even; equal rows of state and central files count once; then sums by plant.
    """
    first, last = reports.select(F.min("date")).scalar(), reports.select(F.max("date")).scalar()
    listed = plants.where(nulls.differs(F.col("installed_capacity_mw"), 0) & F.col("plant_id").isNotNull())
    wanted = listed.withColumn("date", F.explode(F.sequence(first, last, F.expr("interval 1 month")))).join(reports.select("date").distinct(), "date", "left_semi")
    on = {c: c for c in ("plant_name", "installed_capacity_mw", "date")}
    rows = lookup.lookup_first_or(wanted, reports, on, {"generation_value": "value"}, "ordinal", 0.0).withColumn("generation_value", F.bround("generation_value", 1))
    rows = dedup.distinct_on(rows, ["plant_id", "installed_capacity_mw", "date", "generation_value"])
    sums = panel.aggregate(rows, ["plant_id", "date"], {c: nulls.sum_or_zero(F.col(c)) for c in ("generation_value", "installed_capacity_mw")})
    return tagged(sums, "GWH", "India", source).withColumn("date", calendar.month_of(F.col("date")))


def first_of_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """One row for each plant and date, by the order of the sources."""
    return dedup.keep_first(dedup.union_by_priority(sources), ["plant_id", "date"], ["source_priority", "row_ordinal"]).drop("source_priority", "row_ordinal")


def renewable_capacity(onshore: DataFrame, offshore: DataFrame, solar: DataFrame, years: Sequence[str], names: DataFrame) -> DataFrame:
    """Wide yearly capacities (Country, years as text with dashes) to (country, month, wind_mw, solar_mw), with the plants' country names of
    names (country, match, ordinal): onshore and offshore wind are added, missing ones as 0."""

    def long(wide: DataFrame, value: str) -> DataFrame:
        return panel.long_form(wide, ["Country"], list(years), "year", value).withColumn(value, nulls.dash_to_zero(F.col(value)))

    wind = lookup.outer_total(long(onshore, "wind_mw"), long(offshore, "wind_mw"), ["Country", "year"], "wind_mw")
    both = wind.join(long(solar, "solar_mw"), ["Country", "year"], "left").fillna(0.0, ["wind_mw", "solar_mw"])
    back = lookup.invert(names, "country", "match", "ordinal")
    named = lookup.lookup(both, back, {"Country": "match"}, {"country_name": "country"}).where(F.col("country_name").isNotNull())
    monthly = panel.year_to_months(named.withColumn("year", F.col("year").cast("int")), "year")
    return monthly.select(F.col("country_name").alias("country"), "month", "wind_mw", "solar_mw")


def renewable_density(panel_rows: DataFrame, capacity: DataFrame, factors: DataFrame, areas: DataFrame) -> DataFrame:
    """Monthly solar and wind energy for each km2 of the row's country: mean factors (country_code, month, solar_factor, wind_factor),
    capacities by country and month, areas by country_code."""
    out = panel_rows.join(capacity, ["country", "month"], "left").join(factors, ["country_code", "month"], "left").join(areas, "country_code", "left")
    energy = lambda kind: kernels.energy_density(kernels.month_energy(F.col(f"{kind}_factor"), F.col(f"{kind}_mw"), F.col("month")), F.col("country_area"))
    return out.withColumns({"Solar_monthly_generation_persqkm": energy("solar"), "Wind_monthly_generation_persqkm": energy("wind")}).drop("solar_mw", "wind_mw", "solar_factor", "wind_factor", "country_area")


def plant_cells(plants: DataFrame, layers: Mapping[str, DataFrame], lat_axis: Sequence[float], lon_axis: Sequence[float], flow: DataFrame, radius: int = 1) -> DataFrame:
    """(ID, lat_idx, lon_idx): dam coordinates by source, the nearest cell, then the neighbour of the best potential power.

    D24: a plant without coordinates has no cell.
    """
    at = lookup.by_source(plants, layers, "res_dam_source", "res_dam_source_id", (F.col("man_dam_lon"), F.col("man_dam_lat")))
    at = at.withColumns({"lat_idx": grid.nearest_on_axis(F.col("y"), lat_axis), "lon_idx": grid.nearest_on_axis(F.col("x"), lon_axis), "head": kernels.or_else(F.col("head_m"), F.col("dam_height_m"))})
    located = at.where(F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull())
    best = grid.match_cells(located, flow, "ID", "head", "capacity_mw", radius)
    return plants.select("ID").join(best, "ID", "left")


def degree_day_grid(daily: DataFrame, base: float = kernels.BASE_KELVIN) -> DataFrame:
    """Daily temperatures (lat_idx, lon_idx, day, t2m) to monthly cooling and heating degree days (D23: missing ones count as 0)."""
    t = F.col("t2m")
    return daily.groupBy("lat_idx", "lon_idx", F.trunc("day", "month").alias("month")).agg(F.sum(kernels.cooling_degree(t, base)).alias("cdd"), F.sum(kernels.heating_degree(t, base)).alias("hdd"))


def capacity_factor_grid(weather: DataFrame) -> DataFrame:
    """(.., u10, v10, ssrd) to wind and solar capacity factors, columns only (D9, D10)."""
    hub = kernels.hub_height_speed(kernels.wind_speed(F.col("u10"), F.col("v10")))
    return weather.withColumns({"wind_capacity_factor": kernels.wind_capacity_factor(hub), "solar_capacity_factor": kernels.solar_capacity_factor(F.col("ssrd"))}).drop("u10", "v10", "ssrd")


def area_grid(countries: DataFrame, half_lat: float, width: float) -> DataFrame:
    """Cell areas where there is a country, else 0."""
    return countries.withColumn("area", F.when(nulls.is_true(F.col("country_code") > 0), kernels.cell_area(F.col("lat"), half_lat, width)).otherwise(0.0))
