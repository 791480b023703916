from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.plans import national


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_brazil(spark):
    data = [("2020-01-01 00:00:00", "Hidráulica", "X", 1.0), ("2020-01-31 10:00:00", "Hidráulica", "X", 3.0), ("2020-03-01", "Hidráulica", "X", 5.0), ("2020-01-01", "Solar", "X", 99.0), ("2020-01-01", "Hidráulica", "Y", 7.0)]
    hourly = spark.createDataFrame(data, "din_instante string, nom_tipocombustivel string, nom_usina string, val_geracao double")
    names = spark.createDataFrame([("X", "old", 1), ("X", "G1", 2), ("Y", None, 3)], "ons_plant_name string, hydropower_plant_id string, ordinal int")
    out = national.brazil(hourly, names)
    assert rows(out, "plant_id", "date", "generation_value") == [("G1", date(2020, 1, 31), 2.0), ("G1", date(2020, 2, 29), None), ("G1", date(2020, 3, 31), 5.0)]
    assert out.first().generation_unit == "MW"


def test_europe(spark):
    t = lambda d, h: datetime(2020, 1, d, h)
    hourly = spark.createDataFrame([(t(1, 0), "Hydro Water Reservoir", "u1", "A", "area", "E1", 10.0, 50.0), (t(2, 0), "Hydro Water Reservoir", "u1", "A", "area", "E1", 20.0, 50.0), (t(1, 0), "Hydro Water Reservoir", "u2", "A", "area", "E2", 1.0, 5.0), (t(1, 0), "Wind", "w", "A", "area", "E3", 9.0, 9.0), (t(1, 0), "Hydro Water Reservoir", "u4", "A", "area", "E4", 4.0, 4.0)], "DateTime timestamp, ProductionType string, PowerSystemResourceName string, MapCode string, AreaName string, GenerationUnitEIC string, ActualGenerationOutput double, InstalledGenCapacity double")
    registry = spark.createDataFrame([("E1", "P", "Big Dam", "Hydro Water Reservoir", "Austria", 1), ("E2", "P", "Big Dam", "Hydro Water Reservoir", "Austria", 2)], "eic_g string, eic_p string, name_p string, type_g string, country string, ordinal int")
    plants = spark.createDataFrame([("G1", "Dam Big", "Austria", 60.0, 1), ("G2", "Other", "Austria", 6.0, 2)], "ID string, name string, country string, capacity_mw double, ordinal int")
    units = national.europe_units(hourly, registry)
    assert rows(units, "eic_p", "date", "ActualGenerationOutput", "InstalledGenCapacity", "eic_country_name") == [("P", date(2020, 1, 31), 16.0, 55.0, "Austria")]
    review = national.europe_review(units, plants, ["Dam Big", "Other"])
    assert rows(review, "name", "match", "score", "plant_country", "plant_capacity") == [("Big Dam", "Dam Big", 100, "Austria", 60.0)]
    mapping = spark.createDataFrame([("Big Dam", "Dam Big", "Austria"), ("gone", "Other", "Nowhere")], "eic_plant_name string, plant_name string, country string")
    assert rows(national.europe(units, mapping, plants), "plant_id", "plant_name", "generation_value", "generation_unit") == [("G1", "Dam Big", 16.0, "MW")]


def test_usa(spark):
    monthly = spark.createDataFrame([("a", 1, 2019, "Feb", "RectifHyd", 5.0, 6.0), ("a", 1, 2019, "Mar", "EIA", 5.0, 6.0), ("b", 2, 2019, "Feb", "EIA", 1.0, 2.0)], "plant string, EIA_ID long, year long, month string, recommended_data string, RectifHyd_MWh double, EIA_MWh double")
    walk = spark.createDataFrame([("1.0", "h1"), ("2", "h2"), ("2", "h3"), ("NA", "h4"), ("9", "h1")], "eia_ptid string, eha_ptid string")
    plants = spark.createDataFrame([("EHA", "h1", "G1", 1), ("X", "h1", "G9", 2), ("EHA", "h2", "G2", 3)], "plant_source string, plant_source_id string, ID string, ordinal int")
    assert rows(national.usa(monthly, walk, plants), "plant_id", "date", "generation_value", "generation_unit") == [("G1", date(2019, 2, 1), 5.0, "MWH"), ("G1", date(2019, 3, 1), 6.0, "MWH")]


def test_india(spark):
    state = spark.createDataFrame([("Chilla", 3.5, "4", "2020"), ("None", 1.0, "4", "2020")], "plant_name string, actual_generation double, m string, y string")
    one = national.india_state_months(state, {"Chilla": "G5"}, "m", "y")
    assert rows(one, "plant_id", "date", "generation_value") == [("G5", date(2020, 4, 1), 3.5)]
    sheet = "01022010.xls"
    grid = [("BASPA-HEP", "baspa 2", "Larji"), ("100", "20", "7"), ("1.5", "30", None), ("50", "x", "9"), ("999", "999", "999")]
    marks = ["", "01:00", "11:00", "12:00", "13:00"]
    cells = spark.createDataFrame([(sheet, i, j, v, marks[i]) for i, line in enumerate(grid) for j, v in enumerate(line)] + [("02022010.xls", 0, 0, "5", "x")], "sheet string, row_no int, column_no int, cell string, marker string")
    two = national.india_daily_blocks(cells, {"baspa": "G1", "larji": "G2", "giri": "G3"})
    assert rows(two, "plant_id", "date", "generation_value") == [("G1", date(2010, 2, 1), pytest.approx(200 / 4000)), ("G2", date(2010, 2, 1), pytest.approx(16 / 4000)), ("G3", date(2010, 2, 1), 0.0)]
    plants = spark.createDataFrame([("A", 10.0, "G1"), ("A2", 10.0, "G1"), ("Z", 0.0, "G2"), ("N", 5.0, None)], "plant_name string, installed_capacity_mw double, plant_id string")
    reports = spark.createDataFrame([("A", 10.0, date(2021, 1, 1), 1.25, 1), ("A", 10.0, date(2021, 1, 1), 9.0, 2), ("A2", 10.0, date(2021, 1, 1), 1.22, 3), ("Q", 1.0, date(2021, 2, 1), 3.0, 4)], "plant_name string, installed_capacity_mw double, date date, value double, ordinal int")
    three = national.india_national(plants, reports)
    assert rows(three, "plant_id", "date", "generation_value") == [("G1", date(2021, 1, 1), 1.2), ("G1", date(2021, 2, 1), 0.0)]
    both = national.first_of_sources([three, two])
    assert both.where("plant_id = 'G1'").count() == 3


def test_renewables_and_cells(spark):
    wide = lambda *r: spark.createDataFrame(list(r), "Country string, `2000` string, `2001` string")
    names = spark.createDataFrame([("Vietnam", "Viet Nam", 1), ("Old", "Peru", 2), ("Peru", "Peru", 3)], "country string, match string, ordinal int")
    cap = national.renewable_capacity(wide(("Viet Nam", "5", "-")), wide(("Viet Nam", "1", "2"), ("Peru", "3", "3")), wide(("Viet Nam", "7", "8")), ["2000", "2001"], names)
    got = {(r.country, r.month): (r.wind_mw, r.solar_mw) for r in cap.collect()}
    assert len(got) == 48 and got["Vietnam", date(2000, 5, 1)] == (6, 7) and got["Vietnam", date(2001, 5, 1)] == (2, 8) and got["Peru", date(2001, 1, 1)] == (3, 0)
    base = spark.createDataFrame([("p", "Peru", 1, date(2000, 1, 1)), ("q", "Chad", 2, date(2000, 1, 1))], "p string, country string, country_code int, month date")
    factors = spark.createDataFrame([(1, date(2000, 1, 1), 0.5, 0.25)], "country_code int, month date, solar_factor double, wind_factor double")
    areas = spark.createDataFrame([(1, 100.0)], "country_code int, country_area double")
    dense = {r.p: r for r in national.renewable_density(base, cap, factors, areas).collect()}
    assert dense["p"].Wind_monthly_generation_persqkm == pytest.approx(0.25 * 3 * 744 / 100) and dense["p"].Solar_monthly_generation_persqkm == 0 and dense["q"].Wind_monthly_generation_persqkm is None
    layer = spark.createDataFrame([(1, 1.1, 1.9)], "id int, x double, y double")
    plants = spark.createDataFrame([("A", "GranD", 1, None, None, 50.0, None, 1.0), ("B", None, None, None, None, 50.0, None, 1.0)], "ID string, res_dam_source string, res_dam_source_id int, man_dam_lon double, man_dam_lat double, head_m double, dam_height_m double, capacity_mw double")
    flow = spark.createDataFrame([(i, j, float(1 + i + j)) for i in range(5) for j in range(5)], "lat_idx int, lon_idx int, value double")
    assert rows(national.plant_cells(plants, {"GranD": layer}, [4.0, 3.0, 2.0, 1.0, 0.0], [0.0, 1.0, 2.0, 3.0, 4.0], flow), "ID", "lat_idx", "lon_idx") == [("A", 1, 1), ("B", None, None)]


def test_weather_grids(spark):
    daily = spark.createDataFrame([(0, 0, date(2020, 1, d), k) for d, k in ((1, 300.0), (2, None), (3, 290.0))], "lat_idx int, lon_idx int, day date, t2m double")
    r = national.degree_day_grid(daily).first()
    assert (r.cdd, r.hdd) == (pytest.approx(6.55), pytest.approx(3.45))
    w = national.capacity_factor_grid(spark.createDataFrame([(3.0, 4.0, 8.64e7)], "u10 double, v10 double, ssrd double")).first()
    assert w.solar_capacity_factor == pytest.approx(0.855) and 0 < w.wind_capacity_factor < 1.1
    a = national.area_grid(spark.createDataFrame([(0.0, 5), (0.0, 0), (0.0, None)], "lat double, country_code int"), 0.05, 0.1)
    assert [round(r.area, 1) for r in a.select(F.col("area")).collect()] == [123.1, 0, 0]
