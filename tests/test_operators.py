"""Unit and property tests with expected values by hand or by independent loops."""

import math
import os
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import calendar, kernels, nulls, text
from tidewheel.operators import dedup, drought, grid, lookup, models, panel, splits
from tidewheel.plans import pipelines
from tidewheel.sources import tables


def months(n, year=2000):
    return [date(year + k // 12, k % 12 + 1, 1) for k in range(n)]


def values(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_null_table(spark):
    nan = float("nan")
    df = nulls.nan_to_null(spark.createDataFrame([(1, 1.5, "a"), (2, nan, None), (3, None, "b"), (4, 99.0, "-")], "id int, x double, s string"))
    assert [r.x for r in df.orderBy("id").collect()] == [1.5, None, None, 99.0]
    assert [r.id for r in df.where(nulls.not_in(F.col("s"), ["a"])).orderBy("id").collect()] == [2, 3, 4]
    assert [r.id for r in df.where(nulls.differs(F.col("x"), 1.5)).orderBy("id").collect()] == [2, 3, 4]
    assert [r.id for r in df.where(~nulls.is_true(F.col("x") > 5)).orderBy("id").collect()] == [1, 2, 3]
    assert df.where("x is null").agg(nulls.sum_or_zero(F.col("x")).alias("v")).first().v == 0
    assert df.agg(nulls.max_unless_missing(F.col("x")).alias("v")).first().v is None and df.where("x > 0").agg(nulls.max_unless_missing(F.col("x")).alias("v")).first().v == 99
    pairs = spark.createDataFrame([(5.0, 7.0), (5.0, 3.0), (5.0, None), (None, 7.0), (None, None)], "a double, b double")
    assert [r.v for r in pairs.select(nulls.first_unless_greater(F.col("a"), F.col("b")).alias("v")).collect()] == [7, 5, 5, None, None]
    one = spark.createDataFrame([("NA", "-", -1.0, 0.0), ("x", " - ", 2.0, float("inf")), ("2.5", "7", None, nan)], "a string, b string, c double, d double")
    got = one.select(nulls.sentinel_to_number(F.col("a")), nulls.dash_to_zero(F.col("b")), nulls.clip(F.col("c"), 0, 1), nulls.finite(F.col("d")), nulls.ratio(F.lit(1.0), F.col("d")).isNull()).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, 0, True), (None, 0, 1, None, False), (2.5, 7, None, None, False)]


def test_calendar(spark):
    df = spark.createDataFrame([("2020-02-15", "15022020", "15-02-2020", "Feb", 2020, 2), (None, "x", "31-02-2020", "Foo", 2021, 12)], "a string, b string, c string, m string, y int, n int")
    d = calendar.parse_date(F.col("a"), "yyyy-MM-dd")
    r = df.select(d, calendar.parse_date(F.col("b"), "ddMMyyyy"), calendar.parse_date(F.col("c"), "yyyy-MM-dd", "dd-MM-yyyy"), calendar.month_of(d), calendar.days_in_month(d), calendar.month_number(F.col("m")), calendar.month_from_parts(F.col("y"), F.col("n")), calendar.months_before(d, 3), calendar.month_end(d), calendar.day_text(d)).collect()
    day = date(2020, 2, 15)
    assert tuple(r[0]) == (day, day, day, date(2020, 2, 1), 29, 2, date(2020, 2, 1), date(2019, 11, 15), date(2020, 2, 29), "15-02-2020")
    assert tuple(r[1]) == (None, None, None, None, None, None, date(2021, 12, 1), None, None, None)
    assert len(spark.range(1).select(calendar.month_starts(F.lit(date(1982, 1, 5)), F.lit(date(2022, 12, 9))).alias("m")).first().m) == 492


def test_kernels(spark):
    lon = [0.0, 179.9, 180.0, 359.9, -180.0, -181.0, 540.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lon], "x double").select(kernels.wrap_longitude(F.col("x"))).collect()]
    assert got == pytest.approx([0, 179.9, -180, -0.1, -180, 179, -180]) and all(-180 <= x < 180 for x in got)
    speeds = [0.0, 2.9, 3.0, 12.5, 12.6, 25.0, 25.1]
    poly = lambda s: sum(c * s**i for i, c in enumerate(kernels.POWER_CURVE))
    frame = spark.createDataFrame([(x,) for x in speeds], "v double")
    assert [r[0] for r in frame.select(kernels.wind_power(F.col("v"))).collect()] == pytest.approx([poly(0), poly(0), poly(3), poly(12.5), poly(12.5), poly(12.5), poly(0)])
    assert [r[0] for r in frame.select(kernels.wind_capacity_factor(F.col("v"), zero_outside=True)).collect()][::6] == [0, 0]
    t = spark.createDataFrame([(300.0,), (280.0,), (None,), (293.45,)], "k double")
    rows = t.select(kernels.cooling_degree(F.col("k")), kernels.heating_degree(F.col("k")), kernels.cooling_degree(F.col("k"), keep_null=True)).collect()
    assert [tuple(r) for r in rows] == [pytest.approx((6.55, 0, 6.55)), pytest.approx((0, 13.45, 0)), (0, 0, None), (0, 0, 0)]
    units = spark.createDataFrame([(7440.0, "MWH"), (7.44, "GWH"), (7.44, "MU"), (3.0, "MW"), (None, "GWH")], "v double, u string")
    assert [r[0] for r in units.select(kernels.mean_power_mw(F.col("v"), F.col("u"), F.lit(date(2021, 1, 1)))).collect()] == pytest.approx([10, 10, 10, 3, None])
    bins = spark.createDataFrame([(0,), (1,), (12,), (13,), (240,), (241,), (None,)], "n int").select(kernels.history_class(F.col("n"))).collect()
    assert [r[0] for r in bins] == [None, "0-12", "0-12", "12-60", "120+", None, None]


def test_cell_area_against_integral(spark):
    a, f = 6378.137, 1 / 298.257223563
    e2 = f * (2 - f)
    for lat in (0.0, 35.0, -60.0, 89.0):
        got = spark.range(1).select(kernels.cell_area(F.lit(lat), 0.05, 0.1)).first()[0]
        s = np.radians(np.linspace(lat - 0.05, lat + 0.05, 20_001))
        density = a * a * (1 - e2) * np.cos(s) / (1 - e2 * np.sin(s) ** 2) ** 2
        assert got == pytest.approx(np.trapezoid(density, s) * math.radians(0.1), rel=1e-7)
    whole = spark.range(1).select(kernels.cell_area(F.lit(0.0), 90, 360)).first()[0]
    assert whole == pytest.approx(510_065_621.7, rel=1e-7)


def test_text(spark):
    assert text.token_set_score("Itaipu Dam", "dam of ITAIPU!") == 100 and text.token_set_score("", "x") == 0 and text.token_set_score("abc", "abd") == 67
    df = spark.createDataFrame([("A-b\nC", "baspa hep", "a_b_c", "12"), (None, "total x", "a", "1.2")], "a string, b string, c string, d string")
    got = df.select(text.clean_label(F.col("a")), text.canonical_label(F.col("b"), ["total", "baspa"]), text.part_of(F.col("c"), "_", -3), text.digits_only(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("ab_c", "baspa", "a", True), (None, "total", None, False)]


def percentile(x, all_):
    left, right = sum(v < x for v in all_), sum(v <= x for v in all_)
    return (left + right + (left < right)) * 50 / len(all_)


def label_runs(percentiles, threshold, least):
    flag = [int(p is not None and p < threshold) for p in percentiles]
    pooled = flag[:]
    for i in range(1, len(flag) - 1):
        if flag[i] == 0 and flag[i - 1] == 1 == flag[i + 1]:
            pooled[i] = 1
    runs, at = [], 0
    for i, x in enumerate(pooled):
        at += i == 0 or x != pooled[i - 1]
        runs.append(at)
    return [r if x and runs.count(r) >= least else 0 for x, r in zip(pooled, runs, strict=True)]


def test_droughts_against_loops(spark):
    rng = np.random.default_rng(2)
    data = [(p, m, float(rng.integers(0, 40)) if rng.random() > 0.03 else None) for p in ("a", "b") for m in months(42 * 12, 1981)]
    out = drought.drought_columns(drought.seasonal_percentile(spark.createDataFrame(data, "plant string, month date, v double"), "plant", "month", "v"), "plant", "month").toPandas()
    assert len(out.columns) == 4 + 12
    for _, rows in out.sort_values("month").groupby("plant"):
        for m in range(1, 13):
            part = rows[[x.month == m for x in rows.month]]
            known = part.v.dropna().tolist()
            assert part.percentile.dropna().tolist() == pytest.approx([percentile(v, known) for v in known])
        p = [None if x != x else x for x in rows.percentile]
        for t in (10, 20, 25):
            for n in (1, 3, 6, 12):
                assert rows[f"drought_{t}_pooled_{n}length"].tolist() == label_runs(p, t, n)
    assert (out["drought_10_pooled_1length"] > 0).any()


def test_dedup(spark):
    a = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 6.0), (None, 3, 7.0), (None, 4, 8.0)], "k string, row_ordinal int, v double")
    b = spark.createDataFrame([("p", 0), ("q", 1)], "k string, row_ordinal int")
    first = dedup.keep_first(dedup.union_by_priority([a, b]), ["k"], ["source_priority", "row_ordinal"])
    assert values(first, "k", "v") == [("p", 5.0), ("q", None), (None, 7.0)]
    assert values(dedup.keep_last(a, ["k"], "row_ordinal"), "k", "v") == [("p", 6.0), (None, 8.0)]
    assert values(dedup.drop_ambiguous(b, ["k"]), "k") == [("p",), ("q",)] and dedup.drop_ambiguous(a, ["k"]).count() == 0
    assert values(dedup.distinct_on(a.select("k"), ["k"]), "k") == [("p",), (None,)]
    assert values(dedup.drop_entities_with(a, "k", F.col("v") > 7.5), "v") == [(5.0,), (6.0,)]
    zeros = spark.createDataFrame([("x", 0.0)] + [("x", 1.0)] * 4 + [("y", 0.0)] + [("y", None)] * 5, "k string, v double")
    assert values(dedup.drop_entities_by_share(zeros, "k", F.col("v") == 0, 0.2).select("k").distinct(), "k") == [("y",)]
    assert values(dedup.drop_short_entities(zeros.union(spark.createDataFrame([(None, 1.0)], "k string, v double")), "k", 6).select("k").distinct(), "k") == [("y",), (None,)]
    marks = spark.createDataFrame([("d", 1, "a"), ("d", 2, "12:00"), ("d", 3, "b"), ("e", 1, "c")], "g string, n int, s string")
    assert values(dedup.until_marker(marks, ["g"], "n", F.col("s") == "12:00"), "s") == [("12:00",), ("a",), ("c",)]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "id int, k string, v double")
    dim = spark.createDataFrame([("a", 10.0, 1), ("a", 11.0, 2), ("b", 20.0, 3), (None, 99.0, 4)], "key string, w double, n int")
    assert values(lookup.lookup(df, dim, {"k": "key"}, {"w": "w"}, "n"), "id", "w") == [(1, 11.0), (2, 20.0), (3, None)]
    assert values(lookup.lookup_unique(df, dim, {"k": "key"}, {"w": "w"}), "id", "w") == [(1, None), (2, 20.0), (3, None)]
    assert values(lookup.lookup_first_or(df, dim, {"k": "key"}, {"w": "w"}, "n", 0.0), "id", "w") == [(1, 10.0), (2, 20.0), (3, 0.0)]
    last = dedup.keep_last(dim, ["key"], "n")
    assert values(lookup.override(df, last, {"k": "key"}, "v", "w"), "id", "v") == [(1, 11.0), (2, 20.0), (3, 3.0)]
    assert values(lookup.fill_from(df, last, {"k": "key"}, "v", "w"), "id", "v") == [(1, 1.0), (2, 20.0), (3, 3.0)]
    assert values(lookup.anti(df, dim, "k") if "k" in dim.columns else lookup.anti(df, dim.withColumnRenamed("key", "k"), "k"), "id") == [(3,)]
    assert values(lookup.outer_total(dim.select("key", "w").limit(1), last.select("key", "w").where("key = 'b'"), ["key"], "w"), "key", "w") == [("a", 10.0), ("b", 20.0)]
    layer = spark.createDataFrame([(1, 5.0, 6.0)], "id int, x double, y double")
    dams = spark.createDataFrame([("p", "GranD", 1, 0.0, 0.5), ("q", "GranD", 2, 0.0, 0.5), ("r", None, None, 1.0, 2.0)], "p string, s string, i int, mx double, my double")
    assert values(lookup.by_source(dams, {"GranD": layer}, "s", "i", (F.col("mx"), F.col("my"))), "p", "x", "y") == [("p", 5.0, 6.0), ("q", None, None), ("r", 1.0, 2.0)]
    names = spark.createDataFrame([("Viet Nam (the)",), ("Laos",), (None,)], "n string")
    assert values(lookup.best_names(names, "n", ["Viet Nam", "Lao Republic", "Peru"], {"Laos": "Lao Republic"}), "name", "match") == [("Laos", "Lao Republic"), ("Viet Nam (the)", "Viet Nam")]


def test_panels(spark):
    df = spark.createDataFrame([("p", date(2020, 1, 5), 1.0), ("p", date(2020, 1, 6), None), ("p", date(2020, 4, 1), 3.0), (None, date(2020, 1, 1), 9.0)], "k string, d date, v double")
    assert values(panel.monthly(df, ["k"], "d", "v", "mean"), "month", "v") == [(date(2020, 1, 31), 1.0), (date(2020, 2, 29), None), (date(2020, 3, 31), None), (date(2020, 4, 30), 3.0)]
    assert [r.v for r in panel.monthly(df, ["k"], "d", "v", "sum").orderBy("month").collect()] == [1, 0, 0, 3]
    wide = spark.createDataFrame([("a", "1", "-")], "c string, y1 string, y2 string")
    assert values(panel.long_form(wide, ["c"], None, "y", "v"), "y", "v") == [("y1", "1"), ("y2", "-")]
    long = spark.createDataFrame([("p", m, float(i)) for i, m in enumerate(months(9)) if i != 4], "k string, month date, v double")
    by_row, by_month = panel.lag_features(long, "k", "month", "v", prefix="x").toPandas(), panel.lag_features_by_month(long, "k", "month", "v", prefix="x").toPandas()
    last = lambda t: t.sort_values("month").iloc[-1]
    assert [last(by_row)[f"x_{k}n"] for k in range(7)] == [8, 7, 6, 5, 3, 2, 1]
    assert [None if last(by_month)[f"x_{k}n"] != last(by_month)[f"x_{k}n"] else last(by_month)[f"x_{k}n"] for k in range(7)] == [8, 7, 6, 5, None, 3, 2] and len(by_month) == 8
    caps = spark.createDataFrame([("a", 2.0, 3.5), ("a", 2.0, 1.0), ("b", 9.0, 3.5), ("c", None, 4.0), ("d", 5.0, None), ("e", 1.0, 2.5)], "k string, c double, o double")
    assert values(panel.repair_capacity(caps, "k", "c", "o").select("k", "c").distinct(), "k", "c") == [("a", 4.0), ("b", 9.0), ("c", None), ("d", 5.0), ("e", 2.0)]


def best_of_nine(ratios):
    best, at = None, None
    for i, r in enumerate(ratios):
        if i == 0:
            best, at = r, 0
        elif r > 0:
            if best <= 0 or r < best:
                best, at = r, i
        elif best <= 0 and r > best:
            best, at = r, i
    return at


def test_best_cell_against_loop(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for p in range(300):
        sims = [None if rng.random() < 0.1 else float(rng.integers(1, 9)) for _ in range(9)]
        want[p] = best_of_nine([float("nan") if s is None else (s - 5.0) / 5.0 for s in sims])
        data += [(p, i // 3 - 1, i % 3 - 1, s, 5.0) for i, s in enumerate(sims)]
    got = grid.best_cell(spark.createDataFrame(data, "p int, di int, dj int, s double, c double"), "p", "s", "c").collect()
    assert {r.p: (r.di + 1) * 3 + r.dj + 1 for r in got} == want


def test_grids(spark):
    axis = [50.0, 30.0, 10.0, -10.0]
    x = spark.createDataFrame([(20.0,), (41.0,), (-99.0,), (None,)], "x double")
    assert [r[0] for r in x.select(grid.nearest_on_axis(F.col("x"), axis)).collect()] == [1, 0, 3, None]
    assert [r[0] for r in x.select(grid.nearest_regular(F.col("x"), 0.0, 40.0, 2)).collect()] == [0, 1, 0, None]
    flow = spark.createDataFrame([(i, j, float(10 * i + j + t)) for i in range(5) for j in range(5) for t in range(5)], "lat_idx int, lon_idx int, value double")
    q = {(i, j): 10 * i + j + 3.6 for i in range(5) for j in range(5)}
    power = lambda c: q[c] * 50 * 997 * 9.81 / 1e6
    points = spark.createDataFrame([("a", 2, 2, 50.0, power((1, 2)) - 0.01), ("corner", 0, 0, 50.0, 1.0)], "p string, lat_idx int, lon_idx int, head double, cap double")
    got = {r.p: (r.lat_idx, r.lon_idx) for r in grid.match_cells(points, flow, "p", "head", "cap").collect()}
    assert got == {"a": (1, 2), "corner": (-1, -1)}  # outside the grid the first cell has no value, so it is the one
    square = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9), (-0.1, 2.0)], "x double, y double")
    assert [r[0] for r in pts.select(grid.inside(F.col("x"), F.col("y"), square)).collect()] == [True, False, True, False]


def test_splits(spark):
    d = [("Norway", "p%d" % (9 - i), date(2022, m, 1), i) for i in range(10) for m in (4, 5, 6)]
    out = splits.split_by_entities(spark.createDataFrame(d, "country string, p string, d date, o int"), "p", "d", "o")
    assert {r.p for r in out.where("split = 'train'").collect()} == {f"p{9 - i}" for i in range(7)} and out.where("split = 'valid'").count() == 6 and out.where("split = 'test'").count() == 3
    years = spark.createDataFrame([(c, date(y, 5, 1)) for c in ("Brazil", "India", "Peru") for y in range(2016, 2023)], "c string, d date")
    got = splits.split_by_years(years, "c", "d").groupBy("c", "split").count().collect()
    assert {(r.c, r.split): r["count"] for r in got} == {("Brazil", "train"): 2, ("Brazil", "valid"): 1, ("Brazil", "test"): 4, ("India", "train"): 5, ("India", "test"): 2}
    rows = [("few", "train")] * 23 + [("few", "test")] + [("enough", "train")] * 24 + [("enough", "valid")] + [("v", "valid")] * 23 + [("v", "test")] + [("t", "test")] * 5
    moved = {(r.k, r.split): r["count"] for r in splits.reallocate(spark.createDataFrame(rows, "k string, split string"), "k").groupBy("k", "split").count().collect()}
    assert moved == {("few", "train"): 24, ("enough", "train"): 24, ("enough", "valid"): 1, ("v", "train"): 24, ("t", "test"): 5}


def test_standardise(spark):
    rng = np.random.default_rng(4)
    rows = [("a", "train", float(x), 7.0) for x in rng.normal(3, 2, 30)] + [("a", "test", 5.0, 8.0)] + [("b", "valid", 1.0, 1.0), ("b", "valid", 3.0, 1.0), ("b", "test", 4.0, 1.0), ("b", "test", 6.0, 1.0), ("c", "test", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, split string, x double, y double")
    out = splits.standardise(df, "k", ["x", "y"]).toPandas()
    a = out[(out.k == "a") & (out.split == "train")]
    assert abs(a.x_plant_std.mean()) < 1e-9 and a.x_plant_std.std(ddof=0) == pytest.approx(1) and (a.y_plant_std == 0).all()
    assert out[(out.k == "a") & (out.split == "test")].x_plant_std.isna().all() and out[out.k == "c"].x_plant_std.isna().all()
    assert sorted(out[out.k == "b"].x_plant_std) == [-1, 1, 2, 4]
    world = splits.standardise_with(df.where("split = 'test'"), splits.entity_scales(df, "k", ["x", "y"]), "k", ["x", "y"]).toPandas().set_index("k")
    assert world.loc["c"].x_plant_std == 0 and sorted(world.loc["b"].x_plant_std) == [2, 4]
    assert splits.within(spark.createDataFrame([(3.0, -3.0), (3.1, 0.0), (None, 0.0)], "a double, b double"), ["a", "b"]).count() == 1


def test_preparation_order(spark):
    data = [(p, "train", m, 20.0 if p != "small" else 10.0, 5.0 + i % 7, float(i % 5)) for p, n in (("ok", 30), ("short", 23), ("small", 30), ("GHR00387", 30)) for i, m in enumerate(months(n))]
    data += [("ok", "test", date(2010, 1, 1), 20.0, None, 1.0)]
    df = spark.createDataFrame(data, "k string, split string, month date, installed_capacity_mw double, observed_generation_mw double, x double")
    out = splits.prepare(df, "k", ["x"], pipelines.DENIED_PLANTS)
    assert {(r.k, r.split): r["count"] for r in out.groupBy("k", "split").count().collect()} == {("ok", "train"): 30}
    assert len(pipelines.DENIED_PLANTS) == len(set(pipelines.DENIED_PLANTS)) == 82 and len(splits.COUNTRY_YEARS) == 17 and len(pipelines.COUNTRY_OVERRIDES) == 13


def test_models(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    data = [(float(a), float(b), float(3 * a - 2 * b + 1), i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(data, "a double, b double, y double, part int")
    train, test, columns = df.where("part > 0"), df.where("part = 0"), ["a", "b"]
    assert models.rmse(models.predict(models.ols(train, columns, "y"), test, columns), "y") < 1e-6
    forest = models.random_forest(train, columns, "y", {"n_estimators": 30, "max_depth": 8})
    assert models.rmse(models.predict(forest, test, columns), "y") < 1.5
    assert models.rmse(models.predict(models.boosted_trees(train, columns, "y", {"n_estimators": 20}, test), test, columns), "y") < 1.5
    net = models.fit_perceptron(train, columns, "y", (16,), rounds=60, rate=0.1)
    assert models.rmse(models.perceptron_predict(net, test, columns), "y") < 1.0
    best, value = models.search(lambda p: (p["u"] - 0.3) ** 2 + abs(p["k"] - 4) if p["k"] != 7 else float("nan"), {"u": (0.0, 1.0), "k": (1, 9)}, 60)
    assert value < 0.05 and best["k"] == 4 and models.search(lambda p: p["u"], {"u": (0.0, 1.0)}, 20) == models.search(lambda p: p["u"], {"u": (0.0, 1.0)}, 20)
    models.save_params(best, str(tmp_path / "p.json"))
    assert models.load_params(str(tmp_path / "p.json")) == best


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "GEN_2020_01.csv").write_text("id;name;d;v\n1;Hidráulica;2020-01-02;1.5\nbad;x;2020-01-02;1\n2;b;2020-01-03;NaN\n", encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "GEN_2020_01.csv"), "id int, name string, d date, v double", sep=";", skip_malformed=True)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "Hidráulica", date(2020, 1, 2), 1.5), (2, "b", date(2020, 1, 3), None)]
    assert got.select(tables.file_part("_", -2).alias("y"), tables.file_part("_", 0).alias("n")).first()[:] == ("2020", "GEN")
    assert tables.list_files(str(tmp_path), ".csv") == [str(tmp_path / "GEN_2020_01.csv")] and tables.guarded(str(tmp_path / "none"), "skip") is False
    with pytest.raises(FileNotFoundError):
        tables.guarded(str(tmp_path / "none"))
    (tmp_path / "empty").write_text("")
    assert [tables.guarded(f"file://{tmp_path / n}", "skip", spark) for n in ("none", "empty", "GEN_2020_01.csv", "")] == [False, False, True, True]
    rows = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("b", date(2021, 1, 1), 2.0)], "p string, month date, value double")
    tables.write_by_entity(rows, str(tmp_path / "by"), "p")
    assert sorted(x for x in os.listdir(tmp_path / "by") if "=" in x) == ["p=a", "p=b"]
    tables.write_grid(rows, str(tmp_path / "grid"), {"value": "m3/s"})
    again = tables.read_grid(spark, str(tmp_path / "grid"), "2021-01-01", "2021-01-01")
    assert [r.p for r in again.collect()] == ["b"] and again.schema["value"].metadata == {"comment": "m3/s"}
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "p string, month date, value double").count() == 2
    assert tables.positional(rows, [2, 0], ["v", "k"]).columns == ["v", "k"] and tables.text_columns(rows) == ["p"]
    pdf = spark.createDataFrame([(0, "Plant A", "1"), (1, "Totalia", "2"), (2, "TOTAL (A)", "9"), (3, "note", "0")], "n int, a string, b string")
    assert values(tables.table_rows(pdf, "n", [1, 2], ["plant", "mw"]), "plant", "mw") == [("Plant A", "1"), ("Totalia", "2")]
    calls = []

    def fetch(path):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("no answer")
        open(path, "w").close()

    assert tables.download({str(tmp_path / "x.nc"): fetch}, sleep=lambda _: None) == [] and len(calls) == 3
    assert tables.download({str(tmp_path / "x.nc"): fetch}, sleep=lambda _: None) == [] and len(calls) == 3

    def broken(path):
        raise OSError

    assert tables.download({str(tmp_path / n): f for n, f in (("y.nc", broken), ("x.nc", broken), ("z.nc", fetch))}, sleep=lambda _: None) == [str(tmp_path / "y.nc")]


def test_small_world_end_to_end(spark):
    m = months(60)
    gen = lambda p, unit, k: [(p, x, float(k + i % 12), unit, i) for i, x in enumerate(m)]
    schema = "plant_id string, date date, generation_value double, generation_unit string, row_ordinal int"
    first = spark.createDataFrame(gen("A", "MW", 5) + [("B", m[0], -1.0, "MW", 0), (None, m[0], 3.0, "MW", 1)], schema)
    second = spark.createDataFrame(gen("A", "GWH", 900) + gen("B", "MW", 7) + gen("C", "MW", 2), schema)
    df = pipelines.harmonise([first, second])
    assert {r.plant_id: (r["count"], r.most) for r in df.groupBy("plant_id").agg(F.count("*").alias("count"), F.max("observed_generation_mw").alias("most")).collect()} == {"A": (60, 16.0), "C": (60, 13.0)}
    plants = spark.createDataFrame([("A", "STO", 12.0, None, 30.0, 1.0, 50.0), ("C", None, 99.0, 20.0, None, None, 10.0)], "ID string, plant_type string, capacity_mw double, head_m double, dam_height_m double, res_vol_km3 double, plant_lat double")
    df = pipelines.with_attributes(df, plants)
    assert values(df.select("plant_id", "installed_capacity_mw", "head_m").distinct(), "plant_id", "installed_capacity_mw", "head_m") == [("A", 16.0, 30.0), ("C", 99.0, 20.0)]
    flow = spark.createDataFrame([(i, 0, x, float(10 + t % 12 + i)) for i in range(2) for t, x in enumerate(m)], "lat_idx int, lon_idx int, month date, value double")
    cells = spark.createDataFrame([("A", 0, 0), ("C", 1, 0)], "plant_id string, lat_idx int, lon_idx int")
    heads = df.select("plant_id", "head_m").distinct()
    lagged = pipelines.with_power_lags(df, flow, cells, heads)
    row = lagged.where((F.col("plant_id") == "A") & (F.col("month") == m[6])).first()
    assert [row[f"physical_hydropower_{k}n"] for k in range(7)] == pytest.approx([(10 + 6 - k) * 30 * 9.81 / 1000 for k in range(7)])
    countries = spark.createDataFrame([(0, 0, 4), (1, 0, 4)], "lat_idx int, lon_idx int, country_code int")
    means = pipelines.with_country_means(lagged.withColumn("country_code", F.lit(4)), {"temperature": flow}, countries)
    assert means.where((F.col("plant_id") == "C") & (F.col("month") == m[0])).first().temperature == 10.5
    dry = pipelines.drought_labels(flow, cells)
    assert dry.count() == 120 and "drought_25_pooled_12length" in dry.columns
