"""Queries over panels: aggregation, resampling, reshaping, deduplication, lookups, droughts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import calendar, kernels, nulls, text
from tidewheel.operators import dedup, drought, lookup, panel
from tidewheel.plans.registry import SERIES, query, series, table


def _drought_sql(thresholds, lengths):
    out = f"WITH {SERIES}, w0 AS (SELECT *, (2 * (rank() OVER (PARTITION BY plant_id, month(month) ORDER BY value) - 1) + count(*) OVER (PARTITION BY plant_id, month(month), value) + 1) * 50.0 / count(*) OVER (PARTITION BY plant_id, month(month)) AS percentile FROM series)"
    last = "w0"
    for t in thresholds:
        out += f""",
        f{t} AS (SELECT *, CASE WHEN percentile < {t} THEN 1 ELSE 0 END AS flag FROM {last}),
        p{t} AS (SELECT *, CASE WHEN flag = 0 AND lag(flag) OVER w = 1 AND lead(flag) OVER w = 1 THEN 1 ELSE flag END AS pooled FROM f{t} WINDOW w AS (PARTITION BY plant_id ORDER BY month)),
        c{t} AS (SELECT *, CASE WHEN pooled = lag(pooled) OVER (PARTITION BY plant_id ORDER BY month) THEN 0 ELSE 1 END AS change FROM p{t}),
        r{t} AS (SELECT *, CAST(sum(change) OVER (PARTITION BY plant_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c{t}),
        s{t} AS (SELECT *, count(*) OVER (PARTITION BY plant_id, run) AS size FROM r{t}),
        w{t} AS (SELECT * EXCLUDE (flag, pooled, change, run, size), {', '.join(f'CASE WHEN pooled = 1 AND size >= {n} THEN run ELSE 0 END AS drought_{t}_pooled_{n}length' for n in lengths)} FROM s{t})"""
        last = f"w{t}"
    return out + f" SELECT * FROM {last}"


@query(_drought_sql((10, 20, 25), (1, 3, 6, 12)))
def drought_runs(spark, sf_dir):
    """WIN-2 to WIN-7: after the series' aggregation one exchange by plant serves all windows."""
    return drought.drought_columns(drought.seasonal_percentile(series(spark, sf_dir).repartition("plant_id"), "plant_id", "month", "value"), "plant_id", "month")


@query(f"""WITH {SERIES} SELECT plant_id, month, value, round((2 * (rank() OVER (PARTITION BY plant_id, month(month) ORDER BY value) - 1)
    + count(*) OVER (PARTITION BY plant_id, month(month), value) + 1) * 50.0 / count(*) OVER (PARTITION BY plant_id, month(month)), 6) AS percentile FROM series""")
def percentile_rank_seasonal(spark, sf_dir):
    """WIN-2."""
    return drought.seasonal_percentile(series(spark, sf_dir), "plant_id", "month", "value").withColumn("percentile", F.round("percentile", 6))


def _gap_sql(agg, missing):
    return f"""WITH m AS (SELECT l_partkey AS plant_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {agg}(l_quantity) AS v FROM lineitem GROUP BY ALL),
        spans AS (SELECT plant_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY plant_id)
        SELECT s.plant_id, last_day(CAST(s.month AS DATE)) AS month, round({missing}, 6) AS l_quantity FROM spans s LEFT JOIN m ON m.plant_id = s.plant_id AND m.month = CAST(s.month AS DATE)"""


def _gaps(spark, sf_dir, how):
    """A part isn't shipped in each month, so there are gaps to fill."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "plant_id")
    return panel.monthly(lines, ["plant_id"], "l_shipdate", "l_quantity", how).withColumn("l_quantity", F.round("l_quantity", 6))


@query(_gap_sql("avg", "v"))
def monthly_mean_gapfill(spark, sf_dir):
    """AGG-2, AGG-3."""
    return _gaps(spark, sf_dir, "mean")


@query(_gap_sql("sum", "coalesce(v, 0)"))
def monthly_sum_gapfill(spark, sf_dir):
    """AGG-3."""
    return _gaps(spark, sf_dir, "sum")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MWH' WHEN 'O' THEN 'GWH' ELSE 'MW' END AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    CASE o_orderstatus WHEN 'F' THEN o_totalprice / (day(last_day(o_orderdate)) * 24) WHEN 'O' THEN o_totalprice * 1000 / (day(last_day(o_orderdate)) * 24) ELSE o_totalprice END AS mean_mw FROM orders""")
def unit_convert_hours(spark, sf_dir):
    """PRJ-6, DT-4, DT-6."""
    unit = F.when(F.col("o_orderstatus") == "F", "MWH").when(F.col("o_orderstatus") == "O", "GWH").otherwise("MW")
    month = calendar.month_of(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", unit.alias("unit"), month.alias("month"), kernels.mean_power_mw(F.col("o_totalprice"), unit, month).alias("mean_mw"))


@query("SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -980)")
def entity_drop_negative(spark, sf_dir):
    """FLT-9."""
    return dedup.drop_entities_with(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal") < -980)


#: Values with zeros and missing ones, made alike on both sides.
_ZEROS = "o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v"


@query(f"""WITH o AS (SELECT {_ZEROS} FROM orders) SELECT * FROM o WHERE o_custkey IN
    (SELECT o_custkey FROM o GROUP BY 1 HAVING avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) < 0.2)""")
def entity_drop_zero_share(spark, sf_dir):
    """FLT-10, AGG-8."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", _ZEROS.split(", ", 2)[2])
    return dedup.drop_entities_by_share(rows.withColumn("v", F.col("v").cast("double")), "o_custkey", F.col("v") == 0, 0.2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def min_obs_filter(spark, sf_dir):
    """FLT-11."""
    return dedup.drop_short_entities(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("""WITH u AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source_priority, o_orderkey AS row_ordinal, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, month ORDER BY source_priority, row_ordinal) = 1""")
def dedup_priority(spark, sf_dir):
    """DDP-2, SET-1, SET-2: three sources, of which the last has no value column."""
    orders = table(spark, sf_dir, "orders").withColumn("month", calendar.month_of(F.col("o_orderdate")))
    part = lambda s, *more: orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("row_ordinal"), "o_custkey", "month", *more)
    union = dedup.union_by_priority([part("F", "o_totalprice"), part("O", "o_totalprice"), part("P")])
    return dedup.keep_first(union, ["o_custkey", "month"], ["source_priority", "row_ordinal"])


@query("""SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_totalprice NULLS LAST, o_orderkey) = 1""")
def dedup_keep_first(spark, sf_dir):
    """DDP-1, SRT-1, AGG-13."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", calendar.month_of(F.col("o_orderdate")).alias("month"), "o_totalprice", "o_orderkey")
    return dedup.keep_first(rows, ["o_custkey", "month"], ["o_totalprice", "o_orderkey"])


@query("SELECT p_brand, p_size, p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) = 1")
def dedup_keep_none(spark, sf_dir):
    """DDP-4."""
    return dedup.drop_ambiguous(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_pairs(spark, sf_dir):
    """DDP-3, DDP-5."""
    return dedup.distinct_on(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"])


@query("""SELECT s.s_suppkey, d.c_name AS contact FROM supplier s LEFT JOIN (SELECT c_nationkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1) d
    ON s.s_nationkey = d.c_nationkey""")
def lookup_last_wins(spark, sf_dir):
    """JN-4."""
    out = lookup.lookup(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), {"s_nationkey": "c_nationkey"}, {"contact": "c_name"}, "c_custkey")
    return out.select("s_suppkey", "contact")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_chain(spark, sf_dir):
    """JN-5, JN-1."""
    steps = [(table(spark, sf_dir, "nation"), {"s_nationkey": "n_nationkey"}, {"n_name": "n_name", "n_regionkey": "n_regionkey"}), (table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}, {"r_name": "r_name"})]
    return lookup.lookup_chain(table(spark, sf_dir, "supplier"), steps).select("s_suppkey", "n_name", "r_name")


@query("""SELECT o_orderkey, d.price FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_extendedprice DESC) = 1) d
    ON o_orderkey = d.l_orderkey AND 2 = d.l_linenumber""")
def lookup_composite(spark, sf_dir):
    """JN-6."""
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_partkey", "l_extendedprice"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(2).alias("line"))
    return lookup.lookup(orders, lines, {"o_orderkey": "l_orderkey", "line": "l_linenumber"}, {"price": "l_extendedprice"}, "at").select("o_orderkey", "price")


@query("""SELECT s.s_suppkey, d.c_name FROM supplier s LEFT JOIN (SELECT CAST(floor(c_acctbal) AS BIGINT) AS balance, c_name FROM customer QUALIFY count(*) OVER (PARTITION BY floor(c_acctbal)) = 1) d
    ON CAST(floor(s.s_acctbal) AS BIGINT) = d.balance""")
def lookup_unique(spark, sf_dir):
    """JN-7: for each supplier the only customer of the same whole balance; none if there are several."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("whole"))
    customers = table(spark, sf_dir, "customer").select(F.floor("c_acctbal").alias("balance"), "c_name")
    return lookup.lookup_unique(supplier, customers, {"whole": "balance"}, {"c_name": "c_name"}).select("s_suppkey", "c_name")


@query("""SELECT p.p_partkey, d.larger FROM part p LEFT JOIN (SELECT p_brand, p_type, p_size, p_name AS larger FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type, p_size) = 1) d
    ON p.p_brand = d.p_brand AND p.p_type = d.p_type AND p.p_size + 1 = d.p_size""")
def lookup_unique_all(spark, sf_dir):
    """JN-7: for each part, the only one of its brand and type that is one size larger; none if there are several."""
    parts = table(spark, sf_dir, "part")
    smaller = parts.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (F.col("p_size") + 1).alias("size"))
    return lookup.lookup_unique(smaller, parts, {"brand": "p_brand", "type": "p_type", "size": "p_size"}, {"larger": "p_name"}).select("p_partkey", "larger")


@query("""SELECT n.n_nationkey, n.n_name, coalesce(d.s_acctbal, 0) AS balance FROM nation n LEFT JOIN (SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000
    QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) d ON n.n_nationkey = d.s_nationkey""")
def lookup_first_or_zero(spark, sf_dir):
    """JN-8."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return lookup.lookup_first_or(table(spark, sf_dir, "nation"), rich, {"n_nationkey": "s_nationkey"}, {"balance": "s_acctbal"}, "s_suppkey", 0.0).select("n_nationkey", "n_name", "balance")


@query("SELECT c_mktsegment, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) = 1")
def invert_mapping(spark, sf_dir):
    """JN-9."""
    return lookup.invert(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_mktsegment", "c_nationkey")


@query("""SELECT s_suppkey, coalesce(CASE WHEN n_regionkey = 1 THEN -1.0 END, s_acctbal) AS replaced, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END, CASE WHEN n_regionkey = 1 THEN -1.0 END) AS filled
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def override_and_fill(spark, sf_dir):
    """PRJ-8, PRJ-9."""
    dim = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 1, -1.0).alias("new"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("replaced"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("filled"))
    on = {"s_nationkey": "n_nationkey"}
    return lookup.fill_from(lookup.override(rows, dim, on, "replaced", "new"), dim, on, "filled", "new").select("s_suppkey", "replaced", "filled")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, CAST(p_size AS DOUBLE)) AS head_m,
    CASE WHEN p_size % 3 = 0 AND p_brand LIKE '%1' THEN 0.0 WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS res_vol,
    CASE WHEN p_size > 25 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS chosen, TRY_CAST(nullif(CASE WHEN p_size % 4 = 0 THEN 'NA' WHEN p_size % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END, 'NA') AS DOUBLE) AS number,
    coalesce(CASE WHEN p_size % 4 <> 0 THEN p_brand END, 'NA') AS brand, 'MW' AS unit FROM part""")
def plant_attributes(spark, sf_dir):
    """PRJ-2, PRJ-4, PRJ-7, PRJ-10, PRJ-11, PRJ-12, PRJ-14."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    word = F.when(size % 4 == 0, "NA").when(size % 5 == 0, "x").otherwise(size.cast("string"))
    volume = F.when(size % 3 != 0, price)
    return table(spark, sf_dir, "part").select(
        "p_partkey", kernels.or_else(F.when(size % 2 == 0, price), size.cast("double")).alias("head_m"), kernels.zero_where(volume, F.col("p_brand").endswith("1")).alias("res_vol"),
        F.when(size > 25, price).otherwise(size.cast("double")).alias("chosen"), nulls.sentinel_to_number(word).alias("number"), F.coalesce(F.when(size % 4 != 0, F.col("p_brand")), F.lit("NA")).alias("brand"), F.lit("MW").alias("unit"),
    )


@query("""WITH a AS (SELECT c_custkey AS customer, c_acctbal AS capacity FROM customer), b AS (SELECT o_custkey AS customer, round(sum(o_totalprice), 2) AS capacity FROM orders GROUP BY 1)
    SELECT coalesce(a.customer, b.customer) AS customer, round(coalesce(a.capacity, 0) + coalesce(b.capacity, 0), 2) AS capacity FROM a FULL JOIN b ON a.customer = b.customer""")
def outer_merge_total(spark, sf_dir):
    """JN-3: each customer's balance and orders; some have no orders."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("capacity"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.round(F.sum("o_totalprice"), 2).alias("capacity"))
    return lookup.outer_total(a, b, ["customer"], "capacity").withColumn("capacity", F.round("capacity", 2))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)
    SELECT coalesce(a.day, b.day) AS day, round(coalesce(a.amount, 0) + coalesce(b.amount, 0), 2) AS amount FROM a FULL JOIN b ON a.day = b.day""")
def outer_merge_total_all(spark, sf_dir):
    """JN-3: amounts ordered and shipped by day, all rows of both tables; some days have only one of them."""
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return lookup.outer_total(a, b, ["day"], "amount").withColumn("amount", F.round("amount", 2))


@query("""SELECT s_nationkey, year, make_date(year, CAST(m.m AS BIGINT), 1) AS month, capacity FROM (SELECT s_nationkey, 2000 + s_suppkey % 5 AS year, s_acctbal AS capacity FROM supplier), generate_series(1, 12) m(m)""")
def year_to_months(spark, sf_dir):
    """JN-13."""
    yearly = table(spark, sf_dir, "supplier").select("s_nationkey", (2000 + F.col("s_suppkey") % 5).alias("year"), F.col("s_acctbal").alias("capacity"))
    return panel.year_to_months(yearly.withColumn("year", F.col("year").cast("int")), "year")


@query("SELECT s_suppkey, CAST(m.m AS DATE) AS month FROM supplier, generate_series(DATE '1982-01-01', DATE '2022-12-01', INTERVAL 1 MONTH) m(m)")
def cross_month_panel(spark, sf_dir):
    """JN-12, DT-8: 492 months."""
    return panel.month_panel(table(spark, sf_dir, "supplier").select("s_suppkey"), "1982-01-01", "2022-12-01")


_WIDE = "s_nationkey AS country, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE CAST(CAST(s_acctbal AS INT) AS VARCHAR) END AS y2000, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS y2001"


@query(f"""WITH w AS (SELECT {_WIDE} FROM supplier) SELECT country, s_suppkey, year, CASE WHEN v = '-' THEN 0.0 ELSE CAST(v AS DOUBLE) END AS capacity
    FROM (SELECT country, s_suppkey, 'y2000' AS year, y2000 AS v FROM w UNION ALL SELECT country, s_suppkey, 'y2001', y2001 FROM w)""")
def unpivot_years(spark, sf_dir):
    """RSH-1, RSH-2, PRJ-13."""
    s = F.col("s_suppkey")
    wide = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("country"), s, F.when(s % 3 == 0, "-").otherwise(F.bround("s_acctbal").cast("int").cast("string")).alias("y2000"), F.when(s % 4 != 0, F.col("s_nationkey").cast("string")).alias("y2001"))
    return panel.long_form(wide, ["country", "s_suppkey"], None, "year", "capacity").withColumn("capacity", nulls.dash_to_zero(F.col("capacity")))


#: Years that have a column of the wide form; orders of any other year, or none, are summed in one more.
_ORDER_YEARS = [str(y) for y in range(1992, 2002)]


@query(f"""SELECT o_custkey, {', '.join(f'round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2) AS "{y}"' for y in _ORDER_YEARS)},
    round(sum(o_totalprice) FILTER (o_orderdate IS NULL OR year(o_orderdate) NOT IN ({', '.join(_ORDER_YEARS)})), 2) AS other FROM orders GROUP BY 1""")
def pivot_years(spark, sf_dir):
    """RSH-3."""
    year = F.year("o_orderdate").cast("string")
    year = F.when(year.isin(_ORDER_YEARS), year).otherwise("other").alias("year")
    long = table(spark, sf_dir, "orders").groupBy("o_custkey", year).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return panel.wide_form(long, ["o_custkey"], "year", "v", [*_ORDER_YEARS, "other"])


@query(f"WITH {SERIES} SELECT plant_id, month, value AS physical_hydropower_0n, {', '.join(f'lag(value, {k}) OVER w AS physical_hydropower_{k}n' for k in range(1, 7))} FROM series WINDOW w AS (PARTITION BY plant_id ORDER BY month)")
def lag_features_0_6(spark, sf_dir):
    """WIN-1."""
    return panel.lag_features(series(spark, sf_dir), "plant_id", "month", "value")


@query(f"""WITH {SERIES} SELECT s.plant_id, s.month, s.value AS physical_hydropower_0n, {', '.join(f's{k}.value AS physical_hydropower_{k}n' for k in range(1, 7))} FROM series s
    {' '.join(f"LEFT JOIN series s{k} ON s{k}.plant_id = s.plant_id AND s{k}.month = CAST(s.month - INTERVAL {k} MONTH AS DATE)" for k in range(1, 7))}""")
def lag_features_by_month(spark, sf_dir):
    """WIN-1, DT-7: exact months."""
    return panel.lag_features_by_month(series(spark, sf_dir), "plant_id", "month", "value")


@query(f"""WITH {SERIES}, c AS (SELECT s_suppkey AS plant_id, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal * 50 END AS capacity FROM supplier), m AS (SELECT plant_id, max(value) AS most FROM series GROUP BY 1)
    SELECT c.plant_id, CASE WHEN round_even(most, 0) > capacity THEN round_even(most, 0) ELSE capacity END AS capacity, count(*) AS months FROM c JOIN series USING (plant_id) JOIN m USING (plant_id) GROUP BY ALL""")
def capacity_repair(spark, sf_dir):
    """DOM-13, AGG-5, MTH-1."""
    plants = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plant_id"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") * 50).alias("capacity"))
    joined = series(spark, sf_dir).join(plants, "plant_id")
    return panel.repair_capacity(joined, "plant_id", "capacity", "value").groupBy("plant_id", "capacity").agg(F.count(F.lit(1)).alias("months"))


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def anti_keep_null(spark, sf_dir):
    """FLT-3."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rows.where(nulls.not_in(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_and_anti(spark, sf_dir):
    """FLT-1, FLT-2, JN-21."""
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup.anti(lookup.semi(rows, customer.where("c_mktsegment = 'BUILDING'"), "o_custkey"), customer.where("c_acctbal < 0"), "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE NOT (o_orderstatus = 'F' AND year(o_orderdate) > 1998) AND o_orderdate < TIMESTAMP '2000-01-01' AND o_totalprice > 10 AND o_orderdate >= TIMESTAMP '1995-03-01'""")
def date_filters(spark, sf_dir):
    """FLT-4 to FLT-7, FLT-13, FLT-16: bounds on the date itself, which reach the scan."""
    rows = table(spark, sf_dir, "orders")
    late = nulls.is_true((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") > 1998))
    date = F.col("o_orderdate")
    return rows.where(~late & (date < F.lit("2000-01-01").cast("timestamp_ntz")) & (date >= F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 10)).select("o_orderkey", "o_orderdate")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders), m AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'P') AS stop FROM r GROUP BY 1)
    SELECT r.* FROM r JOIN m USING (o_custkey) WHERE stop IS NULL OR o_orderkey <= stop""")
def until_marker(spark, sf_dir):
    """FLT-14."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return dedup.until_marker(rows, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "P")


@query("""SELECT p_partkey, regexp_replace(replace(lower(p_type), '-', ''), '[\\r\\n]', '_', 'g') AS label, CASE WHEN contains(p_name, 'a') THEN 'a' WHEN contains(p_name, 'b') THEN 'b' WHEN contains(p_name, 'c') THEN 'c' ELSE p_name END AS canonical,
    split_part(p_brand, '#', 2) AS brand_no, regexp_full_match(split_part(p_brand, '#', 2), '[0-9]+') AS digits FROM part""")
def clean_strings(spark, sf_dir):
    """STR-1 to STR-4, FLT-15."""
    number = text.part_of(F.col("p_brand"), "#", 1)
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_label(F.col("p_type")).alias("label"), text.canonical_label(F.col("p_name"), ["a", "b", "c"]).alias("canonical"), F.coalesce(number, F.lit("")).alias("brand_no"), text.digits_only(F.coalesce(number, F.lit(""))).alias("digits"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, make_date(year(o_orderdate), month(o_orderdate), 1) AS month, month(o_orderdate) AS number, year(o_orderdate) AS year, strftime(o_orderdate, '%d-%m-%Y') AS shown, last_day(o_orderdate) AS month_end,
    day(last_day(o_orderdate)) AS days FROM orders""")
def date_functions(spark, sf_dir):
    """DT-1 to DT-8, STR-6."""
    d = F.col("o_orderdate")
    name = F.date_format(d, "MMM")
    shown = calendar.day_text(d)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", calendar.parse_date(shown, "yyyy-MM-dd", "dd-MM-yyyy").alias("parsed"), calendar.month_from_parts(F.year(d), F.month(d)).alias("month"), calendar.month_number(name).alias("number"),
        F.year(d).alias("year"), shown.alias("shown"), calendar.month_end(d).alias("month_end"), calendar.days_in_month(d).alias("days"),
    )


@query("""SELECT c_nationkey, count(*) AS rows, count(DISTINCT c_mktsegment) AS segments, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS negative, round(max(c_acctbal), 2) AS most, round(sum(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END), 2) AS some,
    CASE WHEN bool_or(c_acctbal < -900) THEN NULL ELSE max(c_acctbal) END AS strict_max FROM customer GROUP BY 1""")
def entity_measures(spark, sf_dir):
    """AGG-1, AGG-5 to AGG-8, AGG-12, AGG-14."""
    balance = F.col("c_acctbal")
    kept = F.when(balance >= -900, balance)
    return panel.aggregate(table(spark, sf_dir, "customer"), ["c_nationkey"], {
        "rows": F.count(F.lit(1)), "segments": F.countDistinct("c_mktsegment"), "negative": F.count_if(balance < 0), "most": F.round(F.max(balance), 2),
        "some": F.round(nulls.sum_or_zero(F.when(F.col("c_custkey") % 4 == 0, balance)), 2), "strict_max": nulls.max_unless_missing(kept),
    })


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS months, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
    SELECT o_custkey, months, o_orderpriority AS first_priority, CASE WHEN months <= 12 THEN '0-12' WHEN months <= 60 THEN '12-60' WHEN months <= 120 THEN '60-120' WHEN months <= 240 THEN '120+' END AS history,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS code, round(c_acctbal * 0.025, 6) AS size FROM f JOIN customer ON o_custkey = c_custkey WHERE r = 1""")
def attribute_report(spark, sf_dir):
    """RPT-1, BIN-1 to BIN-3."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("months"))
    first = dedup.keep_first(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])
    out = lookup.lookup(first.join(counts, "o_custkey"), table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"balance": "c_acctbal"}).where("balance is not null")
    kind = F.when(F.col("o_orderstatus") == "F", "ROR").when(F.col("o_orderstatus") == "O", "STO").otherwise("other")
    return out.select("o_custkey", "months", F.col("o_orderpriority").alias("first_priority"), kernels.history_class(F.col("months")).alias("history"), kernels.plant_type_code(kind).alias("code"), F.round(kernels.marker_size(F.col("balance")), 6).alias("size"))


@query("""SELECT o_orderkey, CASE WHEN x < 0 THEN 0 WHEN x > 1 THEN 1 ELSE x END AS factor, CASE WHEN x < 0 THEN 0 WHEN x > 1 THEN 1 ELSE x END * 40 AS mw FROM
    (SELECT o_orderkey, round(CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_totalprice / 200000 END, 9) AS x FROM orders)""")
def capacity_factor_clip(spark, sf_dir):
    """PRJ-15 to PRJ-17."""
    key = F.col("o_orderkey")
    x = F.round(F.when(key % 6 == 0, None).when(key % 5 == 0, -1.0).otherwise(nulls.ratio(F.col("o_totalprice"), F.lit(200000.0))), 9)
    factor = nulls.clip(x, 0, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", factor.alias("factor"), kernels.power_from_factor(factor, F.lit(40.0)).alias("mw"))


@query()
def fuzzy_match(spark, sf_dir):
    """JN-10, JN-11, STR-5, SRT-4."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("choice"))
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("the "), F.lower("s_name")).alias("n")).union(table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(" (the)"))))
    return lookup.best_names(names, "n", nations, {"nation_3 (the)": "NATION_3"}).drop("scored")
