"""Queries over model panels: splits, reallocation, standardisation, models and the pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.operators import models, panel, perceptron, splits, trees, tuning
from tidewheel.plans import pipelines
from tidewheel.operators.staging import shared_folder, written
from tidewheel.plans.registry import SERIES, query, series, table

_YEARS = {"NATION_3": (1996, 1997, 1998), "NATION_6": (1997, None, 1998), "NATION_12": (1995, 1996, 1999), "NATION_2": (1998, 1999, 2000)}
_NATION_SERIES = f"{SERIES}, named AS (SELECT n_name AS country, plant_id, month, value FROM series JOIN supplier ON plant_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def named_series(spark, sf_dir):
    plants = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("plant_id"), F.col("n_name").alias("country"))
    return series(spark, sf_dir).join(plants, "plant_id").select("country", "plant_id", "month", "value")


_CASE = " ".join(f"WHEN country = '{c}' AND year(month) <= {a} THEN 'train' " + (f"WHEN country = '{c}' AND year(month) = {b} THEN 'valid' " if b else "") + f"WHEN country = '{c}' AND year(month) >= {d} THEN 'test'" for c, (a, b, d) in _YEARS.items())


@query(f"WITH {_NATION_SERIES} SELECT * FROM (SELECT *, CASE {_CASE} END AS split FROM named) WHERE split IS NOT NULL")
def country_time_split(spark, sf_dir):
    """MLP-1."""
    return splits.split_by_years(named_series(spark, sf_dir), "country", "month", _YEARS)


@query(f"""WITH {SERIES}, f AS (SELECT plant_id, row_number() OVER (ORDER BY min(value), plant_id) AS r, count(*) OVER () AS n FROM series GROUP BY 1)
    SELECT plant_id, month, value, split FROM (SELECT s.*, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN month <= DATE '1998-05-01' THEN 'valid' WHEN month >= DATE '1999-06-01' THEN 'test' END AS split FROM series s JOIN f USING (plant_id)) WHERE split IS NOT NULL""")
def entity_order_split(spark, sf_dir):
    """MLP-2, WIN-8."""
    return splits.split_by_entities(series(spark, sf_dir).withColumn("o", F.struct("value", "plant_id")), "plant_id", "month", "o", 0.7, "1998-05-01", "1999-06-01").drop("o")


_SPLIT = "CASE WHEN plant_id % 5 = 0 AND month < DATE '1996-06-01' THEN 'train' WHEN plant_id % 5 IN (1, 2) AND month < DATE '1997-01-01' THEN 'train' WHEN plant_id % 5 = 3 AND month < DATE '1996-10-01' THEN 'valid' WHEN plant_id % 5 = 3 THEN 'test' WHEN month < DATE '1999-01-01' THEN 'valid' ELSE 'test' END"


def split_series(spark, sf_dir):
    return series(spark, sf_dir).withColumn("split", F.expr(_SPLIT))


_REALLOC = f"""{SERIES}, s0 AS (SELECT *, {_SPLIT} AS split FROM series), n AS (SELECT plant_id, count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'valid') AS v FROM s0 GROUP BY 1),
    s1 AS (SELECT s0.* EXCLUDE (split), CASE WHEN (t > 0 AND t < 24) OR (t = 0 AND v > 0 AND v < 24) THEN 'train' ELSE split END AS split FROM s0 JOIN n USING (plant_id))"""


@query(f"WITH {_REALLOC} SELECT * FROM s1")
def realloc_short_train(spark, sf_dir):
    """MLP-3, MLP-4."""
    return splits.reallocate(split_series(spark, sf_dir), "plant_id", 24)


_SCALED = f"""{_REALLOC}, st AS (SELECT plant_id, split, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM s1 GROUP BY ALL),
    best AS (SELECT plant_id, m, CASE WHEN sd = 0 THEN 1 ELSE sd END AS sd FROM st WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) = 1),
    z AS (SELECT s1.*, round(CASE WHEN st.n > 1 THEN (value - best.m) / best.sd END, 6) AS value_plant_std FROM s1 JOIN st USING (plant_id, split) LEFT JOIN best USING (plant_id))"""


def scaled(spark, sf_dir):
    out = splits.standardise(splits.reallocate(split_series(spark, sf_dir), "plant_id", 24), "plant_id", ["value"])
    return out.select("plant_id", "month", "value", "split", F.round("value_plant_std", 6).alias("value_plant_std"))


@query(f"WITH {_SCALED} SELECT * FROM z")
def plant_standardise(spark, sf_dir):
    """MLP-5."""
    return scaled(spark, sf_dir)


@query(f"WITH {_SCALED} SELECT * FROM z WHERE value_plant_std BETWEEN -1.5 AND 1.5")
def sigma_clip_filter(spark, sf_dir):
    """FLT-12."""
    return splits.within(scaled(spark, sf_dir), ["value_plant_std"], 1.5)


@query(f"""WITH {SERIES}, f AS (SELECT plant_id, avg(value) AS m, stddev_pop(value) AS sd FROM series WHERE plant_id % 2 = 0 GROUP BY 1), o AS (SELECT plant_id, avg(value) AS m, stddev_pop(value) AS sd FROM series WHERE month >= DATE '1999-01-01' GROUP BY 1)
    SELECT plant_id, month, round((value - coalesce(f.m, o.m)) / CASE WHEN coalesce(f.sd, o.sd) = 0 THEN 1 ELSE coalesce(f.sd, o.sd) END, 6) AS value_plant_std FROM series JOIN o USING (plant_id) LEFT JOIN f USING (plant_id) WHERE month >= DATE '1999-01-01'""")
def global_standardise(spark, sf_dir):
    """MLP-6."""
    rows = series(spark, sf_dir)
    fitted = splits.entity_scales(rows.where("plant_id % 2 = 0").withColumn("split", F.lit("train")), "plant_id", ["value"])
    out = splits.standardise_with(rows.where("month >= date'1999-01-01'"), fitted, "plant_id", ["value"])
    return out.select("plant_id", "month", F.round("value_plant_std", 6).alias("value_plant_std"))


@query("SELECT s_suppkey, round(1 / (count(DISTINCT s_suppkey) OVER (PARTITION BY s_nationkey) + 1e-8), 9) AS weight FROM supplier")
def inverse_country_weight(spark, sf_dir):
    """AGG-15."""
    return splits.inverse_frequency(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", F.round("weight", 9).alias("weight"))


@query("""WITH c AS (SELECT var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy,
    avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem),
    m AS (SELECT *, (qy * vd - dy * qd) / (vq * vd - qd * qd) AS a, (dy * vq - qy * qd) / (vq * vd - qd * qd) AS b FROM c)
    SELECT l_orderkey, l_linenumber, round(my + a * (l_quantity - mq) + b * (l_discount - md), 2) AS prediction FROM lineitem, m""")
def ols_score(spark, sf_dir):
    """MDL-1, MDL-7, MLP-7: two features, fitted and scored on all rows."""
    lines = table(spark, sf_dir, "lineitem")
    model = models.ols(lines, ["l_quantity", "l_discount"], "l_extendedprice")
    return models.predict(model, lines, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 2) AS prediction FROM lineitem, m""")
def ols_score_all(spark, sf_dir):
    """MDL-1, MDL-7, MLP-7: one feature, fitted and scored on all rows."""
    lines = table(spark, sf_dir, "lineitem")
    model = models.ols(lines, ["l_quantity"], "l_extendedprice")
    return models.predict(model, lines, ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


def _lagged(spark, sf_dir):
    """The lags, written once: each fit reads them several times, and the lines behind them are read once."""
    lagged = written(panel.lag_features(series(spark, sf_dir), "plant_id", "month", "value").dropna(), "lagged")
    return lagged.withColumn("season", F.month("month")), [f"physical_hydropower_{k}n" for k in range(1, 7)] + ["season"]


@query()
def rf_score(spark, sf_dir):
    """MDL-2, MDL-7."""
    rows, columns = _lagged(spark, sf_dir)
    model = models.random_forest(rows.where("month < date'1999-01-01'"), columns, "physical_hydropower_0n", {"n_estimators": 20, "max_depth": 6})
    return models.predict(model, rows.where("month >= date'1999-01-01'"), columns).select("plant_id", "month", "prediction")


@query()
def gbt_score(spark, sf_dir):
    """MDL-3."""
    rows, columns = _lagged(spark, sf_dir)
    model = models.boosted_trees(rows.where("month < date'1998-01-01'"), columns, "physical_hydropower_0n", {"n_estimators": 8, "max_depth": 4}, rows.where("month between date'1998-01-01' and date'1998-12-01'"))
    return models.predict(model, rows.where("month >= date'1999-01-01'"), columns).select("plant_id", "month", "prediction")


@query()
def boosted_score(spark, sf_dir):
    """MDL-3: second-order boosting with ridge and columns by tree; as many trees as gbt_score, of the same depth."""
    rows, columns = _lagged(spark, sf_dir)
    params = {"num_boost_round": 8, "max_depth": 4, "learning_rate": 0.1, "reg_lambda": 1.0, "min_child_weight": 5, "colsample_bytree": 0.9}
    model = trees.fit_boosted(rows.where("month < date'1998-01-01'"), columns, "physical_hydropower_0n", params, rows.where("month between date'1998-01-01' and date'1998-12-01'"))
    return model.predict(rows.where("month >= date'1999-01-01'")).select("plant_id", "month", "prediction")


@query()
def deep_forest_score(spark, sf_dir):
    """MDL-2: trees of depth 50 with minima of rows to split and in leaves, grown in tasks."""
    rows, columns = _lagged(spark, sf_dir)
    params = {"n_estimators": 16, "max_depth": 50, "min_samples_leaf": 8, "min_samples_split": 20, "max_features": 3}
    model = trees.fit_forest(rows.where("month < date'1999-01-01'"), columns, "physical_hydropower_0n", params)
    return model.predict(rows.where("month >= date'1999-01-01'")).select("plant_id", "month", "prediction")


@query()
def mlp_score(spark, sf_dir):
    """MDL-4."""
    rows, columns = _lagged(spark, sf_dir)
    net = models.fit_perceptron(rows.where("month < date'1999-01-01'"), columns, "physical_hydropower_0n", (8,), rounds=5, rate=0.05)
    return models.perceptron_predict(net, rows.where("month >= date'1999-01-01'"), columns).select("plant_id", "month", "prediction")


@query()
def mlp_batches_score(spark, sf_dir):
    """MDL-4: mini-batches in barrier tasks, dropout and early stopping."""
    rows, columns = _lagged(spark, sf_dir)
    net = perceptron.fit_perceptron_batches(rows.where("month < date'1998-01-01'"), columns, "physical_hydropower_0n", (8,), epochs=3, batch=256, rate=0.01, dropout=0.1, valid=rows.where("month between date'1998-01-01' and date'1998-12-01'"))
    return models.perceptron_predict(net, rows.where("month >= date'1999-01-01'"), columns).select("plant_id", "month", "prediction")


@query()
def tuned_forest_score(spark, sf_dir):
    """MDL-5: nine forests at a ninth of the trees, three at a third, one whole; that one scores the last years."""
    rows, columns = _lagged(spark, sf_dir)
    rows, label = rows.persist(), "physical_hydropower_0n"
    train, valid = rows.where("month < date'1998-01-01'"), rows.where("month between date'1998-01-01' and date'1998-12-01'")
    fit = lambda p, share: models.random_forest(train, columns, label, p | {"n_estimators": max(1, round(18 * share))})
    error = lambda p, share: models.rmse(models.predict(fit(p, share), valid, columns), label)
    space = {"max_depth": (2, 8), "min_samples_leaf": (1, 40), "max_features": ["onethird", "sqrt", "all"]}
    found = tuning.tune(spark, error, space, f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}", "forest", trials=9)
    scored = models.predict(fit(found.params, 1.0), rows.where("month >= date'1999-01-01'"), columns).select("plant_id", "month", "prediction")
    rows.unpersist()
    return scored


@query(pipelines.TRAINING_SQL)
def training_panel(spark, sf_dir):
    """Stages B to D on the driver's tables: harmonise, filter, repair, lags, split."""
    return pipelines.training_panel_from_tables(spark, sf_dir)


@query(pipelines.PREPARED_SQL)
def prepared_panel(spark, sf_dir):
    """MLP-8 after stages B to D, with country means: reallocation, scaling and limits."""
    return pipelines.prepared_panel_from_tables(spark, sf_dir)


@query()
def global_scoring(spark, sf_dir):
    """Stage G: fit on the training panel and score all plants and months."""
    return pipelines.global_scores_from_tables(spark, sf_dir)
