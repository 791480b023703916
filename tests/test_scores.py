"""Scores of the model queries against naive ones, and of the fuzzy match against a plain version."""

import difflib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect
from tidewheel.operators import grid, models, panel
from tidewheel.plans.catalog import QUERIES
from tidewheel.plans.registry import series

SF = "/root/testdata/sf0.01"


def error(scored, label):
    return models.rmse(scored, label)


@pytest.mark.parametrize("name", ["rf_score", "gbt_score", "mlp_score"])
def test_models_beat_the_mean(spark, name):
    lagged = panel.lag_features(series(spark, SF), "plant_id", "month", "value").dropna()
    later = lagged.where("month >= date'1999-01-01'")
    mean = lagged.where("month < date'1999-01-01'").agg(F.avg("physical_hydropower_0n")).first()[0]
    scored = QUERIES[name](spark, SF)
    assert scored.count() == later.count()
    got = error(scored.join(later, ["plant_id", "month"]), "physical_hydropower_0n")
    assert got < 1.02 * error(later.withColumn("prediction", F.lit(mean)), "physical_hydropower_0n")


def test_global_scores_against_the_mean(spark):
    """The sales that stand for generation have no pattern in time: the forest beats the mean where it was fitted and isn't far off later."""
    scored = QUERIES["global_scoring"](spark, SF)
    known = QUERIES["training_panel"](spark, SF).select("plant_id", "month", "observed", "split")
    both = scored.join(known, ["plant_id", "month"]).persist()
    mean = known.where("split = 'train'").agg(F.avg("observed")).first()[0]
    for split, most in (("train", 1.0), ("test", 1.15)):
        rows = both.where(F.col("split") == split)
        assert rows.count() and error(rows, "observed") < most * error(rows.withColumn("prediction", F.lit(mean)), "observed")


def similar(a, b):
    return round(100 * difflib.SequenceMatcher(None, a, b).ratio())


def token_set(a, b):
    a, b = ({w for w in re.split(r"\W+", t.lower()) if w} for t in (a, b))
    if not a or not b:
        return 0
    both, first, second = (" ".join(sorted(x)) for x in (a & b, a - b, b - a))
    one, two = f"{both} {first}".strip(), f"{both} {second}".strip()
    return max(similar(one, two), similar(both, one) if both else 0, similar(both, two) if both else 0)


def test_fuzzy_match_against_plain_python(spark):
    con = connect(SF)
    nations = sorted({r[0] for r in con.execute("SELECT n_name FROM nation").fetchall()})
    names = {r[0] for r in con.execute("SELECT 'the ' || lower(s_name) FROM supplier UNION SELECT lower(n_name) || ' (the)' FROM nation").fetchall()}
    got = {r.name: (r.match, r.score) for r in QUERIES["fuzzy_match"](spark, SF).collect()}
    assert set(got) == names
    for name in names:
        score, best = max((token_set(name, n), n) for n in nations)
        assert got[name] == ("NATION_3" if name == "nation_3 (the)" else best, score)


def test_country_mean_falls_back_month_by_month(spark):
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5, "m1", 2.0), (0, 0, 0.5, 0.5, "m2", None), (1, 0, 1.5, 0.5, "m1", 4.0), (1, 0, 1.5, 0.5, "m2", 6.0)], "lat_idx int, lon_idx int, lon double, lat double, month string, value double")
    countries = spark.createDataFrame([(0, 0, 7), (1, 0, 8)], "lat_idx int, lon_idx int, country_code int")
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    shapes = spark.createDataFrame([(i, square) for i in (7, 9)], "id int, ring array<struct<x: double, y: double>>")
    got = sorted(map(tuple, grid.country_mean_or_inside(cells, countries, shapes, "value", "mean").collect()))
    assert got == [(7, "m1", 2.0), (7, "m2", 6.0), (8, "m1", 4.0), (8, "m2", 6.0), (9, "m1", 3.0), (9, "m2", 6.0)]
    with_crs = lambda df, name: df.withColumn("crs", F.lit(name))
    assert grid.country_mean_or_inside(with_crs(cells, "a"), countries, with_crs(shapes, "a"), "value", "mean").count() == 6
    with pytest.raises(Exception, match="coordinate systems"):
        grid.country_mean_or_inside(with_crs(cells, "a"), countries, with_crs(shapes, "b"), "value", "mean").collect()


@pytest.mark.parametrize("activation", ["relu", "tanh", "sigmoid"])
def test_perceptron_gradient_is_that_of_the_error(activation):
    rng = np.random.default_rng(4)
    sizes = [3, 5, 4, 1]
    layers = [(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    x, y, l2 = rng.normal(size=(20, 3)), rng.normal(size=20), 0.01
    masks = [(rng.random(n) > 0.4) / 0.6 for n in (5, 4)]
    for m in ((), masks):
        net = models.Perceptron(layers, np.zeros(3), np.ones(3), activation)
        grads = net.gradients(x, y, l2, m)

        def loss(changed, m=m):
            n = models.Perceptron(changed, np.zeros(3), np.ones(3), activation)
            return ((n.forward(x, m)[-1][:, 0] - y) ** 2).sum() + 0.5 * l2 * len(x) * sum((w * w).sum() for w, _ in changed)

        for i in range(3):
            for k in range(2):
                place = tuple(rng.integers(0, n) for n in layers[i][k].shape)
                ends = []
                for d in (1e-5, -1e-5):
                    changed = [[w.copy(), b.copy()] for w, b in layers]
                    changed[i][k][place] += d
                    ends.append(loss(changed))
                assert grads[i][k][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-3)


def test_trees_deeper_than_sparks_warn():
    with pytest.warns(UserWarning, match="depth 30"):
        assert models._depth(50) == 30
    assert models._depth(12) == 12 and math.isfinite(models.SEED)
