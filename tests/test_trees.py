"""Boosted trees and forests against plain loops, and the registered queries against Spark's own models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import models, panel, trees
from tidewheel.plans import model_queries
from tidewheel.plans.catalog import QUERIES
from tidewheel.plans.registry import series

SF = "/root/testdata/sf0.01"


def made(n=240, seed=1, levels=23):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, 3)) / 4
    y = np.where(x[:, 0] > 2, 3.0, -1.0) + x[:, 1] * (x[:, 2] > 3) + rng.normal(size=n) * 0.3
    return x, np.round(y, 3), rng.integers(1, 4, n).astype(float)


def frame(spark, x, y, w):
    return spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double")


def plain_boosting(x, y, w, p, features_by_turn):
    m = np.full(len(y), (w * y).sum() / w.sum())
    for turn in range(p["num_boost_round"]):
        g, h = w * (m - y), w.copy()
        step = np.zeros(len(y))

        def grow(rows, depth, turn=turn, g=g, h=h, step=step):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p["reg_lambda"])
            best = None
            if depth < p["max_depth"]:
                for f in features_by_turn[turn]:
                    for border in np.unique(x[:, f])[:-1]:
                        left, right = rows[x[rows, f] <= border], rows[x[rows, f] > border]
                        if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= p["min_child_weight"]:
                            gain = score(left) + score(right) - score(rows)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left, right
            if best is None:
                step[rows] = -p["learning_rate"] * g[rows].sum() / (h[rows].sum() + p["reg_lambda"])
            else:
                grow(best[1], depth + 1), grow(best[2], depth + 1)

        grow(np.arange(len(y)), 0)
        m += step
    return m


def test_boosting_is_that_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 2)
    x, y, w = made()
    p = {"num_boost_round": 5, "max_depth": 3, "reg_lambda": 0.7, "min_child_weight": 6.0, "learning_rate": 0.3, "colsample_bytree": 0.7}
    rng = np.random.default_rng(trees.SEED)
    features = [sorted(rng.permutation(3)[:2].tolist()) for _ in range(5)]
    df = frame(spark, x, y, w)
    model = trees.fit_boosted(df, ["a", "b", "c"], "y", p, weight="w")
    want = plain_boosting(x, y, w, p, features)
    assert model.values(x) == pytest.approx(want, abs=1e-9)
    assert model.errors[-1][0] == pytest.approx(math.sqrt((w * (want - y) ** 2).sum() / w.sum()))
    got = model.predict(df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 0.0, 1.0)], df.schema)), "w", "p")
    assert got.count() == len(y) and {round(r.p, 9) for r in got.collect()} == {round(a * b, 9) for a, b in zip(want, w, strict=True)}


def test_boosting_stops_early_and_samples_rows(spark):
    x, y, w = made(400)
    df = frame(spark, x, y, w).withColumn("valid", F.pmod(F.xxhash64("a", "b", "c"), F.lit(3)) == 0)
    p = {"num_boost_round": 30, "max_depth": 4, "learning_rate": 0.9, "reg_lambda": 0.1, "subsample": 0.6, "early_stopping_rounds": 3}
    model = trees.fit_boosted(df.where("not valid"), ["a", "b", "c"], "y", p, df.where("valid"))
    held = [e[1] for e in model.errors]
    assert model.best_round == int(np.argmin(held)) == len(model.trees) < 30 and len(held) <= model.best_round + 4
    empty = trees.fit_boosted(df.where("false"), ["a", "b", "c"], "y", p)
    assert empty.trees == [] and empty.values(x)[0] == 0.0


def test_bins_cut_the_weight_evenly(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), 0.0, 9.0 if v < 0 else 1.0) for v in rng.normal(size=4_000)]
    table = trees.Table(spark.createDataFrame(rows, "a double, y double, w double"), ["a"], "y", "w", bins=10)
    bins, weights = np.searchsorted(table.borders[0], [r[0] for r in rows]), [r[2] for r in rows]
    share = np.bincount(bins, weights) / sum(weights)
    assert len(share) == 10 and share.max() < 0.13 and share.min() > 0.07


def plain_tree(x, y, w, p, depth=0):
    value = (w * y).sum() / w.sum()
    best = None
    if depth < p["max_depth"] and len(y) >= p["min_samples_split"]:
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for a, b in zip(levels, levels[1:], strict=False):
                left = x[:, f] <= a
                if min(left.sum(), (~left).sum()) >= p["min_samples_leaf"]:
                    gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, (a + b) / 2, left
    if best is None:
        return lambda q: np.full(len(q), value)
    _, f, cut, left = best
    one, two = (plain_tree(x[s], y[s], w[s], p, depth + 1) for s in (left, ~left))
    return lambda q: np.where(q[:, f] <= cut, one(q), two(q))


@pytest.mark.parametrize("local", [50_000, 40])
def test_deep_trees_are_those_of_plain_recursion(spark, local):
    x, y, w = made(500, 2)
    p = {"n_estimators": 2, "max_depth": 50, "min_samples_leaf": 1, "min_samples_split": 3, "bootstrap": False}
    model = trees.fit_forest(frame(spark, x, y, w), ["a", "b", "c"], "y", p, "w", local)
    want = plain_tree(x, y, w, p)(x)
    assert len(model.trees) == 2 and model.values(x) == pytest.approx(want, abs=1e-9)
    shallow = trees.fit_forest(frame(spark, x, y, w), ["a", "b", "c"], "y", p | {"n_estimators": 1, "max_depth": 2}, "w", local)
    assert max(shallow.trees[0].nodes_of(x)) <= 6 and shallow.values(x) == pytest.approx(plain_tree(x, y, w, p | {"max_depth": 2})(x), abs=1e-9)


def test_depth_50_is_honoured_and_models_are_kept(spark, tmp_path):
    y = 3.0 ** np.arange(60)  # each split takes the largest value off
    df = frame(spark, np.column_stack([np.arange(60.0)] * 3), y, np.ones(60))
    depth = lambda tree: max(map(int, _depths(tree)))
    p = {"n_estimators": 1, "bootstrap": False}
    for most in (12, 50):
        model = trees.fit_forest(df, ["a", "b", "c"], "y", p | {"max_depth": most})
        assert depth(model.trees[0]) == most
    model.save(str(tmp_path / "m.json"))
    assert trees.Trees.load(str(tmp_path / "m.json")) == model
    bagged = trees.fit_forest(df, ["a", "b", "c"], "y", {"n_estimators": 20, "max_features": 1})
    assert len({tuple(t.feature) for t in bagged.trees}) > 10 and trees.fit_forest(df.where("false"), ["a"], "y").trees == []


def _depths(tree):
    out, stack = [], [(0, 0)]
    while stack:
        node, d = stack.pop()
        out.append(d)
        if tree.feature[node] >= 0:
            stack += [(tree.left[node], d + 1), (tree.right[node], d + 1)]
    return out


def test_queries_against_sparks_models(spark):
    later = panel.lag_features(series(spark, SF), "plant_id", "month", "value").dropna().where("month >= date'1999-01-01'").persist()
    error = lambda name: models.rmse(QUERIES[name](spark, SF).join(later, ["plant_id", "month"]), "physical_hydropower_0n")
    assert error("boosted_score") < error("gbt_score")
    mean = later.agg(F.stddev_pop("physical_hydropower_0n")).first()[0]
    assert error("deep_forest_score") < 1.05 * mean


def test_forests_score_without_being_gathered(spark, monkeypatch):
    """The finished parts are as many as the rows let grow: no worker and no driver holds them all. Scores are those of the whole model."""
    x, y, w = made(300, 4)
    df = frame(spark, x, y, w)
    model = trees.fit_forest(df, ["a", "b", "c"], "y", {"n_estimators": 3, "min_samples_leaf": 2}, "w", 60)
    want = model.values(x) * w
    small = trees.Forest(model.columns, model.base, model.tops, model.parts)
    monkeypatch.setattr(trees, "LOCAL", 20)  # nodes of more rows are dealt to several tasks
    monkeypatch.setattr(trees.Forest, "whole", property(lambda self: pytest.fail("the whole model was gathered")))
    got = {r[:3]: r.p for r in small.predict(df, "w", "p").distinct().select("a", "b", "c", F.col("p") / F.col("w")).toDF("a", "b", "c", "p").collect()}
    assert len(got) == len({tuple(r) for r in x}) and all(got[tuple(r)] == pytest.approx(v / f) for r, v, f in zip(x.tolist(), want, w, strict=True))


def test_lags_are_written_before_models_read_them(spark):
    """Before, a fit and its scores read the lines and made the lags once for each of their jobs."""
    rows, _ = model_queries._lagged(spark, SF)
    assert all("/lagged-" in f for f in rows.inputFiles())
