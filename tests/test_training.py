"""Barrier training against one process, and the search for parameters: resumed, halved, and better than chance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trees import SF
from tidewheel.operators import models, panel, perceptron, tuning
from tidewheel.plans.catalog import QUERIES
from tidewheel.plans.registry import series


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_barrier_steps_are_those_of_one_process(spark, dropout):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(103, 3))
    y = x[:, 0] - 2 * x[:, 1] * x[:, 2]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double").coalesce(1)
    tasks, batch, epochs, rate, l2 = 3, 20, 3, 0.02, 0.01
    net = perceptron.fit_perceptron_batches(df, ["a", "b", "c"], "y", (5, 4), epochs, batch, rate, l2, dropout, "tanh", tasks=tasks)
    layers = perceptron.initial(3, (5, 4), float(y.mean()))
    flat, adam, uid = perceptron._flat(layers), perceptron.Adam(perceptron._flat(layers).size), np.arange(103)
    for epoch in range(epochs):
        mark = [r[0] for r in spark.range(103).orderBy("id").select(F.xxhash64(F.lit(epoch), "id")).collect()]
        dealt = [sorted((u for u in range(103) if u % tasks == t), key=lambda u: mark[u]) for t in range(tasks)]
        share = math.ceil(batch / tasks)
        for step in range(math.ceil(max(map(len, dealt)) / share)):
            rows = [u for part in dealt for u in part[step * share : (step + 1) * share]]
            own = models.Perceptron(perceptron._shaped(flat, layers), x.mean(0), x.std(0), "tanh")
            gradients = own.gradients(x[rows], y[rows], l2, perceptron.masks_of(uid[rows], layers, epoch, dropout))
            flat = adam.step(flat, perceptron._flat(gradients) / len(rows), rate)
    assert perceptron._flat(net.layers) == pytest.approx(flat, abs=1e-9)


def test_training_learns_and_goes_back_to_the_best(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = np.abs(x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    train, valid = df.where("a < 1"), df.where("a >= 1")
    net = perceptron.fit_perceptron_batches(train, ["a", "b"], "y", (16,), 6, 20, 0.02, 1e-5, valid=valid, patience=2, tasks=2)
    assert models.rmse(models.perceptron_predict(net, df, ["a", "b"]), "y") < 0.4 * float(y.std())
    assert perceptron.fit_perceptron_batches(df.where("false"), ["a", "b"], "y").layers[-1][1][0] == 0.0


class Killed(Exception):
    pass


SPACE = {"a": (0.0, 10.0), "b": ("log", 0.01, 100.0), "n": (1, 9), "k": ["x", "y", "z"]}


def error(p, share):
    return (p["a"] - 3) ** 2 + math.log(p["b"]) ** 2 + (p["n"] - 4) ** 2 / 4 + {"x": 0, "y": 2, "z": math.nan}[p["k"]] + (1 - share) * 0.1


def test_search_resumes_after_a_kill(spark, tmp_path):
    calls = []

    def objective(p, share, stop=None):
        if stop is not None and len(calls) >= stop:
            raise Killed
        calls.append((tuple(sorted(p.items())), share))
        return error(p, share)

    options = {"space": SPACE, "trials": 18, "bracket": 9, "side": 1}
    whole = tuning.tune(spark, objective, folder=str(tmp_path / "whole"), study="s", **options)
    assert whole.made == len(calls) == 2 * (9 + 3 + 1) and whole.cost == pytest.approx(2 * (1 + 1 + 1)) and whole.cost < 18
    first = list(calls)
    calls.clear()
    with pytest.raises(Killed):
        tuning.tune(spark, lambda p, s: objective(p, s, 11), folder=str(tmp_path / "cut"), study="s", **options)
    again = tuning.tune(spark, objective, folder=str(tmp_path / "cut"), study="s", **options)
    assert calls == first and again.made == 26 - 11 and (again.params, again.value) == (whole.params, whole.value)
    other = tuning.tune(spark, objective, folder=str(tmp_path / "cut"), study="other", **options)
    assert other.made == 26 and spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "cut")).count() == 52
    side = tuning.tune(spark, objective, folder=str(tmp_path / "side"), study="s", **options | {"side": 4})
    assert side.params == whole.params


def test_proposals_get_better_than_chance():
    rng, seen = random.Random(5), []
    for _ in range(80):
        p = tuning.propose(SPACE, seen, rng)
        assert 0 <= p["a"] <= 10 and 0.01 <= p["b"] <= 100 and p["n"] in range(1, 10) and p["k"] in "xyz"
        e = error(p, 1.0)
        seen.append((p, e if math.isfinite(e) else math.inf))
    late = sorted(e for _, e in seen[40:])[20]
    assert late < 0.5 * sorted(e for _, e in seen[:8])[4]


def test_queries(spark):
    later = panel.lag_features(series(spark, SF), "plant_id", "month", "value").dropna().where("month >= date'1999-01-01'").persist()
    spread = later.agg(F.stddev_pop("physical_hydropower_0n")).first()[0]
    for name in ("mlp_batches_score", "tuned_forest_score"):
        scored = QUERIES[name](spark, SF)
        assert models.rmse(scored.join(later, ["plant_id", "month"]), "physical_hydropower_0n") < 1.05 * spread and scored.count() == later.count()
