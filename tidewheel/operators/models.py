"""Regression models on Spark ML (MDL-1 to MDL-7, MLP-7) and a distributed multilayer perceptron.

Parameters are kept as JSON, fitted models by Spark ML's own writer; nothing is unpickled.
"""

from __future__ import annotations

import json
import math
import random
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 27


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """MLP-7; rows with a missing feature are dropped."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip").transform(df)


def ols(train: DataFrame, columns: Sequence[str], label: str, weight: str | None = None):
    """MDL-1: least squares by the normal equations."""
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal", **({"weightCol": weight} if weight else {}))
    return model.fit(assemble(train, columns))


def _depth(wanted: int) -> int:
    if wanted > 30:
        warnings.warn(f"trees end at depth 30, not {wanted}", stacklevel=3)
    return min(30, wanted)


def random_forest(train: DataFrame, columns: Sequence[str], label: str, params: Mapping | None = None, weight: str | None = None):
    """MDL-2: n_estimators, max_depth, min_samples_leaf and max_features of params. Spark's trees end at depth 30, of which a
    deeper wish warns; it has no least number of rows to split. `trees.fit_forest` has neither limit."""
    p = {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "max_features": "auto"} | dict(params or {})
    model = RandomForestRegressor(labelCol=label, numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]), minInstancesPerNode=p["min_samples_leaf"], featureSubsetStrategy=str(p["max_features"]), seed=SEED, **({"weightCol": weight} if weight else {}))
    return model.fit(assemble(train, columns))


def boosted_trees(train: DataFrame, columns: Sequence[str], label: str, params: Mapping | None = None, valid: DataFrame | None = None):
    """MDL-3: n_estimators, learning_rate, max_depth, subsample, min_child_weight (rows, as each has weight 1 under squared error)
    and colsample (a share of the features at each node) of params; stops early on the validation rows."""
    p = {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 5, "subsample": 1.0, "min_child_weight": 1, "colsample": 1.0} | dict(params or {})
    settings = {
        "labelCol": label, "maxIter": p["n_estimators"], "stepSize": p["learning_rate"], "maxDepth": _depth(p["max_depth"]), "subsamplingRate": p["subsample"], "seed": SEED,
        "minInstancesPerNode": p["min_child_weight"], "featureSubsetStrategy": "all" if p["colsample"] >= 1 else str(p["colsample"]),
    }
    if valid is not None:
        train = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)), allowMissingColumns=True)
        settings |= {"validationIndicatorCol": "_valid"}
    return GBTRegressor(**settings).fit(assemble(train, columns))


def predict(model, df: DataFrame, columns: Sequence[str], capacity: str | None = None, out: str = "prediction") -> DataFrame:
    """MDL-7: predictions, times capacity if one is given (PRJ-17)."""
    scored = model.transform(assemble(df, columns)).drop("features")
    value = F.col("prediction") * F.col(capacity) if capacity else F.col("prediction")
    return scored.withColumn(out, value)


def rmse(scored: DataFrame, label: str, prediction: str = "prediction") -> float:
    """MDL-6; infinite where there is no finite error."""
    value = RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName="rmse").evaluate(scored)
    return value if math.isfinite(value) else math.inf


FOREST_SPACE = {"n_estimators": (100, 1000), "max_depth": (10, 30), "min_samples_leaf": (1, 10), "max_features": (3, 20)}
BOOST_SPACE = {"n_estimators": (100, 4000), "learning_rate": (0.01, 0.3), "max_depth": (3, 10), "subsample": (0.5, 1.0), "min_child_weight": (1, 10), "colsample": (0.5, 1.0)}
PERCEPTRON_SPACE = {"depth": (1, 5), "width": (16, 256), "rate": (0.0001, 0.01), "l2": (1e-6, 1e-2), "dropout": (0.0, 0.5)}


def search(objective: Callable[[dict], float], space: Mapping[str, tuple], trials: int = 100, seed: int = SEED, startup: int = 10, candidates: int = 24) -> tuple[dict, float]:
    """MDL-5: tree-structured Parzen search that minimises the objective; NaN counts as infinite.

    One trial after another; `tuning.tune` has them side by side, halves them and goes on after a kill. After random trials each parameter is drawn near those of the better quarter and the candidate of the
    best density ratio is tried. Each trial is a distributed fit; the driver only keeps parameters and errors.
    """
    rng, seen = random.Random(seed), []

    def draw(low, high):
        return rng.randint(low, high) if isinstance(low, int) and isinstance(high, int) else rng.uniform(low, high)

    def density(x, points, width):
        return sum(math.exp(-0.5 * ((x - p) / width) ** 2) for p in points) / max(1, len(points)) + 1e-12

    for trial in range(trials):
        params = {}
        ranked = sorted(seen, key=lambda s: s[1])
        good, bad = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4) :]
        for name, (low, high) in space.items():
            if trial < startup or not bad:
                params[name] = draw(low, high)
                continue
            width = (high - low) / 5 or 1
            options = [min(high, max(low, rng.gauss(rng.choice(good)[0][name], width))) for _ in range(candidates)]
            options = [round(o) for o in options] if isinstance(low, int) else options
            params[name] = max(options, key=lambda x: density(x, [g[0][name] for g in good], width) / density(x, [b[0][name] for b in bad], width))
        value = objective(params)
        seen.append((params, value if math.isfinite(value) else math.inf))
    return min(seen, key=lambda s: s[1])


def save_params(params: Mapping, path: str) -> None:
    """SNK-8."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump(dict(params), file, indent=1, sort_keys=True)


def load_params(path: str) -> dict:
    """SRC-17."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@dataclass
class Perceptron:
    """MDL-4: weights of a multilayer perceptron for standardised inputs; its inner layers are relu, tanh or sigmoid."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    activation: str = "relu"

    def forward(self, x: np.ndarray, masks: Sequence[np.ndarray] = ()) -> list[np.ndarray]:
        """The input and each layer's output; masks multiply those of inner layers (dropout)."""
        active = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "sigmoid": lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))}[self.activation]
        out = [(x - self.mean) / self.scale]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else active(z) * masks[i] if len(masks) else active(z))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, l2: float, masks: Sequence[np.ndarray] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        slope = {"relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1 - a * a, "sigmoid": lambda a: a * (1 - a)}[self.activation]
        out = self.forward(x, masks)
        delta, grads = 2 * (out[-1] - y[:, None]), []
        for i in range(len(self.layers) - 1, -1, -1):
            w = self.layers[i][0]
            grads.append((out[i].T @ delta + l2 * len(x) * w, delta.sum(0)))
            if i:
                mask = masks[i - 1] if len(masks) else np.ones(w.shape[0])
                plain = np.divide(out[i], mask, out=np.zeros_like(out[i]), where=mask > 0)
                delta = (delta @ w.T) * mask * slope(plain)
        return grads[::-1]


def fit_perceptron(train: DataFrame, columns: Sequence[str], label: str, hidden: Sequence[int] = (32, 16), rounds: int = 30, rate: float = 0.01, l2: float = 1e-4, valid: DataFrame | None = None, patience: int = 5, activation: str = "relu", dropout: float = 0.0) -> Perceptron:
    """MDL-4 by synchronous gradient steps: each round every partition returns one gradient sum, and the sums of a weight are
    added by Spark, so the driver sees one number for each weight and no rows. Adam, dropout of inner units (one mask for
    each round and batch of a partition), and early stopping on the validation error."""
    rows = train.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(label).cast("double").alias("y")).dropna().persist()
    n = len(columns)
    stats = rows.agg(*(f(f"x{i}") for i in range(n) for f in (F.avg, F.stddev_pop)), F.avg("y")).first()
    rng = np.random.default_rng(SEED)
    sizes = [n, *hidden, 1]
    layers = [(rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    layers[-1] = (layers[-1][0] * 0.1, np.array([stats[-1] or 0.0]))
    net = Perceptron(layers, np.array([stats[2 * i] or 0.0 for i in range(n)]), np.array([stats[2 * i + 1] or 1.0 for i in range(n)]), activation)
    moments, best, kept, wait = [[np.zeros_like(p) for p in (w, b, w, b)] for w, b in layers], math.inf, net, 0
    names = [f"x{i}" for i in range(n)]

    def part(model: Perceptron, step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count, draw = None, 0, np.random.default_rng([SEED, step])
            for batch in batches:
                masks = [(draw.random(w.shape[1]) >= dropout) / (1 - dropout) for w, _ in model.layers[:-1]] if dropout else ()
                grads = model.gradients(batch[names].to_numpy(), batch["y"].to_numpy(), l2, masks)
                flat = np.concatenate([g.ravel() for pair in grads for g in pair])
                total, count = flat if total is None else total + flat, count + len(batch)
            if total is not None:
                yield pd.DataFrame({"n": [count], "g": [total.tolist()]})

        return run

    try:
        for step in range(1, rounds + 1):
            sums = rows.mapInPandas(part(net, step), "n long, g array<double>").select("n", F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
            told = sorted(sums.collect())  # a row for each weight
            if not told:
                break
            flat, at, new = np.array([r.g for r in told]) / told[0].n, 0, []
            for (w, b), m in zip(net.layers, moments, strict=True):
                made = []
                for k, p in enumerate((w, b)):
                    g = flat[at : at + p.size].reshape(p.shape)
                    at += p.size
                    m[k] = 0.9 * m[k] + 0.1 * g
                    m[k + 2] = 0.999 * m[k + 2] + 0.001 * g * g
                    made.append(p - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(m[k + 2] / (1 - 0.999**step)) + 1e-8))
                new.append(tuple(made))
            net = Perceptron(new, net.mean, net.scale, activation)
            if valid is None:
                kept = net
                continue
            error = rmse(perceptron_predict(net, valid, columns).withColumn(label, F.col(label).cast("double")), label)
            kept, best, wait = (net, error, 0) if error < best else (kept, best, wait + 1)
            if wait >= patience:
                break
    finally:
        rows.unpersist()
    return kept


def perceptron_predict(net: Perceptron, df: DataFrame, columns: Sequence[str], out: str = "prediction") -> DataFrame:
    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series(net.forward(np.column_stack([x.to_numpy(float) for x in xs]))[-1][:, 0])

    return df.withColumn(out, run(*(F.col(c).cast("double") for c in columns)))
