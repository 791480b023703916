"""Regression trees grown level by level in Spark: gradient boosting of the second order (MDL-3) and deep random forests (MDL-2).

Rows are written once as bytes: each feature's bin by weighted quantiles. A level is one aggregation: tasks add up
(count, gradient, Hessian) by node, feature and bin, Spark sums these, a window over the bins finds each node's best split,
and the driver gets a row for each node. Forests leave a node to one task when its rows are few: there the rest of the tree
is grown exactly, on raw values, with no limit of depth. Rows with a missing feature or label are left out.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.staging import written

SEED = 27
#: Bins of a feature, and the finer ones that their borders are chosen from.
BINS, FINE = 64, 1_024
#: Trees after which the rows' predictions are written anew; until then a task applies those since.
REFRESH = 32
#: Rows of a node, at most, that one task finishes; trees that are grown side by side.
LOCAL, TOGETHER = 50_000, 16


@dataclass
class Tree:
    """Nodes in the order of their making. A node with a feature sends rows with values up to the threshold left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, threshold: float, at: int) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.bin[node] = feature, threshold, at
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, new in ((self.feature, -1), (self.threshold, 0.0), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, self.value[node]), (self.depth, self.depth[node] + 1)):
                column.append(new)
        return self.left[node], self.right[node]

    def nodes_of(self, x: np.ndarray, by_bin: bool = False) -> np.ndarray:
        """The leaf of each row."""
        feature, left, right = (np.array(c) for c in (self.feature, self.left, self.right))
        limit = np.array(self.bin if by_bin else self.threshold)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= limit[at], left[at], right[at])
        return node

    def apply(self, x: np.ndarray, by_bin: bool = False) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(x, by_bin)]

    def graft(self, node: int, other: Tree) -> None:
        """Puts another tree in the place of a leaf."""
        self.value[node] = other.value[0]
        stack = [(node, 0)]
        while stack:
            here, there = stack.pop()
            if other.feature[there] >= 0:
                a, b = self.split(here, other.feature[there], other.threshold[there], -1)
                self.value[a], self.value[b] = other.value[other.left[there]], other.value[other.right[there]]
                stack += [(a, other.left[there]), (b, other.right[there])]


@dataclass
class Trees:
    """A sum (boosting) or mean (forest) of trees over columns in this order."""

    columns: list[str]
    base: float
    trees: list[Tree]
    mean: bool = False
    best_round: int | None = None
    errors: list[tuple[float, float]] = field(default_factory=list)

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += tree.apply(x) / (len(self.trees) if self.mean else 1)
        return total

    def predict(self, df: DataFrame, capacity: str | None = None, out: str = "prediction") -> DataFrame:
        """MDL-7: rows with a missing feature are left out; times capacity, if one is given."""

        @F.pandas_udf("double")
        def run(*xs: pd.Series) -> pd.Series:
            return pd.Series(self.values(np.column_stack([x.to_numpy(float) for x in xs])))

        value = run(*(F.col(c).cast("double") for c in self.columns))
        return df.dropna(subset=self.columns).withColumn(out, value * F.col(capacity) if capacity else value)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(asdict(self), file)

    @staticmethod
    def load(path: str) -> Trees:
        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        return Trees(**kept | {"trees": [Tree(**t) for t in kept["trees"]], "errors": [tuple(e) for e in kept["errors"]]})


class Forest:
    """A mean of trees that isn't held anywhere as a whole: the upper nodes, and a staged table of what tasks have grown below their
    leaves (tree, node; feature, threshold, left, right, value: lists by node), which is in proportion to the training rows."""

    mean, best_round, errors = True, None, ()

    def __init__(self, columns: list[str], base: float, tops: list[Tree], parts: DataFrame | None):
        self.columns, self.base, self.tops, self.parts = columns, base, tops, parts

    @cached_property
    def whole(self) -> Trees:
        """The model as one object, for models that fit the driver."""
        kept = Trees(self.columns, self.base, [Tree(**{k: list(v) for k, v in asdict(t).items()}) for t in self.tops], mean=True)
        for r in self.parts.collect() if self.parts is not None else []:
            kept.trees[r.tree].graft(r.node, Tree(r.feature, r.threshold, left=r.left, right=r.right, value=r.value))
        return kept

    @property
    def trees(self) -> list[Tree]:
        return self.whole.trees

    def __eq__(self, other: object) -> bool:
        return self.whole == (other.whole if isinstance(other, Forest) else other)

    __hash__ = None

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.whole.values(x)

    def save(self, path: str) -> None:
        self.whole.save(path)

    def predict(self, df: DataFrame, capacity: str | None = None, out: str = "prediction") -> DataFrame:
        """MDL-7: rows with a missing feature are left out; times capacity, if one is given. A row goes through the upper nodes where
        it is, and then meets, for each tree, the part that it falls into; nodes of many rows are dealt to several tasks."""
        if self.parts is None:
            return Trees(self.columns, self.base, [], mean=True).predict(df, capacity, out)
        tops, base = self.tops, self.base
        rows = written(df.dropna(subset=self.columns).withColumn("_row", F.monotonically_increasing_id()), "scored")
        names = [f"x{i}" for i in range(len(self.columns))]
        inputs = rows.select("_row", *(F.col(c).cast("double").alias(n) for c, n in zip(self.columns, names, strict=True)))

        def routed(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            x = np.column_stack([batch.column(n).to_numpy() for n in names])
            return x, [tree.nodes_of(x) for tree in tops]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(len(tree.feature), np.int64) for tree in tops]
            for batch in batches:
                if batch.num_rows:
                    for part, leaf in zip(sums, routed(batch)[1], strict=True):
                        part += np.bincount(leaf, minlength=len(part))
            t = np.repeat(np.arange(len(tops)), [len(s) for s in sums])
            node, n = np.concatenate([np.arange(len(s)) for s in sums]), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([pa.array(c[n > 0]) for c in (t, node, n)], names=["tree", "node", "n"])

        salts = [np.ones(len(tree.feature), np.int64) for tree in tops]
        for r in inputs.mapInArrow(counted, "tree bigint, node bigint, n bigint").groupBy("tree", "node").agg(F.sum("n").alias("n")).where(F.col("n") > LOCAL).collect():  # upper leaves
            salts[r.tree][r.node] = -(-r.n // LOCAL)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, leaves = routed(batch)
                held = pa.array([r.tobytes() for r in x], pa.binary())
                for t, leaf in enumerate(leaves):
                    salt = np.arange(len(leaf)) % salts[t][leaf]
                    arrays = [pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), batch.column("_row"), held]
                    yield pa.RecordBatch.from_arrays(arrays, names=["tree", "node", "salt", "_row", "x"])

        def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            t, node, _ = (k.as_py() for k in key)
            if not left.num_rows:
                value = np.zeros(0)
            elif right.num_rows:
                part = {c: right.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "threshold", "left", "right", "value")}
                value = Tree(**part).apply(_matrix(left.column("x"), np.float64))
            else:
                value = np.full(left.num_rows, tops[t].value[node])
            return pa.table({"_row": left.column("_row"), "tree": pa.array(np.full(len(value), t, np.int32)), "value": pa.array(value)})

        several = [(t, v, int(k)) for t, s in enumerate(salts) for v, k in enumerate(s.tolist()) if k > 1]
        parts = self.parts.withColumn("salts", F.lit(1))
        if several:
            many = df.sparkSession.createDataFrame(several, "tree int, node int, many int")
            parts = self.parts.join(F.broadcast(many), ["tree", "node"], "left").withColumn("salts", F.coalesce("many", F.lit(1))).drop("many")  # upper leaves
        parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        keys = ["tree", "node", "salt"]
        each = inputs.mapInArrow(dealt, "tree int, node int, salt int, _row bigint, x binary").groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(scored, "_row bigint, tree int, value double")
        in_order = F.array_sort(F.collect_list(F.struct("tree", "value")))
        total = F.aggregate(in_order, F.lit(base), lambda s, v: s + v["value"] / len(tops))
        value = F.col("_mean") * F.col(capacity) if capacity else F.col("_mean")
        return rows.join(each.groupBy("_row").agg(total.alias("_mean")), "_row").withColumn(out, value).drop("_row", "_mean")


def uniform(uid: np.ndarray, *numbers: int) -> np.ndarray:
    """A number in [0, 1) for each row, the same on every machine and attempt."""
    with np.errstate(over="ignore"):
        h = uid.astype(np.uint64)
        for n in (SEED, *numbers):
            h = (h ^ np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of as many numbers as each value's bytes hold, without a copy where the column is one chunk. There must be a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


class Table:
    """The training rows: (uid, y, w, valid, b[, x]), with bins b and values x as bytes, and the borders of the bins.

    A border is a value; bin k has the values above border k - 1 and up to border k. Borders cut the weight of the training rows
    evenly, as far as FINE quantiles of their values tell.
    """

    def __init__(self, train: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, valid: DataFrame | None = None, bins: int = BINS, raw: bool = False):
        self.columns = list(columns)
        names = [f"x{i}" for i in range(len(self.columns))]
        picked = lambda df, held: df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(self.columns, names, strict=True)), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.lit(held).alias("valid"))
        rows = picked(train, False) if valid is None else picked(train, False).unionByName(picked(valid, True))
        rows = written(rows.dropna().where("w > 0"), "rows")
        fine = self._quantiles(rows.where("not valid"), names)
        self.borders = self._weighted(rows.where("not valid"), names, fine, bins)
        borders = self.borders

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(n).to_numpy() for n in names]) if batch.num_rows else np.zeros((0, len(names)))
                b = np.column_stack([np.searchsorted(borders[k], x[:, k]) for k in range(x.shape[1])]).astype(np.uint8)
                arrays = [*(batch.column(n) for n in ("uid", "y", "w", "valid")), pa.array([r.tobytes() for r in b], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([r.tobytes() for r in x], pa.binary())] if raw else arrays, names=["uid", "y", "w", "valid", "b", "x"][: 6 if raw else 5])

        ddl = "uid bigint, y double, w double, valid boolean, b binary" + ", x binary" * raw
        self.rows = written(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, ddl), "binned")
        sums = self.rows.where("not valid").agg(F.count("*"), F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()
        self.count, self.mean = sums[0], sums[1] or 0.0

    @staticmethod
    def _quantiles(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
        shares = [k / FINE for k in range(1, FINE + 1)]
        told = rows.agg(*(F.percentile_approx(n, shares, FINE * 20).alias(n) for n in names)).first()  # FINE numbers for each feature
        return [np.unique(np.array(told[n] or [0.0], float)) for n in names]

    @staticmethod
    def _weighted(rows: DataFrame, names: list[str], fine: list[np.ndarray], bins: int) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(len(f) + 1) for f in fine]
            for batch in batches:
                w = batch.column("w").to_numpy()
                for k, n in enumerate(names):
                    sums[k] += np.bincount(np.searchsorted(fine[k], batch.column(n).to_numpy()), w, len(sums[k]))
            at = [(k, i, s) for k, part in enumerate(sums) for i, s in enumerate(part.tolist()) if s]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in at], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["k", "i", "s"])

        out = [np.zeros(len(f) + 1) for f in fine]
        for r in rows.mapInArrow(run, "k int, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("s")).collect():  # FINE numbers for each feature
            out[r.k][r.i] = r.s
        borders = []
        for values, weight in zip(fine, out, strict=True):
            shares = np.cumsum(weight[: len(values)]) / max(weight.sum(), 1e-300)
            chosen = np.unique(np.searchsorted(shares, np.arange(1, bins) / bins - 1e-12)) if len(values) > bins else np.arange(len(values) - 1)
            borders.append(values[chosen[chosen < len(values) - 1]])
        return borders


@dataclass
class Split:
    count: int
    g: float
    h: float
    feature: int | None = None
    at: int | None = None
    left: tuple[int, float, float] | None = None


def best_splits(sums: DataFrame, ridge: float, least_h: float, least_rows: int) -> DataFrame:
    """Of sums (tree, node, feature, bin, n, g, h) for each node the totals and the split of most gain, if any gains: the least
    feature, then bin, of equal ones."""
    keys = ["tree", "node", "feature"]
    total = sums.repartition(*keys).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cut = total.select(*keys, "bin", *(F.sum(c).over(w).alias(f"{c}{s}") for c in "ngh" for s, w in (("_l", upto), ("_t", whole))))
    score = lambda g, h: g * g / (h + ridge)
    g_r, h_r, n_r = F.col("g_t") - F.col("g_l"), F.col("h_t") - F.col("h_l"), F.col("n_t") - F.col("n_l")
    gain = score(F.col("g_l"), F.col("h_l")) + score(g_r, h_r) - score(F.col("g_t"), F.col("h_t"))
    fits = (n_r > 0) & (F.col("n_l") >= least_rows) & (n_r >= least_rows) & (F.col("h_l") >= least_h) & (h_r >= least_h)
    split = F.struct(F.when(fits, F.round(gain, 9)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n_l", "g_l", "h_l")
    best = F.max(F.when(fits & (gain > 1e-9), split)).alias("best")
    return cut.groupBy("tree", "node").agg(F.first("n_t").alias("n"), F.first("g_t").alias("g"), F.first("h_t").alias("h"), best)


def _level(rows: DataFrame, trees: list[Tree], active: list[tuple[int, int]], allowed: Mapping[tuple[int, int], list[int]], borders: list[np.ndarray], state: Callable, ridge: float, least_h: float, least_rows: int) -> dict[tuple[int, int], Split]:
    """One aggregation: the totals and best splits of the active (tree, node) pairs. state(batch, bins, t) gives, for tree t, the
    rows that take part (a mask) and the gradient and Hessian of all rows."""
    width, depth = max([len(b) + 1 for b in borders] + [1]), len(borders)
    slot = {key: k for k, key in enumerate(active)}
    mask = np.zeros((len(active), depth), bool)
    for key, features in allowed.items():
        mask[slot[key], features] = True
    numbers = sorted({t for t, _ in active})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(active) * depth * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("b"), np.uint8)
            for t in numbers:
                taken, g, h = state(batch, bins, t)
                of_node = np.full(len(trees[t].feature), -1)
                for (tree, node), k in slot.items():
                    if tree == t:
                        of_node[node] = k
                place = of_node[trees[t].nodes_of(bins, True)]
                kept = np.flatnonzero(taken & (place >= 0))
                flat = ((place[kept, None] * depth + np.arange(depth)) * width + bins[kept]).ravel()
                for part, weights in zip(sums, (None, g[kept], h[kept]), strict=True):
                    part += np.bincount(flat, None if weights is None else np.repeat(weights, depth), len(part))
        at = np.flatnonzero(sums[0])
        k, feature, number = at // (depth * width), at // width % depth, at % width
        keep = mask[k, feature]
        at, k, feature, number = at[keep], k[keep], feature[keep], number[keep]
        tree, node = (np.array([a[c] for a in active], np.int32)[k] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tree, node, feature.astype(np.int32), number.astype(np.int32), *(s[at] for s in sums))], names=["tree", "node", "feature", "bin", "n", "g", "h"])

    found = best_splits(rows.mapInArrow(run, "tree int, node int, feature int, bin int, n double, g double, h double"), ridge, least_h, least_rows)
    out = {}
    for r in found.collect():  # a row for each active node
        s = Split(int(r.n), r.g, r.h)
        if r.best is not None:
            s.feature, s.at, s.left = -r.best.f, -r.best.b, (int(r.best.n_l), r.best.g_l, r.best.h_l)
        out[r.tree, r.node] = s
    return out


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str, params: Mapping | None = None, valid: DataFrame | None = None, weight: str | None = None) -> Trees:
    """MDL-3: boosting for the squared error by gradients and Hessians.

    params: num_boost_round, learning_rate, max_depth, reg_lambda (ridge on leaf values), min_child_weight (Hessian of a child),
    subsample (rows by tree), colsample_bytree (columns by tree), early_stopping_rounds (with valid), max_bin. A split gains
    g^2 / (h + lambda) of its sides less that of the whole; a leaf is -rate * g / (h + lambda). A level is one Spark job and
    errors come with the next tree's first, so a tree of depth d takes d jobs.
    """
    p = {"num_boost_round": 100, "learning_rate": 0.1, "max_depth": 6, "reg_lambda": 1.0, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "early_stopping_rounds": 50, "max_bin": BINS} | dict(params or {})
    table = Table(train, columns, label, weight, valid, p["max_bin"])
    model = Trees(table.columns, table.mean, [])
    if not table.count:
        return model
    rows, recent = table.rows.withColumn("m", F.lit(table.mean)).persist(), []
    rng = np.random.default_rng(SEED)
    best, best_at = math.inf, 0
    try:
        for turn in range(p["num_boost_round"] + 1):
            errors = _errors(rows, recent) if valid is not None or turn == p["num_boost_round"] else None
            if errors:
                model.errors.append(errors)
                if valid is not None and errors[1] < best:
                    best, best_at = errors[1], turn
                if turn == p["num_boost_round"] or valid is not None and turn - best_at >= p["early_stopping_rounds"]:
                    break
            features = sorted(rng.permutation(len(table.columns))[: max(1, math.floor(p["colsample_bytree"] * len(table.columns)))].tolist())
            tree = _boosted_tree(rows, table.borders, recent, turn, features, p)
            model.trees.append(tree)
            recent.append(tree)
            if len(recent) == REFRESH:
                fresh = written(_with_margins(rows, recent), "margins").persist()
                rows.unpersist()
                rows, recent = fresh, []
    finally:
        rows.unpersist()
    model.best_round = best_at if valid is not None else len(model.trees)
    model.trees = model.trees[: model.best_round]
    return model


def _margins(batch: pa.RecordBatch, bins: np.ndarray, recent: list[Tree]) -> np.ndarray:
    m = batch.column("m").to_numpy().copy()
    for tree in recent:
        m += tree.apply(bins, True)
    return m


def _with_margins(rows: DataFrame, recent: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.set_column(batch.schema.get_field_index("m"), "m", pa.array(_margins(batch, _matrix(batch.column("b"), np.uint8), recent)))

    return rows.mapInArrow(run, rows.schema)


def _errors(rows: DataFrame, recent: list[Tree]) -> tuple[float, float]:
    """Root mean squared errors of training and validation."""
    at = _with_margins(rows, recent).groupBy("valid").agg((F.sum(F.col("w") * (F.col("m") - F.col("y")) ** 2) / F.sum("w")).alias("e"))
    told = {r.valid: math.sqrt(r.e) for r in at.collect()}
    return told.get(False, math.nan), told.get(True, math.nan)


def _boosted_tree(rows: DataFrame, borders: list[np.ndarray], recent: list[Tree], turn: int, features: list[int], p: Mapping) -> Tree:
    tree, ridge, rate = Tree(), p["reg_lambda"], p["learning_rate"]

    def state(batch: pa.RecordBatch, bins: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = batch.column("w").to_numpy()
        taken = ~batch.column("valid").to_numpy(zero_copy_only=False)
        if p["subsample"] < 1:
            taken = taken & (uniform(batch.column("uid").to_numpy(), turn) < p["subsample"])
        return taken, w * (_margins(batch, bins, recent) - batch.column("y").to_numpy()), w

    active = [0]
    for depth in range(p["max_depth"]):
        keys = [(0, n) for n in active]
        found = _level(rows, [tree], keys, dict.fromkeys(keys, features), borders, state, ridge, p["min_child_weight"], 1)
        active = []
        for (_, node), s in sorted(found.items()):
            if depth == 0:
                tree.value[0] = -rate * s.g / (s.h + ridge)
            if s.feature is None:
                continue
            left, right = tree.split(node, s.feature, float(borders[s.feature][s.at]), s.at)
            _, g, h = s.left
            tree.value[left], tree.value[right] = -rate * g / (h + ridge), -rate * (s.g - g) / (s.h - h + ridge)
            active += [left, right]
        if not active:
            break
    return tree


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def drawn(uid: np.ndarray, tree: int, bootstrap: bool) -> np.ndarray:
    """How often each row is in a tree's sample."""
    return np.searchsorted(_POISSON, uniform(uid, tree), side="right").astype(np.float64) if bootstrap else np.ones(len(uid))


def features_of(tree: int, path: str, n: int, most: int) -> list[int]:
    """The features that a node may split by; path is its way from the root, as l and r."""
    if most >= n:
        return list(range(n))
    return sorted(np.argsort(uniform(np.arange(n), tree, zlib.crc32(path.encode())))[:most].tolist())


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree_number: int, path: str, p: Mapping) -> Tree:
    """A whole tree of these rows by exact splits, all nodes of a level at once: one sort of each feature, then stable sorts by node."""
    tree, n, k = Tree(), len(y), x.shape[1]
    depth_left = p["max_depth"] - len(path)
    tree.value[0] = float((w * y).sum() / w.sum())
    sorted_by = [np.argsort(x[:, f], kind="stable") for f in range(k)]
    node = np.zeros(n, np.int64)
    active, paths = np.array([0]), {0: path}
    while depth_left > 0 and len(active):
        depth_left -= 1
        slot = np.full(len(tree.feature), -1)
        slot[active] = np.arange(len(active))
        here = slot[node]
        rows = np.bincount(here[here >= 0], minlength=len(active))
        best_gain, best_f, best_t = np.full(len(active), 1e-12), np.full(len(active), -1), np.zeros(len(active))
        open_ = np.zeros((len(active), k), bool)
        for a, v in enumerate(active.tolist()):
            if rows[a] >= max(2, p["min_samples_split"]):
                open_[a, features_of(tree_number, paths[v], k, p["max_features"])] = True
        for f in range(k):
            order = sorted_by[f]
            order = order[here[order] >= 0]
            order = order[open_[here[order], f]]
            order = order[np.argsort(here[order], kind="stable")]
            if len(order) < 2:
                continue
            at, v, ww = here[order], x[order, f], w[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.r_[first, len(at)])
            start = np.repeat(first, size)
            sw, sy = np.cumsum(ww), np.cumsum(ww * y[order])
            before_w, before_y = np.r_[0.0, sw][start], np.r_[0.0, sy][start]
            end = start + np.repeat(size, size) - 1
            wl, yl = sw - before_w, sy - before_y
            wt, yt = sw[end] - before_w, sy[end] - before_y
            left = np.arange(len(at)) - start + 1
            right = np.repeat(size, size) - left
            ok = np.flatnonzero((right >= p["min_samples_leaf"]) & (left >= p["min_samples_leaf"]) & (right > 0) & np.r_[v[1:] != v[:-1], False])
            if not len(ok):
                continue
            gain = yl[ok] ** 2 / wl[ok] + (yt - yl)[ok] ** 2 / (wt - wl)[ok] - yt[ok] ** 2 / wt[ok]
            lead = np.lexsort((ok, -np.round(gain, 9), at[ok]))
            lead = lead[np.r_[True, np.diff(at[ok][lead]) != 0]]
            a, g, i = at[ok][lead], gain[lead], ok[lead]
            better = g > best_gain[a] + 1e-9
            a, g, i = a[better], g[better], i[better]
            middle = (v[i] + v[i + 1]) / 2
            best_gain[a], best_f[a], best_t[a] = g, f, np.where(middle >= v[i + 1], v[i], middle)
        new = []
        for a in np.flatnonzero(best_f >= 0).tolist():
            v = int(active[a])
            left, right = tree.split(v, int(best_f[a]), float(best_t[a]), -1)
            paths[left], paths[right] = paths[v] + "l", paths[v] + "r"
            new += [left, right]
        moved = np.flatnonzero((here >= 0) & (best_f[here] >= 0))
        feature, threshold, lefts, rights = (np.array(c) for c in (tree.feature, tree.threshold, tree.left, tree.right))
        at = node[moved]
        node[moved] = np.where(x[moved, feature[at]] <= threshold[at], lefts[at], rights[at])
        sums_w, sums_y = (np.bincount(node[moved], s[moved], len(tree.feature)) for s in (w, w * y))
        for v in new:
            tree.value[v] = float(sums_y[v] / sums_w[v])
        active = np.array(new, np.int64)
    return tree


def fit_forest(train: DataFrame, columns: Sequence[str], label: str, params: Mapping | None = None, weight: str | None = None, local: int = LOCAL) -> Forest:
    """MDL-2: a forest of trees of any depth.

    params: n_estimators, max_depth, min_samples_leaf, min_samples_split, max_features, bootstrap. Minima count different rows.
    Nodes of more than `local` rows are split by bins in Spark; then the rows of each (tree, node) go to one task that grows the
    rest exactly. Trees are made TOGETHER at a time, so a row is shuffled so many times at once. What tasks grow stays in a table.
    """
    p = {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "min_samples_split": 2, "max_features": None, "bootstrap": True} | dict(params or {})
    table = Table(train, columns, label, weight, raw=True)
    n = len(table.columns)
    p["max_features"] = min(n, p["max_features"] or n)
    model = Forest(table.columns, 0.0 if table.count else table.mean, [], None)
    rows = table.rows.persist()
    try:
        for first in range(0, p["n_estimators"] if table.count else 0, TOGETHER):
            tops, parts = _trees(rows, table, first, min(TOGETHER, p["n_estimators"] - first), p, local)
            model.tops += tops
            model.parts = parts if model.parts is None else model.parts.union(parts)
    finally:
        rows.unpersist()
    return model


def _trees(rows: DataFrame, table: Table, first: int, many: int, p: Mapping, local: int) -> tuple[list[Tree], DataFrame]:
    """The upper nodes of so many trees, and the written table of what is below."""
    trees = [Tree(value=[table.mean]) for _ in range(many)]
    names = {(t, 0): "" for t in range(many)}
    n, bootstrap = len(table.columns), p["bootstrap"]

    def state(batch: pa.RecordBatch, bins: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = batch.column("w").to_numpy() * drawn(batch.column("uid").to_numpy(), first + t, bootstrap)
        return w > 0, -w * batch.column("y").to_numpy(), w

    large = list(names) if table.count > local else []
    shut: set[tuple[int, int]] = set()  # of more rows than a task takes, but at the end of depth or without a split by bins: they stay leaves
    while large:
        allowed = {key: features_of(first + key[0], names[key], n, p["max_features"]) for key in large}
        found, large_next = _level(rows, trees, large, allowed, table.borders, state, 0.0, 0.0, p["min_samples_leaf"]), []
        for (t, node), s in sorted(found.items()):
            trees[t].value[node] = -s.g / s.h
            if s.count <= local:
                continue
            if s.feature is None or s.count < p["min_samples_split"] or len(names[t, node]) >= p["max_depth"]:
                shut.add((t, node))
                continue
            left, right = trees[t].split(node, s.feature, float(table.borders[s.feature][s.at]), s.at)
            names[t, left], names[t, right] = names[t, node] + "l", names[t, node] + "r"
            nl, gl, hl = s.left
            trees[t].value[left], trees[t].value[right] = -gl / hl, -(s.g - gl) / (s.h - hl)
            large_next += [(t, v) for v, size in ((left, nl), (right, s.count - nl)) if size > local]
        large = large_next

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each tree's sample with their leaf so far."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, uid = _matrix(batch.column("x"), np.float64), batch.column("y").to_numpy(), batch.column("uid").to_numpy()
            for t, tree in enumerate(trees):
                w = batch.column("w").to_numpy() * drawn(uid, first + t, bootstrap)
                leaf = tree.nodes_of(x)
                kept = np.flatnonzero((w > 0) & ~np.isin(leaf, [v for k, v in shut if k == t]))
                columns = [pa.array(np.full(len(kept), t, np.int32)), pa.array(leaf[kept].astype(np.int32)), pa.array(uid[kept]), pa.array(y[kept]), pa.array(w[kept]), batch.column("x").take(pa.array(kept))]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "uid", "y", "w", "x"])

    def finished(key: tuple, part: pa.Table) -> pa.Table:
        t, node = (k.as_py() for k in key)
        part = part.sort_by("uid")
        own = grow(_matrix(part.column("x"), np.float64), part.column("y").to_numpy(), part.column("w").to_numpy(), first + t, names[t, node], p)
        lists = {k: pa.array([getattr(own, k)], pa.list_(kind)) for k, kind in (("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64()))}
        return pa.table({"tree": pa.array([first + t], pa.int32()), "node": pa.array([node], pa.int32())} | lists)

    parts = rows.mapInArrow(dealt, "tree int, node int, uid bigint, y double, w double, x binary")
    shape = "tree int, node int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"
    return trees, written(parts.groupBy("tree", "node").applyInArrow(finished, shape), "parts")
