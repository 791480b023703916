"""A multilayer perceptron trained by mini-batches in barrier tasks (MDL-4).

An epoch is one Spark job. Its tasks run at once, each reads its own rows as a stream, and after every mini-batch all of them
add up their gradients and take the same step, so a job has as many steps as there are batches and no rows are held. Tasks
find each other by the barrier's all-gather, once; the sums then go over sockets, as that call waits in whole seconds.
"""

from __future__ import annotations

import math
import secrets
import socket
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.models import SEED, Perceptron, perceptron_predict, rmse
from tidewheel.operators.staging import written
from tidewheel.operators.trees import uniform

Layers = list[tuple[np.ndarray, np.ndarray]]


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for pair in layers for p in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for pair in like:
        made = []
        for p in pair:
            made.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        out.append(tuple(made))
    return out


class Gathering:
    """Sums of arrays over the tasks of a barrier stage, in the order of tasks; the first task adds up. If a task is lost, the others'
    sockets close or time out and Spark runs the stage again."""

    def __init__(self, context: BarrierTaskContext, wait: float = 600.0):
        infos, self.rank = context.getTaskInfos(), context.partitionId()
        first = self.rank == 0
        server = socket.create_server(("", 0), backlog=len(infos)) if first else None
        word = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if first else "")[0]
        port, token = word.split()
        if first:
            server.settimeout(wait)
            self.peers: list[socket.socket] = [None] * (len(infos) - 1)  # type: ignore[list-item]
            while None in self.peers:
                peer, _ = server.accept()
                peer.settimeout(wait)
                told = self._read(peer, len(token) + 4)
                if secrets.compare_digest(told[:-4], token.encode()):
                    self.peers[int.from_bytes(told[-4:], "big") - 1] = peer
            server.close()
        else:
            self.peers = [socket.create_connection((infos[0].address.rpartition(":")[0] or infos[0].address, int(port)), wait)]
            self.peers[0].sendall(token.encode() + self.rank.to_bytes(4, "big"))

    @staticmethod
    def _read(peer: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            part = peer.recv(min(1 << 20, size - len(out)))
            if not part:
                raise ConnectionError("a task of this stage has gone")
            out += part
        return bytes(out)

    def sum(self, values: np.ndarray) -> np.ndarray:
        if self.rank:
            self.peers[0].sendall(values.tobytes())
            return np.frombuffer(self._read(self.peers[0], values.nbytes))
        total = values.copy()
        for peer in self.peers:
            total += np.frombuffer(self._read(peer, values.nbytes))
        for peer in self.peers:
            peer.sendall(total.tobytes())
        return total

    def close(self) -> None:
        for peer in self.peers:
            peer.close()


class Adam:
    """Steps on flat weights."""

    def __init__(self, size: int):
        self.first, self.second, self.count = np.zeros(size), np.zeros(size), 0

    def step(self, weights: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.count += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        return weights - rate * (self.first / (1 - 0.9**self.count)) / (np.sqrt(self.second / (1 - 0.999**self.count)) + 1e-8)


def masks_of(uid: np.ndarray, layers: Layers, epoch: int, dropout: float) -> list[np.ndarray]:
    """Which inner units each row drops in an epoch, as factors; the same wherever the row is."""
    if not dropout:
        return []
    units = lambda n: uid.astype(np.uint64)[:, None] * np.uint64(100_003) + np.arange(n, dtype=np.uint64)
    return [(uniform(units(w.shape[1]), epoch, k) >= dropout) / (1 - dropout) for k, (w, _) in enumerate(layers[:-1])]


def initial(n: int, hidden: Sequence[int], mean: float, seed: int = SEED) -> Layers:
    rng, sizes = np.random.default_rng(seed), [n, *hidden, 1]
    layers = [(rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    layers[-1] = (layers[-1][0] * 0.1, np.array([mean]))
    return layers


def fit_perceptron_batches(train: DataFrame, columns: Sequence[str], label: str, hidden: Sequence[int] = (32, 16), epochs: int = 25, batch: int = 64, rate: float = 0.001, l2: float = 1e-4, dropout: float = 0.0, activation: str = "relu", valid: DataFrame | None = None, patience: int = 10, tasks: int | None = None) -> Perceptron:
    """MDL-4 with mini-batches of `batch` rows, of which each task gives its share, Adam, dropout of inner units by row, and early
    stopping that goes back to the best weights. Rows with a missing value are left out; their order is new in each epoch.

    Needs as many free cores as tasks (by default, all that the session has at first) and no dynamic allocation.
    """
    n = len(columns)
    names = [f"x{i}" for i in range(n)]
    rows = written(train.select(*(F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)), F.col(label).cast("double").alias("y")).dropna(), "rows")
    stats = rows.agg(F.count("*"), F.avg("y"), *(f(x) for x in names for f in (F.avg, F.stddev_pop))).first()
    net = Perceptron(initial(n, hidden, stats[1] or 0.0), np.array([v or 0.0 for v in stats[2::2]]), np.array([v or 1.0 for v in stats[3::2]]), activation)
    if not stats[0] or not epochs:
        return net
    tasks = min(tasks or rows.sparkSession.sparkContext.defaultParallelism, max(1, batch))
    share = -(-batch // tasks)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("task", (F.col("uid") % tasks).cast("int")), "dealt").persist()
    adam, best, kept, wait = Adam(_flat(net.layers).size), math.inf, net, 0

    def epoch_of(net: Perceptron, adam: Adam, epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, like = BarrierTaskContext.get(), net.layers
            weights, parts, more, tasks_ = _flat(like), _parts(batches, share), True, Gathering(context)
            while more:
                part = next(parts, None)
                sums = np.zeros(weights.size + 1)
                if part is not None:
                    own = Perceptron(_shaped(weights, like), net.mean, net.scale, net.activation)
                    x = np.column_stack([part.column(c).to_numpy() for c in names])
                    gradients = own.gradients(x, part.column("y").to_numpy(), l2, masks_of(part.column("uid").to_numpy(), like, epoch, dropout))
                    sums[:-1], sums[-1] = _flat(gradients), len(x)
                sums = tasks_.sum(sums)
                more = sums[-1] > 0
                if more:
                    weights = adam.step(weights, sums[:-1] / sums[-1], rate)
            tasks_.close()
            if context.partitionId() == 0:  # all tasks have the same
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a in (weights, adam.first, adam.second)], pa.binary()), pa.array([adam.count] * 3, pa.int64())], names=["values", "count"])

        return run

    try:
        for epoch in range(epochs):
            order = F.xxhash64(F.lit(epoch), "uid")
            dealt = rows.repartitionById(tasks, F.col("task")).sortWithinPartitions(order, "uid")
            told = [(np.frombuffer(r.values), r["count"]) for r in dealt.mapInArrow(epoch_of(net, adam, epoch), "values binary, count bigint", barrier=True).collect()]
            (weights, adam.count), (adam.first, _), (adam.second, _) = told
            net = Perceptron(_shaped(weights, net.layers), net.mean, net.scale, activation)
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


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The stream in parts of so many rows; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held)
            whole = rows // size * size
            for at in range(0, whole, size):
                yield table.slice(at, size)
            held, rows = table.slice(whole).to_batches(), rows - whole
    if rows:
        yield pa.Table.from_batches(held)
