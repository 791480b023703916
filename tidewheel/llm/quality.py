"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over
each chunk and are max-pooled over its places. The chunks of a text are combined by the mean and the
maximum of each filter, and a logistic layer turns those into one probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import slices, staged, text_buffer, texts_of

#: Bound of the training sample: so many labelled rows of each class at most.
SAMPLE_ROWS = 5000
#: A labelled text of more characters gives the training so many pieces of so many characters, spread evenly
#: over all of it (it is scored whole like all others).
SAMPLE_CHARS, PIECES, PIECE_CHARS = 32_768, 16, 2_048
CHUNK, OVERLAP, FILTERS, WIDTH = 256, 32, 16, 6
#: Bytes that are scored at once.
STEP_BYTES = 1 << 20


@dataclass
class ByteConvNet:
    """filters: (WIDTH, 256, FILTERS), a weight for each place in the filter and byte value."""

    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mean, top, *_ = pooled(self, data, offsets)
        return 1 / (1 + np.exp(-np.clip(np.hstack([mean, top]) @ self.weights + self.bias, -40, 40)))


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each chunk, its text): a text has as many as cover it, an empty one has one of padding."""
    sizes, stride = np.diff(offsets), CHUNK - OVERLAP
    count = np.maximum(1, -(-np.maximum(sizes - OVERLAP, 0) // stride))
    owner = np.repeat(np.arange(len(sizes)), count)
    return offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * stride, owner


def window(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Bytes from each start; 0 from the text's end on."""
    at = start[:, None] + np.arange(width)[None, :]
    padded = np.append(data, np.uint8(0))
    return np.where(at < end[:, None], padded[np.minimum(at, len(data))], 0).astype(np.uint8)


def pooled(net: ByteConvNet, data: np.ndarray, offsets: np.ndarray, where: bool = False):
    """Mean and maximum over a text's chunks of each filter's maximum within the chunk; and what training needs besides."""
    start, owner = chunks(offsets)
    end, texts, places = offsets[1:][owner], len(offsets) - 1, CHUNK - WIDTH + 1
    best = np.empty((len(start), FILTERS), np.float32)
    at = np.empty((len(start), FILTERS), np.int64) if where else None
    for s in range(0, len(start), 512):
        a = start[s : s + 512]
        low, high = int(a[0]), int(min(len(data), a[-1] + CHUNK))
        part = window(data[low:high], a - low, end[s : s + 512] - low, CHUNK)
        out = net.filters[0][part[:, :places]]
        for k in range(1, WIDTH):
            out += net.filters[k][part[:, k : k + places]]
        short = np.flatnonzero(end[s : s + 512] - a < CHUNK)
        room = np.maximum(1, end[s : s + 512][short] - a[short] - WIDTH + 1)
        out[short] = np.where(np.arange(places)[None, :, None] < room[:, None, None], out[short], np.float32(-1e9))
        if where:
            at[s : s + 512] = out.argmax(1)
        best[s : s + 512] = out.max(1)
    active = np.maximum(best + net.shift, 0)
    first = np.searchsorted(owner, np.arange(texts))
    count = np.diff(np.append(first, len(owner)))
    top = np.maximum.reduceat(active, first, axis=0) if texts else active[:0]
    mean = np.add.reduceat(active, first, axis=0) / count[:, None] if texts else active[:0]
    return mean, top, active, at, count, start, owner, end


def gradients(net: ByteConvNet, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighted log loss, with a small ridge on the last layer: by filters, shift, weights and bias."""
    mean, top, active, at, count, start, owner, end = pooled(net, data, offsets, where=True)
    features = np.hstack([mean, top])
    p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -40, 40)))
    delta = (p - labels) * weights / weights.sum()
    d_features = delta[:, None] * net.weights[None, :]
    d_active = d_features[owner, :FILTERS] / count[owner][:, None] + d_features[owner, FILTERS:] * (active == top[owner])
    d_active *= active > 0
    d_filters = np.zeros_like(net.filters, np.float64)
    rows, cols = np.nonzero(d_active)
    hit = window(data, start[rows] + at[rows, cols], end[rows], WIDTH)
    for k in range(WIDTH):
        np.add.at(d_filters[k], (hit[:, k], cols), d_active[rows, cols])
    return d_filters, d_active.sum(0), features.T @ delta + 1e-4 * net.weights, np.array([delta.sum()])


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, least_steps: int = 400, batch: int = 48, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
    """Adam on the weighted log loss; weights restore the shares of the classes before balanced sampling."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    if not len(texts):
        return net
    state = [[np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)] for p in (net.filters, net.shift, net.weights, np.zeros(1))]
    step, epochs = 0, max(epochs, -(-least_steps * batch // len(texts)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            grads = gradients(net, data, offsets, labels[part], weights[part])
            lr = rate * (1 - epoch / epochs)
            for value, grad, moments, name in zip((net.filters, net.shift, net.weights, net.bias), grads, state, ("filters", "shift", "weights", "bias"), strict=True):
                moments[0] = 0.9 * moments[0] + 0.1 * grad
                moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
                move = lr * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, float(value - move[0]) if name == "bias" else (value - move).astype(value.dtype))
    return net


def spread_pieces(text: Column) -> Column:
    """A text of up to SAMPLE_CHARS characters as it is; of a longer one, PIECES pieces from its first to its last character."""
    n = F.length(text)
    piece = lambda i: F.substr(text, (i * (n - PIECE_CHARS) / (PIECES - 1)).cast("int") + 1, F.lit(PIECE_CHARS))
    return F.when(n <= SAMPLE_CHARS, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece), "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample (text, label) in one sorted partition, of the `rows` labelled ids of each class that are first by hash; and the labelled ids of each class.

    Rows with a null label or id are left out; of an id with several labels the largest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    there = texts_of(docs, id_col, text_col)
    ranked = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = staged(ranked(0).union(ranked(1)), "sample")
    sample = there.join(F.broadcast(chosen), "doc_id").withColumn("text", spread_pieces(F.col("text"))).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * rows).select("text", "label")
    return sample, totals


def trained(sample: DataFrame, totals: dict[int, int], train: Callable):
    """What `train` makes of the sample's texts, labels and class weights, in one task: the sample is bounded, and the driver sees only the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += [t.encode() for t in batch.column("text").to_pylist()]
            marks += batch.column("label").to_pylist()
        marks = np.array(marks, np.float64)
        share = {c: totals.get(c, 0) / max(1, (marks == c).sum()) for c in (0, 1)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, marks, np.array([share[c] for c in marks])))], pa.binary())], names=["model"])

    made = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([], np.zeros(0), np.zeros(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> ByteConvNet:
    return trained(*labelled_sample(docs, labels, label, **options), train)


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs, over its whole text; only the text is an input.

    A null text is the empty one and has the score of a chunk of padding; repeated rows are scored
    each; an empty table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                p = net.probability(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, net: ByteConvNet, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score below the threshold, all columns as they are.

    A null text is scored as the empty one and stays null if it is kept; repeated rows go or stay alike; null
    ids don't matter; an empty table gives an empty result.
    """
    names = docs.columns
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, limit=STEP_BYTES):
                column = part.column(text_col)
                p = net.probability(*text_buffer(column.fill_null("") if column.null_count else column))
                yield part.filter(pa.array(p >= threshold)).select(names)

    return docs.mapInArrow(run, kind)
