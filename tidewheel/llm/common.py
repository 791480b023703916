"""Helpers that the corpus operators share: staged tables, text batches, hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts per key. A key's rows meet in partial groups of (key, salt), so no task gets all rows of a hot key.
SALTS = 256
#: Text bytes that a Python worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Without that setting a local session (tests) has a
    temporary folder; on a cluster there is none, as each machine would write to its own disk."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{conf.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def mounted(path: str) -> str:
    """A file: location as a path that the driver and all workers open."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return path
    if scheme != "file":
        raise ValueError(f"memory-mapped files need a mounted shared folder in spark.checkpoint.dir, not {path}")
    return "/" + rest.lstrip("/")


#: Lists of the staged paths of the scratch blocks that are open.
_OPEN: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    noted(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(path: str) -> None:
    """The innermost scratch block deletes this path."""
    if _OPEN:
        _OPEN[-1].append(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was staged within it, but for paths that are taken off the list. Without such a
    block staged tables stay, as lazy results read them: delete the folder of shared_dir when all is written."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        delete(spark, made)


def salt(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns are left out, whatever their names."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` text bytes, whole texts only."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and each row's offsets, without a copy."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Rows that are sorted by a number, in parts of about `rows` that end where its value changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            value = table.column(column).to_numpy()
            cut = int(np.searchsorted(value, value[-1])) if value[0] != value[-1] else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't gaps; by default, blanks), and each text's number of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(max(0, len(offsets) - 1), np.int64)
    solid = ~gaps[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


#: Nodes of so many edges, or of so great a part of all, have their parents broadcast.
HUB_DEGREE, HUBS = 20_000, 5_000


def _parents(graph: DataFrame, end: str, name: str, step: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """graph with the parent of one end of each edge; the edges of a hub aren't shuffled to one task."""
    named = step.select(F.col("node").alias(end), F.col("parent").alias(name))
    if hubs is None:
        return graph.join(named, end)
    marked = graph.join(hubs.select(F.col("node").alias(end), F.col("parent").alias(name)), end, "left")
    return marked.where(F.col(name).isNotNull()).unionByName(marked.where(F.col(name).isNull()).drop(name).join(named, end))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (src, dst: long) as (node, root), for the nodes that have an edge.

    Contraction: in each round every node hooks to the neighbour of the smallest random rank
    (aggregated before the shuffle), edges are rewritten to the parents, and loops and repeats
    vanish, so the edge set shrinks by a constant factor. All state is in staged tables.
    """
    graph = staged(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    steps, turn = [], 0
    while (count := graph.count()) or not steps:
        rank = lambda c, t=turn: F.xxhash64(c, F.lit(t))
        both = graph.union(graph.select("dst", "src"))
        least = both.groupBy("src").agg(F.min(F.struct(rank(F.col("dst")).alias("rank"), F.col("dst").alias("node"))).alias("hook"), F.count("*").alias("degree"))
        parent = F.when(F.col("hook.rank") < rank(F.col("src")), F.col("hook.node")).otherwise(F.col("src"))
        step = staged(least.select(F.col("src").alias("node"), parent.alias("parent"), "degree"), "hooks")
        hubs = step.where(F.col("degree") >= max(HUB_DEGREE, count // HUBS))  # at most 2 * HUBS of them
        hubs = None if hubs.isEmpty() else F.broadcast(hubs)
        ends = _parents(_parents(graph, "src", "a", step, hubs), "dst", "b", step, hubs)
        graph = staged(ends.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        steps.append(step.drop("degree"))
        turn += 1
    labels = steps[0].withColumnRenamed("parent", "root")
    for step in steps[1:]:
        labels = labels.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return staged(labels, "labels")


#: Bytes that are broadcast at most.
BROADCAST_BYTES = 16 << 20


def sized(table: DataFrame, row_bytes: int = 96) -> DataFrame:
    """A staged table of rows of a known width, marked for broadcast if its size is within the limit."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def sized_semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join with a staged table of one key of up to 16 bytes: it is broadcast if its size is within the limit, else shuffled."""
    few = sized(keys, 32)
    return rows.join(few if few is not keys else keys.hint("shuffle_hash"), on, "left_semi")


def drop_keys(rows: DataFrame, keyed: dict[str, Column], decided: DataFrame) -> DataFrame:
    """rows without those whose keys (expressions by name) `decided` (the names, kept) never keeps; of several rows with kept keys, one stays.

    The keys that go are broadcast up to a checked number, so that texts aren't shuffled; beyond it
    both sides are. Missing keys are equal to one another.
    """
    keys = list(keyed)
    by = staged(decided.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "decided")
    gone = by.where("not kept").select(*keys)
    own = {k: next(n for n in (f"_key{i}" + "_" * j for j in range(len(rows.columns) + 1)) if n not in rows.columns) for i, k in enumerate(keys)}
    marked = rows.withColumns({own[k]: keyed[k] for k in keys})
    other = gone.select(*(F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys)))
    condition = [marked[own[k]].eqNullSafe(other[f"_gone{i}"]) for i, k in enumerate(keys)]
    left = marked.join(sized(other), condition, "left_anti")
    left = left if by.where("kept").isEmpty() else left.dropDuplicates(list(own.values()))
    return left.drop(*own.values())
