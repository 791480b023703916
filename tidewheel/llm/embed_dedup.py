"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. Vectors are turned
by a fixed random rotation and cut into blocks of a few dimensions. If the squared distance of two
vectors is within the budget, that of at least one block is within the block's share of it, so the
union of range joins in the blocks finds every link. Each range join goes by the cells of a grid over
some of the block's dimensions: a point is at home in one cell and probes the cells around it.

1. Homes and probes meet in tiles, a cell or, of a cell with many points, one salted piece of the homes
   and one of the probes. Only coordinates of the block travel. What comes out are the points that have
   a candidate in the tile, not the pairs.
2. Those points are sent to their tiles with their vectors, once for each tile. A tile verifies its
   candidates by the cosine in double precision. A pair counts in the first block that finds it. Out come
   each point's count of links and a spanning forest.

So what is written grows with the points, though links are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import components, salt, sized, staged, whole_groups

#: Dimensions of a block; a cell's side as a multiple of the block's reach.
BLOCK, SIDE = 8, 2.0
#: Added to the budget, so that rounding to single precision loses no pair before the exact check.
SLACK = 1e-5
#: Homes, and probes from one cell, that meet in a tile; rows that a worker handles at once; pairs that it compares at once.
TILE, ROWS, PAIRS = 256, 50_000, 500_000
#: Rows of a shuffle partition.
PARTITION = 400_000


def rotation(dims: int, seed: int = 20240607) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    """(first, last) of each block; the last one may be smaller."""
    return [(a, min(dims, a + BLOCK)) for a in range(0, dims, BLOCK)]


def share_of(budget: float, dims: int, low: int, high: int) -> np.float32:
    """Squared distance that a block may have."""
    return np.float32(budget * (high - low) / dims)


def _hashed(cell: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed.copy()
    with np.errstate(over="ignore"):
        for d in range(cell.shape[1]):
            h = (h ^ cell[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def cells(points: np.ndarray, reach: float, seed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash of each point's own cell, and of all cells that its surroundings within reach touch."""
    side = SIDE * reach
    home = np.floor(points / side).astype(np.int64)
    wide = reach * (1 + 1e-5) + 1e-6  # for the rounding of distances
    low = np.floor((points - wide) / side).astype(np.int64)
    out = np.empty((len(points), 1 << points.shape[1]), np.uint64)
    there = np.empty(out.shape, bool)
    for k, step in enumerate(product((0, 1), repeat=points.shape[1])):
        cell = low + np.array(step)
        there[:, k] = (cell * side <= points + wide).all(1)
        out[:, k] = _hashed(cell, seed)
    return _hashed(home, seed), [row[ok] for row, ok in zip(out, there, strict=True)]


def _matrices(part: pa.RecordBatch | pa.Table, *columns: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each length of the list columns: the rows of that length, and their lists as matrices."""
    lists = [(c := part.column(n), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)[1] for n in columns]
    sizes = np.diff(lists[0].offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    flat = [x.flatten().to_numpy() for x in lists]
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        at = first[rows][:, None] + np.arange(dims)[None, :]
        yield rows, [f[at] for f in flat]


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with x: the unit vector after the rotation, in single precision."""
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        for rows, (v,) in _matrices(batch, "v"):
            v = v / np.abs(v).max(1, keepdims=True)
            dims = v.shape[1]
            if dims not in turns:
                turns[dims] = rotation(dims)
            x = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turns[dims]
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(x.astype(np.float32))], names=[*batch.schema.names, "x"])


def _placed(budget: float, grid: int) -> Callable:
    """A row for each point and block: block, share, the block's coordinates, the tile of the home, those of the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                for rows, (x,) in _matrices(part, "x"):
                    dims = x.shape[1]
                    label = part.column("la").to_numpy()[rows].view(np.uint64)
                    p = part.column("p").take(pa.array(rows))
                    for b, (low, high) in enumerate(blocks_of(dims)):
                        share = share_of(budget, dims, low, high)
                        seed = _hashed(np.full((len(rows), 1), dims << 20 | b), label)
                        home, probes = cells(x[:, low : min(high, low + grid)].astype(np.float64), float(np.sqrt(share)), seed)
                        padded = np.zeros((len(rows), BLOCK), np.float32)
                        padded[:, : high - low] = x[:, low:high]
                        ends = np.cumsum([0, *map(len, probes)]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [p, pa.array(np.full(len(rows), b, np.int32)), pa.array(np.full(len(rows), share)), _lists(padded), pa.array(home.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(probes).view(np.int64)))],
                            names=["p", "block", "share", "x", "home", "probes"],
                        )

    return run


def _meetings(tile: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home row, probe row) of all pairs within the tiles, up to about PAIRS at once."""
    order = np.lexsort((~home, tile))  # of each tile the homes come first
    tile, home = tile[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    number = np.cumsum(np.concatenate([[0], (tile[1:] != tile[:-1]).astype(np.int64)]))
    homes = np.bincount(number, home, len(first)).astype(np.int64)
    probes = np.flatnonzero(~home & (homes[number] > 0))
    many = homes[number[probes]]
    ends = np.cumsum(many)
    start = 0
    while start < len(probes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        n, q = many[start:stop], probes[start:stop]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield order[np.repeat(first[number[q]], n) + within], order[np.repeat(q, n)]
        start = stop


def _near(x: np.ndarray, a: np.ndarray, b: np.ndarray, columns: range, share: np.ndarray) -> np.ndarray:
    """Whether rows a and b are within the share in some columns; always summed in one order, so that each tile gets the same result."""
    total = np.zeros(len(a), np.float32)
    for k in columns:
        gap = x[a, k] - x[b, k]
        total += gap * gap
    return total <= share


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, block, p, home) of the points that have a candidate in a tile."""
    for table in whole_groups(batches, "tile", ROWS):
        tile, home, p, share = (table.column(n).to_numpy() for n in ("tile", "home", "p", "share"))
        ((_, (x,)),) = _matrices(table, "x")
        hit = np.zeros(len(tile), bool)
        for a, b in _meetings(tile, home):
            keep = p[a] < p[b]
            a, b = a[keep], b[keep]
            keep = _near(x, a, b, range(3), share[a])
            a, b = a[keep], b[keep]
            keep = _near(x, a, b, range(BLOCK), share[a])
            hit[a[keep]] = hit[b[keep]] = True
        yield table.select(["tile", "block", "p", "home"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else pa.RecordBatch.from_pylist([], schema=table.select(["tile", "block", "p", "home"]).schema)


def _verified(budget: float, least: float) -> Callable:
    """(p, near, other): each linked point of a part, its count of links that are counted here, and a point that it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile", ROWS):
            for rows, (x, v) in _matrices(table, "x", "v"):
                tile, home, p, n, la, lb, block = (table.column(c).to_numpy()[rows] for c in ("tile", "home", "p", "n", "la", "lb", "block"))
                points, at = np.unique(p, return_inverse=True)
                near, root = np.zeros(len(points), np.int64), np.arange(len(points))
                ranges = blocks_of(x.shape[1])
                shares = [share_of(budget, x.shape[1], *r) for r in ranges]
                long = np.sqrt((v * v).sum(1))
                for a, b in _meetings(tile, home):
                    keep = (p[a] < p[b]) & (la[a] == la[b]) & (lb[a] == lb[b])
                    a, b = a[keep], b[keep]
                    first = np.ones(len(a), bool)
                    for k in np.unique(block[a]).tolist():
                        here = np.flatnonzero(block[a] == k)
                        now = here[_near(x, a[here], b[here], range(*ranges[k]), shares[k])]
                        for j in range(k):  # a pair that an earlier block finds counts there
                            now = now[~_near(x, a[now], b[now], range(*ranges[j]), shares[j])]
                        first[np.setdiff1d(here, now, assume_unique=True)] = False
                    a, b = a[first], b[first]
                    sure = [np.zeros(0, np.int64)]
                    for s in range(0, len(a), 16_384):
                        c, d = a[s : s + 16_384], b[s : s + 16_384]
                        sure.append(s + np.flatnonzero(np.einsum("ij,ij->i", v[c], v[d]) / (long[c] * long[d]) >= least))
                    sure = np.concatenate(sure)
                    a, b = a[sure], b[sure]
                    near += np.bincount(at[a], n[b], len(points)).astype(np.int64) + np.bincount(at[b], n[a], len(points)).astype(np.int64)
                    root = joined(root, at[a], at[b])
                told = near > 0
                yield pa.RecordBatch.from_arrays([pa.array(points[told]), pa.array(near[told]), pa.array(points[root[told]])], names=["p", "near", "other"])

    return run


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component after links between a and b."""
    while True:
        one, two = root[a], root[b]
        if (one == two).all():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]


def similar_vectors(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept.

    Rows are compared only if their labels are equal and not null. n_links counts the other rows of
    cosine at least `least`, component_id is the smallest id that links reach, kept says whether it is
    the row's own. A vector that is null, empty or zero, or holds null or non-finite components, or has
    another length than its counterpart, has no links. Equal vectors are one point with a count.
    Repeated rows count as rows; a null id never names a component with another id; an empty table
    gives an empty result; further columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    v = table.select(table[id_col].alias("vec_id"), table[vector_col].cast("array<double>").alias("v"), table[label_col].alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    most = F.array_max(F.transform("v", F.abs))
    scaled = F.when(most.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / most))  # squares neither vanish nor overflow
    marked = v.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("v", F.when(F.col("ok"), scaled))
    key = F.when(F.col("ok"), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "v", "label").alias("b")))
    rows = staged(marked.select("vec_id", "label", "v", "ok", key.alias("k"), salt(F.col("vec_id")).alias("salt")), "vectors")
    part = rows.where("ok").groupBy("k", "salt").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    whole = part.groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.xxhash64(F.first("label")).alias("la"), F.xxhash64(F.lit(1), F.first("label")).alias("lb"), F.first("v").alias("v"), F.collect_list("salt").alias("salts"))
    kind = part.schema["low"].dataType.simpleString()
    shape = f"k struct<a: bigint, b: bigint>, n bigint, low {kind}, la bigint, lb bigint, v array<double>, salts array<int>, p bigint, x array<float>"
    points = staged(whole.withColumn("p", F.monotonically_increasing_id()).mapInArrow(_turned, shape), "points")
    links = staged(_links(points, least), "links")
    degree = links.groupBy("p").agg(F.sum("near").alias("near"))
    roots = components(links.select(F.col("p").alias("src"), F.col("other").alias("dst")))
    named = points.select("p", "k", "n", "low", "salts").join(degree, "p", "left").join(roots.withColumnRenamed("node", "p"), "p", "left").withColumn("root", F.coalesce("root", "p"))
    named = staged(named.select("p", "k", "low", "salts", "root", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lows, "root").select("k", "n_links", "component_id", F.explode("salts").alias("salt"))
    found = rows.join(classes, ["k", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(points: DataFrame, least: float) -> DataFrame:
    """(p, near, other) in pieces: rows of cosine at least `least` to a point, and points whose components are its own."""
    budget = 2 - 2 * least + SLACK
    told = points.groupBy("la").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).agg(F.max("n"), F.sum("n"), F.max("dims")).first()
    if not told[0]:
        return points.select("p", F.lit(0).cast("long").alias("near"), F.col("p").alias("other"))
    grid = min(BLOCK, max(1, round(np.log2(told[0]) / 4)))  # a finer grid has more probes for each point and fewer points for each probe
    partitions = max(1, -(-told[1] * len(blocks_of(told[2])) * (1 + (1 << grid)) // PARTITION))
    placed = points.select("p", "la", "x").mapInArrow(_placed(budget, grid), "p bigint, block int, share float, x array<float>, home bigint, probes array<bigint>")
    crowded = staged(placed.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("home", F.ceil(F.col("n") / TILE).cast("int").alias("own")), "crowded")
    base = ["block", "p", "share", "x"]
    if crowded.isEmpty():
        here = placed.select(*base, F.col("home").alias("tile"), F.lit(True).alias("home"))
        around = placed.select(*base, F.explode("probes").alias("tile"), F.lit(False).alias("home"))
    else:  # in a tile each piece of the homes meets each piece of the probes
        placed = placed.join(sized(crowded), "home", "left").withColumn("own", F.coalesce("own", F.lit(1)))
        pieces = placed.where("own > 1").select("own", F.explode("probes").alias("tile")).groupBy("tile").agg(F.max("own").alias("probers"))
        split = staged(crowded.select(F.col("home").alias("tile"), F.col("own").alias("homes")).join(pieces, "tile", "full").select("tile", F.coalesce("homes", F.lit(1)).alias("homes"), F.coalesce("probers", F.lit(1)).alias("probers")), "split")
        mine = lambda n: F.pmod(F.xxhash64("p"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        of = lambda rows: rows.join(sized(split), "tile", "left").withColumns({"homes": F.coalesce("homes", F.lit(1)), "probers": F.coalesce("probers", F.lit(1))})
        tile = F.when((F.col("homes") > 1) | (F.col("probers") > 1), F.xxhash64("tile", "i", "j")).otherwise(F.col("tile")).alias("tile")
        here = of(placed.select(*base, F.col("home").alias("tile"))).select("*", mine(F.col("homes")).alias("i"), each(F.col("probers")).alias("j")).select(*base, tile, F.lit(True).alias("home"))
        around = of(placed.select(*base, "own", F.explode("probes").alias("tile"))).select("*", each(F.col("homes")).alias("i"), mine(F.col("own")).alias("j")).select(*base, tile, F.lit(False).alias("home"))
    dealt = lambda rows, n: rows.repartition(n, "tile").sortWithinPartitions("tile")
    members = staged(dealt(here.unionByName(around), partitions).mapInArrow(_candidates, "tile bigint, block int, p bigint, home boolean"), "members")
    count = members.count()
    vectors = members.join(points.select("p", "n", "la", "lb", "v", "x"), "p")
    return dealt(vectors, max(1, -(-count // (PARTITION // 16)))).mapInArrow(_verified(budget, least), "p bigint, near bigint, other bigint")
