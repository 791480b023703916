"""Points in shapes (JN-19) by an adaptive quadtree cover.

A shape is any number of rings: parts, islands and holes, by the even-odd rule. Its cover has cells that no edge touches,
whose points need no test, and border cells with the few edges that touch them. A point meets one cell of a shape, so what
it costs doesn't depend on the length of the rings.

Whether a cell's reference point is inside is known from its parent's: the way between both lies within the parent, so
only the parent's edges can cross it. The cover is made in rounds, each of which cuts the cells of too many edges in
FAN x FAN; edges are rows that Spark groups by cell, so a ring of any length is no single task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidewheel.operators.staging import written

#: Cells along each side that a cell is cut into; edges that a border cell has at most, unless it is of the last level.
FAN, EDGES, LEVELS = 4, 32, 14
#: Where in a cell its reference point is: off all simple fractions, as borders and grids lie on these.
REF_X, REF_Y = 0.41421356237309503, 0.6180339887498949
#: Different latitudes of points up to which these are looked up along lines; the lines' crossings with edges, at most, for each
#: point and edge; points of a line that a task takes at once.
LINES, CROSSINGS, ROWS = 100_000, 32, 50_000
#: By how much of its size a cell reaches out for edges, against rounding.
REACH = 1e-9


def edges_of(shapes: DataFrame, id_col: str = "id", rings_col: str = "rings") -> DataFrame:
    """(id, ax, ay, bx, by) of all rings; a ring is closed whether its last point is its first or not. Rings with a missing
    or non-finite coordinate are refused."""
    ring = shapes.select(F.col(id_col).alias("id"), F.explode(rings_col).alias("ring")).where(F.size("ring") > 1)
    bad = F.exists("ring", lambda p: ~F.coalesce((F.abs(p["x"]) < 1e12) & (F.abs(p["y"]) < 1e12), F.lit(False)))
    ring = ring.where(F.assert_true(~bad, "a shape has a coordinate that is missing or not finite").isNull())
    n = F.size("ring")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", F.pmod(i, n) + 1).alias("b")))
    edge = ring.select("id", F.explode(pairs).alias("e")).select("id", *(F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    return edge.where("ax <> bx or ay <> by").toDF("id", "ax", "ay", "bx", "by")


def x_at(y: Column, e: Column) -> Column:
    return (e["bx"] - e["ax"]) * F.try_divide(y - e["ay"], e["by"] - e["ay"]) + e["ax"]


def crosses_right(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge: the definition of inside is an odd number of them. A point
    counts as just right of an edge that it lies on, and just above a level one."""
    return F.coalesce(((e["ay"] > y) != (e["by"] > y)) & (x < x_at(y, e)), F.lit(False))


def _across(x0: Column, x1: Column, y: Column, e: Column) -> Column:
    """Whether the way from (x0, y) to (x1, y) crosses an edge, as the difference of two rays."""
    return (crosses_right(x0, y, e) != crosses_right(x1, y, e)).cast("int")


def _along(x: Column, y0: Column, y1: Column, e: Column) -> Column:
    """Whether the way from (x, y0) to (x, y1) crosses an edge. x is off all corners; a point counts as above what it lies on."""
    y = (e["by"] - e["ay"]) * F.try_divide(x - e["ax"], e["bx"] - e["ax"]) + e["ay"]
    return F.coalesce(((e["ax"] > x) != (e["bx"] > x)) & ((y <= y0) != (y <= y1)), F.lit(False)).cast("int")


def _touches(e: dict[str, Column], left: Column, low: Column, size: Column) -> Column:
    """Whether an edge touches a square: the boxes meet and the square isn't all on one side of the edge's line."""
    half = size * (0.5 + REACH)
    cx, cy = left + size / 2, low + size / 2
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    boxes = (F.least(e["ax"], e["bx"]) <= cx + half) & (F.greatest(e["ax"], e["bx"]) >= cx - half) & (F.least(e["ay"], e["by"]) <= cy + half) & (F.greatest(e["ay"], e["by"]) >= cy - half)
    return boxes & (F.abs(dy * (e["ax"] - cx) - dx * (e["ay"] - cy)) <= (F.abs(dx) + F.abs(dy)) * half * (1 + REACH))


class Cover:
    """The cells of shapes: (id, level, ix, iy, inside, edges). A cell of level n is a square of side size / FAN**n; inside is
    that of its reference point; cells without edges are inside."""

    def __init__(self, cells: DataFrame, left: float, low: float, size: float, levels: list[int]):
        self.cells, self.left, self.low, self.size, self.levels = cells, left, low, size, levels

    def place(self, level: Column | int) -> Column:
        return F.lit(self.size) / F.pow(F.lit(float(FAN)), F.lit(level) if isinstance(level, int) else level)


def cover(shapes: DataFrame, id_col: str = "id", rings_col: str = "rings", most: int = EDGES) -> Cover:
    """The cover of shapes (id, rings as read_layer gives them). Ids must be unique; shapes without rings have no cells."""
    edges = written(edges_of(shapes, id_col, rings_col), "edges")
    box = edges.agg(*(f(g(f"a{c}", f"b{c}")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest)))).first()
    left, low = (box[0] or 0.0) // 1, (box[2] or 0.0) // 1
    size = 1.0
    while size <= max((box[1] or 0.0) - left, (box[3] or 0.0) - low):
        size *= 2
    made = Cover(edges, left, low, size, [])
    e = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    whole = lambda n: F.lit(n).cast("long")
    root = (F.lit(left + REF_X * size), F.lit(low + REF_Y * size))
    cells = edges.groupBy("id").agg((F.sum(crosses_right(*root, e).cast("int")) % 2 == 1).alias("inside")).select("id", whole(0).alias("ix"), whole(0).alias("iy"), "inside")
    live = edges.select("id", whole(0).alias("ix"), whole(0).alias("iy"), *e)
    leaves: list[DataFrame] = []
    edge_list = F.collect_list(F.struct(*e)).alias("edges")
    none = F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>").alias("edges")
    for level in range(LEVELS):
        side = size / FAN**level
        part = side / FAN
        x0, y0 = left + F.col("ix") * side, low + F.col("iy") * side
        rx, ry = x0 + REF_X * side, y0 + REF_Y * side
        ways = {}
        for j in range(FAN):
            y = y0 + (j + REF_Y) * part
            ways[f"v{j}"] = _along(rx, ry, y, e)
            for i in range(FAN):
                ways[f"h{j}_{i}"] = _across(rx, x0 + (i + REF_X) * part, y, e)
        counted = live.groupBy("id", "ix", "iy").agg(F.count("*").alias("n"), *(F.sum(w).alias(k) for k, w in ways.items()))
        state = written(counted.join(cells, ["id", "ix", "iy"]), "cells")
        last = level == LEVELS - 1
        few = state if last else state.where(F.col("n") <= most)
        border = live.join(few.select("id", "ix", "iy", "inside"), ["id", "ix", "iy"]).groupBy("id", "ix", "iy", "inside").agg(edge_list)
        leaves.append(border.select("id", F.lit(level).alias("level"), "ix", "iy", "inside", "edges"))
        many = state.where(F.col("n") > most)
        if last or many.isEmpty():
            break
        kids = F.array(*(F.struct(whole(j).alias("j"), whole(i).alias("i"), ((F.col("inside").cast("int") + F.col(f"v{j}") + F.col(f"h{j}_{i}")) % 2 == 1).alias("inside")) for j in range(FAN) for i in range(FAN)))
        kids = many.select("id", "ix", "iy", F.explode(kids).alias("k")).select("id", (F.col("ix") * FAN + F.col("k.i")).alias("ix"), (F.col("iy") * FAN + F.col("k.j")).alias("iy"), "k.inside")
        at = lambda value, origin, f: F.greatest(whole(0), F.least(whole(FAN - 1), F.floor((value - origin) / part + f)))
        span = lambda c, origin: F.explode(F.sequence(at(F.least(e[f"a{c}"], e[f"b{c}"]), origin, -REACH), at(F.greatest(e[f"a{c}"], e[f"b{c}"]), origin, REACH)))
        split = live.join(many.select("id", "ix", "iy"), ["id", "ix", "iy"], "left_semi").withColumn("i", span("x", x0)).withColumn("j", span("y", y0))
        split = split.where(_touches(e, x0 + F.col("i") * part, y0 + F.col("j") * part, F.lit(part)))
        live = written(split.select("id", (F.col("ix") * FAN + F.col("i")).alias("ix"), (F.col("iy") * FAN + F.col("j")).alias("iy"), *e), "edges")
        crossed = live.select("id", "ix", "iy").distinct()
        cells = written(kids.join(crossed.withColumn("crossed", F.lit(True)), ["id", "ix", "iy"], "left"), "kids")
        leaves.append(cells.where("crossed is null and inside").select("id", F.lit(level + 1).alias("level"), "ix", "iy", "inside", none))
        cells = cells.where("crossed").drop("crossed")
    made.cells = written(reduce(DataFrame.unionByName, leaves), "cover")
    made.levels = sorted(r.level for r in made.cells.select("level").distinct().collect())  # LEVELS at most
    return made


def members(points: DataFrame, covered: Cover, x: str = "lon", y: str = "lat") -> DataFrame:
    """points with id, a row for each shape that a point is inside of. Points with a missing or non-finite place are in none."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    sound = points.where((F.abs(px) < 1e12) & (F.abs(py) < 1e12))
    keys = [F.struct(F.lit(n).alias("level"), F.floor((px - covered.left) / covered.place(n)).alias("ix"), F.floor((py - covered.low) / covered.place(n)).alias("iy")) for n in covered.levels]
    if not keys:
        return points.where("false").join(covered.cells.select(F.col("id")), F.lit(True))
    keyed = sound.withColumn("_cell", F.explode(F.array(*keys)))
    side = covered.place(F.col("_level"))
    rx, ry = covered.left + (F.col("_ix") + REF_X) * side, covered.low + (F.col("_iy") + REF_Y) * side
    turns = F.aggregate("_edges", F.lit(0), lambda n, e: n + _along(rx, ry, py, e) + _across(rx, px, py, e))
    cells = covered.cells.toDF("id", "_level", "_ix", "_iy", "_inside", "_edges")
    met = keyed.join(cells, [F.col(f"_cell.{k}") == F.col(f"_{k}") for k in ("level", "ix", "iy")])
    return met.where((F.col("_inside").cast("int") + turns) % 2 == 1).select(*points.columns, "id")


def located(points: DataFrame, shapes: DataFrame, id_col: str = "id", rings_col: str = "rings", x: str = "lon", y: str = "lat") -> DataFrame:
    """points with id, a row for each shape that a point is inside of, as `members` over the `cover` gives them.

    Points of a grid share few latitudes. Each of these is a line; the edges' crossings with it are sorted by shape, and a point is
    inside a shape of which an odd number of crossings is to its right. The crossings are as many as edges times lines that one
    spans, so in proportion to the edges, while a cover of long edges that cross one another grows with their square. Where points
    have too many latitudes, or edges span too many lines, the cover is taken.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double") + F.lit(0.0)  # no negative zero
    sound = points.where((F.abs(px) < 1e12) & (F.abs(py) < 1e12))
    told = sound.groupBy(py.alias("y")).agg(F.count("*").alias("n")).limit(LINES + 1).collect()  # LINES at most
    edges = written(edges_of(shapes, id_col, rings_col), "edges")
    lines, salts = np.zeros(0), np.zeros(0, np.int64)
    if told:
        told = sorted((r.y, r.n) for r in told)
        lines, salts = np.array([t[0] for t in told]), -(-np.array([t[1] for t in told]) // ROWS)

    def spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The first line of each edge, and its number of lines: from the lower end, and below the upper one."""
        a, b = (batch.column(c).to_numpy() for c in ("ay", "by"))
        first = np.searchsorted(lines, np.minimum(a, b))
        return first, np.searchsorted(lines, np.maximum(a, b)) - first

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([int(spans(batch)[1].sum())])], names=["edges", "crossings"])

    sums = edges.select("ay", "by").mapInArrow(counted, "edges bigint, crossings bigint").agg(F.sum("edges"), F.sum("crossings")).first() if 0 < len(lines) <= LINES else (0, 0)
    if len(lines) > LINES or (sums[1] or 0) > CROSSINGS * ((sums[0] or 0) + sum(t[1] for t in told)):
        return members(points, cover(shapes, id_col, rings_col), x, y)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = spans(batch)[1]
            ends = np.cumsum(n)
            start = 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 200_000, side="right")))
                part, start = batch.slice(start, stop - start), stop
                first, many = spans(part)
                at = np.repeat(np.arange(len(many)), many)
                line = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                again = salts[line]
                salt = np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
                at, line = np.repeat(at, again), np.repeat(line, again)
                ax, ay, bx, by = (part.column(c).to_numpy()[at] for c in ("ax", "ay", "bx", "by"))
                across = (bx - ax) * ((lines[line] - ay) / (by - ay)) + ax
                yield pa.RecordBatch.from_arrays([pa.array(line.astype(np.int32)), pa.array(salt.astype(np.int32)), part.column("id").take(pa.array(at)), pa.array(across)], names=["_line", "_salt", "id", "across"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = np.searchsorted(lines, batch.column("_y").to_numpy())
            salt = np.arange(len(line)) % salts[line] if len(line) else line
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line.astype(np.int32)), pa.array(salt.astype(np.int32))], names=[*batch.schema.names, "_line", "_salt"])

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        value, across = left.column("_x").to_numpy(), right.column("across").to_numpy()
        ids = right.column("id").combine_chunks()
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((across, code))
        across, bounds = across[order], np.searchsorted(code[order], np.arange(len(ids.dictionary) + 1))
        found = [np.flatnonzero((b - a - np.searchsorted(across[a:b], value, side="right")) % 2 == 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        shape = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return left.select(columns).take(pa.array(rows)).append_column("id", ids.dictionary.take(pa.array(shape.astype(np.int64))))

    columns, place = points.columns, sound.withColumns({"_x": px, "_y": py})
    kept = place.mapInArrow(dealt, StructType([*place.schema.fields, StructField("_line", IntegerType()), StructField("_salt", IntegerType())]))
    of = edges.schema["id"]
    crossed = edges.mapInArrow(cut, StructType([StructField("_line", IntegerType()), StructField("_salt", IntegerType()), of, StructField("across", DoubleType())]))
    return kept.groupBy("_line", "_salt").cogroup(crossed.groupBy("_line", "_salt")).applyInArrow(inside, StructType([*points.schema.fields, of]))
