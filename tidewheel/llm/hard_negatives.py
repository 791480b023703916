"""Hard-negative mining by bit-sliced integer products.

Vectors are floors of scaled components, scores their integer inner products. Anchors meet the rows in tiles,
one group of anchors and one of rows each, never in a join of pairs. Within a tile

1. the rows' components are cut into bit-planes, the sign plane first; a plane adds its weight times one 0/1 product;
2. what the planes to come can still add lies within an interval around half their sum, so each score has a lower and
   an upper bound that tighten by half with every plane;
3. a pair whose interval cannot qualify any more is dropped; when few are left, only these are carried on.

Out of a tile come an anchor's best few rows, exact; those of all tiles meet in a small shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import sized, staged

#: Rows and anchors of a tile. Rows pass through a tile in batches, so its memory is that of its anchors.
ROWS, ANCHORS = 1_000_000, 4_096
#: Groups that rows without a key are dealt to at least, so that small tables use all cores.
SPREAD = 32
#: Rows and anchors that are compared at once.
BATCH, LOT = 1_024, 512
#: From this share of pairs left on, the remaining planes are added pair by pair.
FEW = 1 / 16
LEAST, MOST = np.int64(-(2**63)), np.int64(2**63 - 1)


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, label, v): rows that take part, one for each id.

    Rows with a null id, label or vector, or a null, non-finite or so large component that a score could exceed a long, take
    no part. Of rows that share an id the one of the smallest label, then vector, does. Only rows of repeated ids are shuffled.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].alias("v"))
    # components stay within the limit, so scores, and their bounds while planes are added, within 2^62
    limit = (F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size("v"), F.lit(1)))) - 1) / scale
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) <= limit, F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(sound)
    twice = staged(rows.groupBy("id").count().where("count > 1").select("id"), "twice")
    if twice.isEmpty():
        return rows
    few = sized(twice, 16)
    one = rows.join(few, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("first")).select("id", "first.label", "first.v")
    return rows.join(few, "id", "left_anti").unionByName(one)


def tiled(rows: DataFrame, anchors: DataFrame, key: str | None, spread: int = 1, rows_each: int = ROWS, anchors_each: int = ANCHORS) -> DataFrame:
    """Rows (id, label, v) and anchors (id, label, v, bands) in tiles: every anchor meets every row of its key (or every row, without one) once.

    A key's rows are dealt to groups g by their id and its anchors to groups h; the tile (key, g, h) gets both. Only keys
    with more rows or anchors than one tile takes have several groups; there is one such key for `rows_each` rows at most.
    """
    tile = F.col(key) if key else F.lit(0).cast("long")
    count = lambda df, most: df.select(tile.alias("key")).groupBy("key").count().where(F.col("count") > (most if key else 0)).withColumn("n", F.ceil(F.col("count") / most).cast("int"))
    g = count(rows, rows_each).select("key", F.greatest(F.col("n"), F.lit(spread)).alias("groups"))
    h = count(anchors, anchors_each).select("key", F.col("n").alias("lots"))
    large = sized(staged(g.join(h, "key", "full").select("key", F.coalesce("groups", F.lit(1)).alias("groups"), F.coalesce("lots", F.lit(1)).alias("lots")), "groups"), 32)

    def placed(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        df = df.withColumn("key", tile).join(large, "key", "left").fillna(1, ["groups", "lots"])
        dealt = F.pmod(F.xxhash64("id"), F.col("groups" if kind else "lots")).cast("int")
        df = df.withColumn(own, dealt).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("lots" if kind else "groups") - 1)))
        return df.select("key", "g", "h", F.lit(kind).alias("kind"), "id", "label", "v", *(["bands"] if "bands" in df.columns else [F.lit(None).cast("array<bigint>").alias("bands")]))

    both = placed(anchors, 0, "h", "g").unionByName(placed(rows, 1, "g", "h"))
    return both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "g", "h").sortWithinPartitions("key", "g", "h", "kind", "id")


def _integers(lists: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: the rows of that length, and their components as whole numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield at, flat[first[at][:, None] + np.arange(dims)[None, :]]


class Planes:
    """The bit-planes of a batch of integer vectors, the sign plane first, and what is left below each."""

    def __init__(self, q: np.ndarray):
        self.bits = max(int(np.abs(q).max(initial=0)).bit_length(), 1) + 1
        self.q = q

    def weight(self, k: int) -> int:
        """Of plane k, counted from the lowest; the sign plane counts against the others."""
        return -(1 << k) if k == self.bits - 1 else 1 << k

    def plane(self, k: int) -> np.ndarray:
        return (self.q >> k & 1).astype(np.float64)

    def below(self, k: int) -> np.ndarray:
        """Of each vector the length of its part below plane k, measured from the middle of what that part can be."""
        rest = (self.q & ((1 << k) - 1)).astype(np.float64) - ((1 << k) - 1) / 2
        return np.sqrt((rest * rest).sum(1))


def survivors(anchors: np.ndarray, rows: np.ndarray, kept: np.ndarray, test: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that no test of their intervals has dropped, with exact scores.

    kept: pairs (anchors by rows) that are allowed at all. test(anchor, low, high) says which pairs may still qualify;
    it gets all pairs as matrices (anchor None) or the remaining ones as lists.
    """
    planes, a = Planes(rows), anchors.astype(np.float64)
    half = a.sum(1)  # times the middle of what is below
    length, widest = np.sqrt((a * a).sum(1)), np.abs(a).sum(1)
    total = np.zeros(kept.shape, np.int64)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(planes.bits - 1, -1, -1):
        plane, weight, middle = planes.plane(k), planes.weight(k), ((1 << k) - 1) / 2
        beneath = planes.below(k) if k else np.zeros(len(rows))
        if pairs is None:
            total += np.rint(a @ plane.T).astype(np.int64) * weight
            centre = total + (half * middle)[:, None]
            reach = np.minimum(length[:, None] * beneath[None, :], (widest * middle)[:, None]) * (1 + 1e-9) + 0.5 + np.abs(centre) * 1e-14
            kept &= test(None, centre - reach, centre + reach) if k else test(None, total, total)
            if k and np.count_nonzero(kept) <= FEW * kept.size:
                pairs = np.nonzero(kept)
                total = total[pairs]
        else:
            i, j = pairs
            total = total + np.rint(np.einsum("nd,nd->n", a[i], plane[j])).astype(np.int64) * weight
            centre = total + half[i] * middle
            reach = np.minimum(length[i] * beneath[j], widest[i] * middle) * (1 + 1e-9) + 0.5 + np.abs(centre) * 1e-14
            left = test(i, centre - reach, centre + reach) if k else test(i, total, total)
            pairs, total = (i[left], j[left]), total[left]
    if pairs is None:
        pairs = np.nonzero(kept)
        total = total[pairs]
    return pairs[0], pairs[1], total


class Best:
    """For each of n queries the first `most` (score, id) so far, higher scores and then smaller ids first."""

    def __init__(self, n: int, most: int):
        self.score = np.full((n, most), LEAST)
        self.id = np.full((n, most), MOST)
        self.most = most

    def least(self) -> np.ndarray:
        """The score that a newcomer must reach, which is any while there is room."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        if not len(touched):
            return
        old = np.repeat(touched, self.most)
        q, s, i = (np.concatenate(x) for x in ((old, query), (self.score[touched].ravel(), score), (self.id[touched].ravel(), ids)))
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.most
        self.score[q[top], place[top]], self.id[q[top], place[top]] = s[top], i[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.id != MOST)
        return query, self.score[query, place], self.id[query, place]


def _sure_least(low: np.ndarray, kept: np.ndarray, most: int) -> np.ndarray:
    """The `most`-th largest lower bound of each anchor's pairs: pairs whose upper bound is less are beaten by that many."""
    if low.shape[1] < most:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(kept, low, -np.inf), low.shape[1] - most, axis=1)[:, low.shape[1] - most]


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, bands: list, most: int):
        self.ids, self.labels, self.most, self.best = ids, labels, most, Best(len(ids), most)

    def meet(self, a: np.ndarray, q: np.ndarray, lot: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        allowed = (self.labels[lot][:, None] == labels[None, :]) & (self.ids[lot][:, None] != ids[None, :])
        if not allowed.any():
            return
        floor = self.best.least()[lot].astype(np.float64)

        def test(i, low, high):
            nonlocal floor
            if i is None:
                floor = np.maximum(floor, _sure_least(low, allowed, self.most))
                return high >= floor[:, None]
            return high >= floor[i]

        i, j, score = survivors(a[lot], q, allowed.copy(), test)
        self.best.add(lot[i], score, ids[j])

    def rows(self) -> tuple[np.ndarray, ...]:
        anchor, score, row = self.best.rows()
        return self.ids[anchor], np.zeros(len(anchor), np.int64), score, row


class Negatives:
    """For each positive of an anchor, the best rows of other labels whose score is within its band."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, bands: list, most: int):
        self.ids, self.labels, self.most = ids, labels, most
        self.owner = np.repeat(np.arange(len(ids)), [len(b) // 3 for b in bands])
        flat = np.array([x for b in bands for x in b], np.int64).reshape(-1, 3)
        self.positive, self.low, self.high = flat.T
        self.first = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        self.best = Best(len(flat), most)

    def meet(self, a: np.ndarray, q: np.ndarray, lot: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        allowed = self.labels[lot][:, None] != labels[None, :]
        low = np.maximum(self.low, self.best.least())  # what still counts, band by band
        lows, highs = np.full(len(lot), np.inf), np.full(len(lot), -np.inf)
        mine = [np.arange(self.first[x], self.first[x + 1]) for x in lot]
        bands = np.full((len(lot), max([1, *map(len, mine)])), -1)
        for n, own in enumerate(mine):
            own = own[low[own] <= self.high[own]]
            bands[n, : len(own)] = own
            if len(own):
                lows[n], highs[n] = low[own].min(), self.high[own].max()

        def test(i, low_, high_):
            if i is None:
                return (high_ >= lows[:, None]) & (low_ <= highs[:, None])
            out = np.zeros(len(i), bool)
            for column in bands.T:
                band = column[i]
                out |= (band >= 0) & (high_ >= low[band]) & (low_ <= self.high[band])
            return out

        i, j, score = survivors(a[lot], q, allowed, test)
        for column in bands.T:
            band = column[i]
            ok = (band >= 0) & (score >= low[band]) & (score <= self.high[band])
            self.best.add(band[ok], score[ok], ids[j[ok]])

    def rows(self) -> tuple[np.ndarray, ...]:
        band, score, row = self.best.rows()
        return self.ids[self.owner[band]], self.positive[band], score, row


def _mined(kind: type, most: int, scale: float) -> Callable:
    """Streams tiles: anchors come first, then their rows in batches; an anchor's best are given when the tile ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, targets = None, [], None

        def ready() -> list:
            table = pa.Table.from_batches(held)
            ids, labels, bands = table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("bands").to_pylist()
            return [(kind(ids[at], labels[at], [bands[x] or [] for x in at], most), a) for at, a in _integers(table.column("v"), scale)]

        def result() -> Iterator[pa.RecordBatch]:
            for target, _ in targets or []:
                anchor, positive, score, row = target.rows()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, positive, score, row)], names=["anchor", "positive", "score", "row"])

        for batch in batches:
            mark = np.stack([batch.column(n).to_numpy() for n in ("key", "g", "h", "kind")])
            cuts = np.flatnonzero(np.r_[True, (mark[:, 1:] != mark[:, :-1]).any(0)]).tolist() if batch.num_rows else []
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(s, e - s)
                if tile != (here := tuple(mark[:3, s].tolist())):
                    yield from result()
                    tile, held, targets = here, [], None
                if mark[3, s] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                targets = ready() if targets is None else targets
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                for at, q in _integers(part.column("v"), scale):
                    for target, a in targets:
                        if a.shape[1] != q.shape[1]:
                            continue
                        for x in range(0, len(at), BATCH):
                            for y in range(0, len(a), LOT):
                                target.meet(a, q[x : x + BATCH], np.arange(y, min(len(a), y + LOT)), ids[at[x : x + BATCH]], labels[at[x : x + BATCH]])
        yield from result()

    return run


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group by falling score and rising id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), rows_each: int = ROWS, anchors_each: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    A component x counts as floor(scale * x); a score is an integer inner product; higher scores come first, then smaller
    ids. An anchor's positives are its first `positives` other rows of its label, all if there are fewer. The negatives of a
    positive are the first `negatives` rows of other labels of which share[1] times the score is at least share[0] and at most
    share[1] times the positive's; a negative positive's score therefore has none.

    What takes no part and how repeated ids count: see `usable`. Vectors meet only those of their length. An empty table, or
    one without anchors, gives an empty result; further columns are ignored. Rows of one label, and anchors, are split into
    tiles beyond `rows_each` and `anchors_each`, so no task grows with a hot label.
    """
    rows = staged(usable(vectors, id_col, label_col, vector_col, scale), "vectors")
    anchors = rows.where(is_anchor(F.col("id")))
    schema = "anchor bigint, positive bigint, score bigint, row bigint"
    own = tiled(rows, anchors, "label", rows_each=rows_each, anchors_each=anchors_each).mapInArrow(_mined(Positives, positives, scale), schema)
    own = staged(_first(own, ["anchor"], positives).select(F.col("anchor").alias("id"), F.col("row").alias("positive"), F.col("score").alias("positive_score")), "positives")
    low, high = share
    floor = F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / high).cast("long")
    band = F.array("positive", floor, "positive_score")
    bands = own.groupBy("id").agg(F.flatten(F.collect_list(F.when(floor <= F.col("positive_score"), band))).alias("bands"))  # of at most `positives` rows
    found = tiled(rows, anchors.join(bands, "id"), None, SPREAD, rows_each, anchors_each).mapInArrow(_mined(Negatives, negatives, scale), schema)
    best = _first(found, ["anchor", "positive"], negatives).withColumnRenamed("anchor", "id").join(own, ["id", "positive"])
    return best.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
