"""Best fuzzy matches by the token set ratio (JN-10, STR-5) without scoring all pairs and without a cap on either side.

Names and choices meet in tiles: a shard of the choices and a group of the names. A task holds its shard as an inverted
index of words, and its names stream past. A pair is scored only if an upper bound of its score reaches the best so far.
Of two texts of L and K characters, whose common words have c and whose characters have m in common as multisets,

- the ratios of the common words with either side are 2c / (c + L) and 2c / (c + K) at most,
- that of both sides is 2m / (L + K) at most, or, with l the longest common subsequence of what isn't common, 2(c + 1 + l) / (L + K).

Choices with a common word come from the index. The others lie in a tree of small blocks, of which a block's largest counts
of characters and least length bound all its members.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import token_set_score, words_of

#: Choices of a shard and names of a group; names of a group at least, so that small tables use all cores.
CHOICES, NAMES, LEAST_NAMES = 20_000, 20_000, 200
#: Choices of a block; pairs that are scored before finer bounds are made.
BLOCK, FIRST = 64, 8
#: Characters of a name whose common subsequences are bounded.
BITS = 64
CLASSES = 64


def _classes(text: str) -> list[int]:
    """Classes of characters; any classes give a bound, finer ones a better."""
    return [ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36 if c == " " else 37 + ord(c) % 27 for c in text]


def _percent(ratio: np.ndarray) -> np.ndarray:
    """No rounded percentage of a ratio that is at most this one is larger."""
    return np.floor(100 * ratio + 0.5 + 1e-9).astype(np.int64)


def _blocks(points: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in small blocks that are alike: halves by the column that varies most."""
    stack = [rows]
    while stack:
        part = stack.pop()
        if len(part) <= BLOCK:
            yield part
            continue
        column = points[part][:, points[part].var(0).argmax()]
        order = part[np.argsort(column, kind="stable")]
        stack += [order[: len(part) // 2], order[len(part) // 2 :]]


class Index:
    """A shard of choices."""

    def __init__(self, choices: list[str]):
        self.choices = sorted(set(choices))  # so that the later of two is the larger
        self.words = [words_of(c) for c in self.choices]
        texts = [" ".join(sorted(w)) for w in self.words]
        self.length = np.array([len(t) for t in texts])
        self.counts = np.zeros((len(texts), CLASSES), np.int32)
        for row, text in zip(self.counts, texts, strict=True):
            np.add.at(row, _classes(text), 1)
        holders: dict[str, list[int]] = defaultdict(list)
        for k, words in enumerate(self.words):
            for w in words:
                holders[w].append(k)
        self.holders = {w: np.array(k) for w, k in holders.items()}
        letters = sorted({c for t in texts for c in t})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.spelt = self._codes(texts)
        worded = np.flatnonzero(self.length)
        self.blocks = list(_blocks(np.column_stack([self.counts, self.length]), worded)) if len(worded) else []
        self.most = np.array([self.counts[b].max(0) for b in self.blocks]).reshape(-1, CLASSES)
        self.least = np.array([self.length[b].min() for b in self.blocks])

    def _codes(self, texts: list[str]) -> np.ndarray:
        """Characters as numbers, 0 past the end; texts are cut, which `_subsequence` allows for."""
        out = np.zeros((len(texts), min(2 * BITS, max(map(len, texts), default=0))), np.int32)
        for row, text in zip(out, texts, strict=True):
            codes = [self.letter.get(c, 0) for c in text[: len(row)]]
            row[: len(codes)] = codes
        return out

    def _subsequence(self, text: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Longest common subsequence of a text with each row, by bits; what was cut off a row counts in full."""
        masks = np.zeros(len(self.letter) + 1, np.uint64)
        for k, c in enumerate(text):
            if c in self.letter:
                masks[self.letter[c]] |= np.uint64(1 << k)
        v = np.full(len(codes), np.uint64(2**64 - 1))
        with np.errstate(over="ignore"):
            for column in codes[:, : int(min(codes.shape[1], lengths.max(initial=0)))].T:
                u = v & masks[column]
                v = (v + u) | (v - u)
        own = np.uint64((1 << len(text)) - 1)
        return np.minimum(np.bitwise_count(~v & own).astype(np.int64) + np.maximum(0, lengths - codes.shape[1]), len(text))

    def best(self, name: str) -> tuple[int, str, int]:
        """(score, choice, pairs scored): the best score, and the largest choice of those that have it."""
        words = words_of(name)
        score, at, scored = 0, len(self.choices) - 1, 0
        text = " ".join(sorted(words))
        size, counts = len(text), np.bincount(_classes(text), minlength=CLASSES)

        def reaches(rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
            return (bound > score) | (bound == score) & (rows > at)

        def take(rows: np.ndarray, bound: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
            """Scores rows by falling bound, `most` at most, and gives those that are left."""
            nonlocal score, at, scored
            order = np.lexsort((-rows, -bound))
            rows, bound = rows[order], bound[order]
            for k, (row, limit) in enumerate(zip(rows.tolist(), bound.tolist(), strict=True)):
                if limit < score:
                    return rows[:0], bound[:0]
                if k == most:
                    keep = reaches(rows[k:], bound[k:])
                    return rows[k:][keep], bound[k:][keep]
                if limit > score or row > at:
                    found, scored = token_set_score(name, self.choices[row]), scored + 1
                    if (found, row) > (score, at):
                        score, at = found, row
            return rows[:0], bound[:0]

        def alike(rows: np.ndarray) -> np.ndarray:
            return 2 * np.minimum(self.counts[rows], counts).sum(1) / (size + self.length[rows])

        held = [self.holders[w] for w in words if w in self.holders]
        shared = np.zeros(len(self.choices), np.int64)
        for w in words:
            if w in self.holders:
                shared[self.holders[w]] += len(w) + 1
        rows = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        if len(rows):
            common = shared[rows] - 1
            sides = _percent(2 * common / (common + np.minimum(size, self.length[rows])))
            rows, bound = take(rows, np.maximum(sides, _percent(alike(rows))), FIRST)
            if len(rows) and size <= BITS:
                rows, bound = self._finer(words, size, rows, bound, shared[rows] - 1)
            take(rows[keep := reaches(rows, bound)], bound[keep])
        if size and self.blocks:
            near = np.flatnonzero(_percent(2 * np.minimum(self.most, counts).sum(1) / (size + self.least)) >= score)
            rows = np.concatenate([self.blocks[b] for b in near]) if len(near) else rows[:0]
            rows = rows[shared[rows] == 0]
            bound = _percent(alike(rows))
            rows, bound = take(rows[keep := reaches(rows, bound)], bound[keep], FIRST)
            if len(rows) and size <= BITS:
                bound = np.minimum(bound, _percent(2 * self._subsequence(text, self.spelt[rows], self.length[rows]) / (size + self.length[rows])))
            take(rows[keep := reaches(rows, bound)], bound[keep])
        return score, self.choices[at], scored

    def _finer(self, words: frozenset[str], size: int, rows: np.ndarray, bound: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of rows with common words by the subsequences of the other words, for each set of common words."""
        groups: dict[frozenset[str], list[int]] = defaultdict(list)
        for k, row in enumerate(rows.tolist()):
            groups[words & self.words[row]].append(k)
        bound = bound.copy()
        for both, places in groups.items():
            k = np.array(places)
            rest = [" ".join(sorted(self.words[r] - both)) for r in rows[k].tolist()]
            left, c = " ".join(sorted(words - both)), int(common[k[0]])
            longest = self._subsequence(left, self._codes(rest), np.array([len(t) for t in rest])) if left else np.zeros(len(k), np.int64)
            whole = 2 * (c + 1 + longest) / (size + self.length[rows[k]])
            sides = 2 * c / (c + np.minimum(size, self.length[rows[k]]))
            bound[k] = np.minimum(bound[k], _percent(np.maximum(whole, sides)))
        return rows, bound


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile the choices come first, then names."""
    tile, held, index = None, [], None
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for row in batch.to_pylist():
            if tile != (row["shard"], row["group"]):
                tile, held, index = (row["shard"], row["group"]), [], None
            if not row["named"]:
                held.append(row["text"])
            elif held:
                index = index or Index(held)
                out.append((row["text"], *index.best(row["text"])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["name", "score", "choice", "scored"])


def best_matches(names: DataFrame, choices: DataFrame, shard: int = CHOICES, group: int = NAMES) -> DataFrame:
    """(name, match, score, scored) for each different name (column name): the choice (column choice) of the best token set
    ratio, the largest of equal ones, and how many pairs were scored for it.

    Missing names and choices are left out; without choices there are no rows; a text without words scores 0 with all. A choice
    travels once for each group of names and a name once for each shard of choices, so rows grow with pairs / 20,000.
    """
    names = names.select(F.col("name").alias("text")).where("text is not null").distinct()
    choices = choices.select(F.col("choice").alias("text")).where("text is not null").distinct()
    n, m = names.count(), choices.count()
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, groups = max(1, -(-m // shard)), max(1, -(-n // group), min(parts, n // LEAST_NAMES))
    dealt = lambda k: F.pmod(F.xxhash64("text"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = choices.select(dealt(shards).alias("shard"), each(groups).alias("group"), F.lit(False).alias("named"), "text")
    rows = rows.unionByName(names.select(each(shards).alias("shard"), dealt(groups).alias("group"), F.lit(True).alias("named"), "text"))
    tiles = rows.repartition(max(parts, min(shards * groups, 20_000)), "shard", "group").sortWithinPartitions("shard", "group", "named")
    found = tiles.mapInArrow(_tiles, "name string, score int, choice string, scored bigint")
    best = found.groupBy("name").agg(F.max(F.struct("score", "choice")).alias("best"), F.sum("scored").alias("scored"))
    return best.select("name", F.col("best.choice").alias("match"), F.col("best.score").alias("score"), "scored")
