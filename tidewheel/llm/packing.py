"""Best-fit packing of token sequences with certified bin counts.

Documents are encoded once and cut into pieces. Pieces are dealt into partitions of bounded size, and
each is packed by best-fit decreasing. Dual feasible functions give a lower bound of a partition's
bins; where the packing reaches it, it is certified. A partition with a gap empties its worst bins and
some others and fills them anew, as long as that saves bins. The documents of partitions that still have
a gap, and of each partition's emptiest bin, are exchanged (dealt anew) and packed again, until the bound
of all pieces is reached or a round saves nothing. `certificate` tells bins and bound.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bpe import byte_characters
from tidewheel.llm.common import slices, staged, texts_of

#: Pieces in a partition; attempts of a partition with a gap in a row that save nothing before it is left so.
PARTITION, TRIES = 50_000, 24
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, whose ids rise with its merges' ranks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    alone = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not (plain and alone and split and spec["normalizer"] is None and model["type"] == "BPE" and merged == sorted(set(merged)) and -1 not in merged):
        raise ValueError(f"{path} isn't of the kind that is encoded here")
    byte = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of each row; only longer ones than the capacity are cut, the first takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        marks = set(coder.special_tokens_set)
        for batch in batches:
            for part in slices(batch):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = coder.encode(text, allowed_special=marks) if any(m in text for m in marks) else coder.encode_ordinary(text)
                    ids.append(end_id)
                    raw = np.array(ids, "<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int, count: np.ndarray | None = None) -> int:
    """Bins that any packing of the lengths (so many of each, if counts are given) needs: the best of the dual feasible functions f_lambda and u_k."""
    size, count = np.unique(lengths, return_counts=True) if count is None else (lengths, count)
    if not len(size):
        return 0
    cut = np.arange(0, capacity // 2 + 1)[:, None]
    f = np.where(size[None, :] > capacity - cut, capacity, np.where(size[None, :] >= cut, size[None, :], 0))
    best = -(-(f * count).sum(1) // capacity)
    k = np.arange(1, 65)[:, None]
    whole = size * (k + 1) % capacity == 0
    u = np.where(whole, size * k, size * (k + 1) // capacity * capacity)  # in units of 1 / k
    return int(max(best.max(), (-(-(u * count).sum(1) // (k[:, 0] * capacity))).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin. The open bins of a free space are a stack; a bit mask has the spaces in use."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[i])
        fits = mask >> w
        if fits:
            free = w + (fits & -fits).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += w
        if free > w:
            open_[free - w].append(b)
            mask |= 1 << (free - w)
    return bins, offsets, np.array(fill, np.int64)


def _filled(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Bins one by one: the first item left, and with it the sum of others that fills the bin best (subset sums as bits of one number)."""
    out, left = [], list(order)
    whole = (1 << (capacity + 1)) - 1
    while left:
        seed, rest = left[0], left[1:]
        room = capacity - lengths[seed]
        sums, steps = 1, []
        for i in rest:
            steps.append(sums)
            sums |= sums << lengths[i] & whole
            if sums >> room & 1:
                break
        best = (sums & ((1 << (room + 1)) - 1)).bit_length() - 1
        chosen = set()
        for k in range(len(steps) - 1, -1, -1):
            if not steps[k] >> best & 1:
                chosen.add(k)
                best -= lengths[rest[k]]
        out.append([seed, *(rest[k] for k in sorted(chosen))])
        left = [i for k, i in enumerate(rest) if k not in chosen]
    return out


def refilled(lengths: np.ndarray, capacity: int, bins: np.ndarray, bound: int, tries: int = TRIES, seed: int = 7) -> np.ndarray:
    """Bins with fewer of them, if emptying the worst ones and some others and filling them anew saves any."""
    rng, size = np.random.default_rng(seed), lengths.tolist()
    order = np.argsort(bins, kind="stable")
    groups = [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]
    lost = 0
    while len(groups) > bound and lost < tries:
        free = np.array([capacity - sum(size[i] for i in g) for g in groups])
        many = min(len(groups), 8 << lost % 6)
        worst = np.argsort(-free, kind="stable")[: max(2, many // 2)]
        others = rng.permutation(np.setdiff1d(np.arange(len(groups)), worst))[: many - len(worst)]
        taken = np.concatenate([worst, others]).tolist()
        if free.sum() < capacity:
            break
        items = [i for b in taken for i in groups[b]]
        items.sort(key=lambda i: -size[i])
        head = [i for i in items if 2 * size[i] > capacity]
        tail = [i for i in items if 2 * size[i] <= capacity]
        if lost % 2:  # small items in random order leave other sums open
            tail = [tail[k] for k in rng.permutation(len(tail))]
        new = _filled(size, head + tail, capacity)
        if len(new) < len(taken):
            lost = 0
        else:
            lost += 1
        if len(new) <= len(taken):
            gone = set(taken)
            groups = [g for b, g in enumerate(groups) if b not in gone] + new
    out = np.empty(len(lengths), np.int64)
    for b, g in enumerate(groups):
        out[g] = b
    return out


def _deal(rows: DataFrame, count: int) -> DataFrame:
    """Even partitions of a staged table; rows of equal content are dealt out like others."""
    return rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-count // PARTITION)))))


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """(bins, lower bound of any packing's bins) of a packing; the driver sees the counts of each length."""
    return packed.select("sequence_id").distinct().count(), _bound(packed, capacity)


def _bound(rows: DataFrame, capacity: int) -> int:
    counts = rows.groupBy("length").count().collect()  # at most `capacity` rows
    return lower_bound(np.array([r["length"] for r in counts], np.int64), capacity, np.array([r["count"] for r in counts], np.int64))


def pack(items: DataFrame, capacity: int, rounds: int | None = None) -> DataFrame:
    """items (with a column length, 1 to capacity) with sequence_id and offset added, in as few sequences as found.

    Sequences are gapless from 0; an empty table gives an empty result. rounds: of exchanges at most; by default, while they save any.
    """
    names = items.columns
    state = items.withColumns({"part": F.lit(0).cast("long"), "bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "open": F.lit(False)})

    def fit(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if len(fill) > bound:
            bins = refilled(lengths, capacity, bins, bound)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            fill = np.bincount(bins, lengths).astype(np.int64)
            offsets[order] = ends - lengths[order] - (np.cumsum(fill) - fill)[bins[order]]
        gap = len(fill) > bound
        table = table.select([*names, "part"])
        for name, values in (("bin", bins), ("offset", offsets), ("open", (bins == int(fill.argmin())) | gap)):
            table = table.append_column(name, pa.array(values))
        return table

    def run(rows: DataFrame, count: int) -> DataFrame:
        return staged(_deal(rows.select(*names), count).groupBy("part").applyInArrow(fit, state.schema), "packed")

    first = staged(items, "pieces")
    least, closed = _bound(first, capacity), 0
    done: list[DataFrame] = []
    now, turn = run(first, first.count()), 0
    while True:
        bins = now.select(F.countDistinct("part", "bin")).first()[0]
        again = now.where("open")
        told = again.agg(F.count("*").alias("rows"), F.countDistinct("part", "bin").alias("bins"), F.countDistinct("part").alias("parts")).first()
        if turn == rounds or told.parts < 2 or closed + bins <= least:
            break
        new = run(again, told.rows)
        if new.select(F.countDistinct("part", "bin")).first()[0] >= told.bins:
            break
        turn += 1
        closed += bins - told.bins
        done.append(now.where(~F.col("open")).withColumn("turn", F.lit(turn)))
        now = new
    done.append(now.withColumn("turn", F.lit(0)))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    number = F.shiftleft(F.col("turn").cast("long"), 52).bitwiseOR(F.shiftleft("part", 20)).bitwiseOR(F.col("bin"))  # a partition has at most PARTITION bins
    return whole.select(*names, number.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    A null or empty text has one piece, its end id; a string of a special token in a text is that
    token; repeated rows and rows with a null id are packed each; of pieces of equal length any order may
    come out; an empty table gives an empty result; further columns are ignored.
    """
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)
