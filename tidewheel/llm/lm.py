"""Interpolated modified Kneser-Ney language model of any order from 2 on: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score texts.

1. Words are counted by shards of their hash. A shard writes its words as a sorted table and numbers
   them by frequency, so frequent words have small numbers.
2. Each task turns its texts into numbers by the mapped tables, counts the n-grams of up to FLUSH_TOKENS
   at once and sends a packed blob to each shard that gets any. The shard of the longest n-grams follows
   from their inner words and from salts of the first and last one, so n-grams that share much meet,
   and no word, however frequent, has all of its n-grams in one shard.
3. Each shard sums its n-grams, writes them as a sorted table, and sends what it knows of the next
   shorter ones: of those that end an n-gram, the distinct words before them; of those that begin one,
   the totals of what follows. Shorter n-grams are dealt by a hash of the whole of them, words by number.

A blob is sent only if it isn't empty, so their number grows with the n-grams. A word is known by 64 bits
of its hash, an n-gram by 48 bits within its shard. The driver sees sums of a few numbers. Files are
written under another name and renamed, so a task that runs again replaces them whole.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import mounted, noted, shared_dir, slices, text_buffer, texts_of, word_spans

#: Text bytes for each shard of the model.
SHARD_BYTES = 16 << 20
#: Tokens that a counting task holds before it packs and sends them.
FLUSH_TOKENS = 2_000_000
#: Text bytes that are scored at once.
SCORE_BYTES = 4 << 20
#: Partitions of the shuffles at most; a partition holds several shards beyond that.
PARTITIONS = 50_000
#: Tables that a worker keeps mapped.
MAPPED = 15_000 if sys.version_info >= (3, 13) else 200
_U = np.uint64
_ODD, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
END = _U(0x5851F42D4C957F2D)
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(int(base), ())) < n:
        _POWERS[int(base)] = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 1 << 19) - 1, base, np.uint64)]), dtype=np.uint64)
    return _POWERS[int(base)][:n]


_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token (lower-cased word, then an end for each text) and the tokens of each text."""
    with np.errstate(over="ignore"):
        starts, ends, words = word_spans(data, offsets)
        n = len(words)
        at = np.arange(len(starts)) + np.repeat(np.arange(n), words)
        out = np.full(len(starts) + n, END, np.uint64)
        for s in range(0, len(starts), 1 << 15):  # the powers restart, so that long batches need no long tables
            a, b = starts[s : s + (1 << 15)], ends[s : s + (1 << 15)]
            piece = data[a[0] : b[-1]]
            sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[piece] * _powers(_ODD, len(piece)), dtype=np.uint64)])
            lead = a - a[0]
            out[at[s : s + (1 << 15)]] = _mix((sums[b - a[0]] - sums[lead]) * _powers(_INVERSE, len(piece))[lead] + (b - a).astype(np.uint64) * _STEP)
        return out, words + 1


def grams(numbers: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token its n-gram's words, first one first; before a text's start there are begin marks, number 0."""
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [numbers]
    for k in range(1, order):
        before = np.zeros_like(numbers)
        before[k:] = np.where(place[k:] >= k, numbers[:-k], 0)
        out.append(before)
    return out[::-1]


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    with np.errstate(over="ignore"):
        key = np.full(len(columns[0]), _U(len(columns)))
        for column in columns:
            key = _mix(key * _ODD + column.astype(np.uint64) + _STEP)
    return key


def _whole_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(key ^ _STEP) % _U(shards)).astype(np.int64)


def _top_shard(columns: list[np.ndarray], key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the longest n-grams; with a share of all n-grams for a word in the middle, an eighth of the shards at least get it."""
    if len(columns) < 3:
        return _whole_shard(key, shards)
    salts = _U(max(4, shards // 8))
    with np.errstate(over="ignore"):
        salted = gram_key(columns[1:-1]) + (_mix(columns[0].astype(np.uint64)) % salts) * _ODD + (_mix(columns[-1].astype(np.uint64) + _STEP) % salts) * _STEP
    return _whole_shard(salted, shards)


def _word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (word % _U(shards)).astype(np.int64)


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays, each with its type and length, compressed."""
    head = ";".join(f"{p.dtype.str},{len(p)}" for p in parts).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in (p.split(",") for p in raw[4:at].decode().split(";")):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """The number of bytes that the largest value has, and the values' bytes by place."""
    size = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return [np.array([size], "u1"), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.ravel()]


def _whole(size: np.ndarray, planes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(planes) // int(size[0]), 8), np.uint8)
    out[:, : int(size[0])] = planes.reshape(int(size[0]), -1).T
    return out.view("<i8").ravel()


Section = tuple[list[np.ndarray], list[np.ndarray]]


def encode(sections: list[Section]) -> bytes:
    """Pack sorted rows of n-grams, (columns of word numbers, fields) for each section; a number is sent as what it is above the row before, where all columns before are equal."""
    parts = []
    for columns, fields in sections:
        same = np.ones(len(columns[0]), bool)
        same[:1] = False
        for column in columns:
            gap = column.copy()
            gap[1:][same[1:]] -= column[:-1][same[1:]]
            parts += _planes(gap)
            same[1:] &= column[1:] == column[:-1]
        for f in fields:
            parts += [np.minimum(f, 255).astype(np.uint8), f[f >= 255].astype("<i8")]
    return _pack(np.array([len(sections), *(x for c, f in sections for x in (len(c), len(f)))], "<i4"), *parts)


def decode(blob: bytes) -> list[Section]:
    head, *rest = _unpack(blob)
    parts, out = iter(rest), []
    for k in range(int(head[0])):
        columns, fields, fresh = [], [], None
        for _ in range(head[1 + 2 * k]):
            gap = _whole(next(parts), next(parts))
            if fresh is None:
                fresh = np.zeros(len(gap), bool)
                fresh[:1] = True
            total = np.cumsum(gap)
            begins = np.flatnonzero(fresh)
            columns.append(total - np.repeat((total - gap)[begins], np.diff(np.append(begins, len(gap)))))
            fresh[1:] |= columns[-1][1:] != columns[-1][:-1]
        for _ in range(head[2 + 2 * k]):
            f, more = next(parts).astype(np.int64), next(parts)
            f[f == 255] = more
            fields.append(f)
        out.append((columns, fields))
    return out


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of small numbers: the first row of each distinct one, sorted by all columns; each row's number among them; the first row's number by all but the last column."""
    columns = [np.unique(c, return_inverse=True)[1] if len(c) and c.max() >> 31 else c for c in columns]
    key, prefix = columns[0], np.zeros(len(columns[0]), np.int64)
    for i, column in enumerate(columns[1:] or [np.zeros(len(key), np.int64)]):
        prefix = np.unique(key, return_inverse=True)[1] if i or len(columns) == 1 else key
        key = prefix << 32 | column
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse, prefix[first]


def _sums(inverse: np.ndarray, n: int, fields: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(inverse, f, n).astype(np.int64) for f in fields]


def _blobs(sections: list[Section], shard_of: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """A blob for each shard that gets a row of any section."""
    kind = np.uint16 if shards < 1 << 16 else np.int64
    orders = [np.argsort(s.astype(kind), kind="stable") for s in shard_of]
    ranked = [s[o] for s, o in zip(shard_of, orders, strict=True)]
    for k in np.unique(np.concatenate(ranked)).tolist():
        parts = []
        for (columns, fields), order, r in zip(sections, orders, ranked, strict=True):
            rows = order[np.searchsorted(r, k) : np.searchsorted(r, k, side="right")]
            parts.append(([c[rows] for c in columns], [f[rows] for f in fields]))
        yield k, encode(parts)


def _blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])


def _word_blobs(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    word, count = np.unique(hashes, return_counts=True)
    shard = _word_shard(word, shards)
    order = np.argsort(shard, kind="stable")
    word, count, shard = word[order], count[order], shard[order]
    for k in np.unique(shard).tolist():
        part = slice(np.searchsorted(shard, k), np.searchsorted(shard, k, side="right"))
        yield k, _pack(word[part], np.minimum(count[part], 255).astype("u1"), count[part][count[part] >= 255].astype("<i8"))


def _gram_blobs(columns: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """n-grams sorted by their inner words first, which are the most alike within a shard."""
    inner = [*columns[1:-1], columns[0], columns[-1]]
    first, inverse, _ = _distinct(inner)
    kept = [c[first] for c in columns]
    section = ([c[first] for c in inner], [np.bincount(inverse, minlength=len(first))])
    yield from _blobs([section], [_top_shard(kept, gram_key(kept), shards)], shards)


@dataclass(frozen=True)
class NgramModel:
    """Where the tables are, and for each length of n-grams the discounts by count class (1, 2, 3 or more).

    For words the classes are of the distinct words before them.
    """

    path: str
    shards: int
    order: int
    train_tokens: int
    vocabulary: int
    pairs: int
    discounts: tuple[tuple[float, float, float], ...]
    word_classes: tuple[int, int, int]


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in n)
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, most: min(max(d, 0.05), most - 0.05)  # noqa: E731  few texts can give values outside the range
    return bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3)


def _classes(count: np.ndarray) -> np.ndarray:
    return np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [(count >= 3).sum(), len(count), count.sum()], np.int64)


def write_table(path: str, keys: np.ndarray | None, fields: list[np.ndarray], wide: bool = False) -> None:
    """A table in one file. Sorted keys have an index by their top 16 bits and the rest (of 48 bits: four bytes; wide,
    of 64: the whole); without keys the rows are known by number. One byte for each row names one of the 255
    commonest combinations of its fields; the other rows are there in full."""
    n = len(fields[0])
    if keys is not None:
        order = np.argsort(keys)
        keys, fields = keys[order], [f[order] for f in fields]
        index = np.searchsorted(keys >> _U(48 if wide else 32), np.arange(65537, dtype=np.uint64)).astype("<u4")
        low = keys.astype("<u8") if wide else (keys & _U(0xFFFFFFFF)).astype("<u4")
    else:
        index, low = np.zeros(0, "<u4"), np.zeros(0, "<u4")
    small = np.ones(n, bool)
    mark = np.zeros(n, np.uint64)
    for i, f in enumerate(fields):
        small &= f < 256
        mark |= (f & 255).astype(np.uint64) << _U(8 * i)
    value, count = np.unique(mark[small], return_counts=True)
    value = np.sort(value[np.argsort(-count, kind="stable")[:255]])
    code = np.full(n, 255, np.uint8)
    if len(value):
        at = np.minimum(np.searchsorted(value, mark), len(value) - 1)
        there = small & (value[at] == mark)
        code[there] = at[there]
    rest = np.flatnonzero(code == 255)
    full = np.stack([f[rest] for f in fields], axis=1)
    full = full.astype("<u4") if not len(rest) or full.max() < 1 << 32 else full.astype("<i8")
    parts = [index, low, value.astype("<u8"), rest.astype("<u4"), full.ravel(), code]
    head = np.array([len(index), len(low), wide, len(value), len(rest), full.itemsize, n, len(fields)], "<u8")
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as file:
        for part in (head, *parts):
            file.write(part.tobytes())
            file.write(b"\0" * (-part.nbytes % 8))
    os.replace(temporary, path)


class Table:
    """A mapped table; where Python can, without a file descriptor that stays open."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            try:
                pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            except TypeError:
                pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        index, low, wide, codes, rest, size, n, self.fields = np.frombuffer(pages, "<u8", 8).tolist()
        self.shift, at, out = _U(48 if wide else 32), 64, []
        for kind, length in (("<u4", index), ("<u8" if wide else "<u4", low), ("<u8", codes), ("<u4", rest), ("<u4" if size == 4 else "<i8", rest * self.fields), ("u1", n)):
            out.append(np.frombuffer(pages, kind, length, at))
            at += -(-out[-1].nbytes // 8) * 8
        self.index, self.low, value, self.rest, full, self.code = out
        self.full = full.reshape(-1, self.fields)
        self.value = np.zeros((256, self.fields), np.int64)
        for i in range(self.fields):
            self.value[: len(value), i] = value >> _U(8 * i) & _U(255)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in keys of those that are there, their rows)."""
        if not len(self.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bucket, want = (keys >> self.shift).astype(np.int64), keys.astype(self.low.dtype)
        low, high = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        end = high
        for _ in range(int((high - low).max()).bit_length()):  # a binary search of all keys at once
            middle = (low + high) >> 1
            less = (self.low[np.minimum(middle, len(self.low) - 1)] < want) & (middle < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, len(self.low) - 1)
        hit = np.flatnonzero((low < end) & (self.low[at] == want))
        return hit, at[hit]

    def at(self, rows: np.ndarray) -> np.ndarray:
        """The fields of rows by number, zeros beyond the last."""
        if not len(self.code):
            return np.zeros((len(rows), self.fields), np.int64)
        code = self.code[np.minimum(rows, len(self.code) - 1)]
        found = self.value[code]
        long = np.flatnonzero(code == 255)
        if len(long):
            found[long] = self.full[np.minimum(np.searchsorted(self.rest, rows[long]), len(self.rest) - 1)]
        found[rows >= len(self.code)] = 0
        return found

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The fields of each key, zeros where it is absent."""
        out = np.zeros((len(keys), self.fields), np.int64)
        hit, rows = self.find(keys)
        out[hit] = self.at(rows)
        return out


def _rows(out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_blob_batch(out)])


def _gather(blobs: list[bytes]) -> list[Section]:
    """The sections of several blobs as one."""
    decoded = [decode(b) for b in blobs]
    join = lambda k, side: [np.concatenate(parts) for parts in zip(*(d[k][side] for d in decoded), strict=True)]
    return [(join(k, 0), join(k, 1)) for k in range(len(decoded[0]))]


def _shorter(ids: list[np.ndarray], count: np.ndarray, prefix: np.ndarray) -> list[Section]:
    """From distinct n-grams with sorted prefixes: their endings with the number of words before, their beginnings with totals and classes."""
    ends = [c for c in ids[1:]]
    first, inverse, _ = _distinct(ends)
    before = np.bincount(inverse, minlength=len(first))
    lead = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    sums = [np.add.reduceat(x.astype(np.int64), lead) for x in (count, count == 1, count == 2, count > 2)]
    return [([c[first] for c in ends], [before]), ([c[lead] for c in ids[:-1]], sums)]


def fit(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> NgramModel:
    """Count all texts of docs. A null text is the empty one, which has only an end token."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    source = texts_of(docs, id_col, text_col).select("text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    path = mounted(folder)
    os.makedirs(path)
    noted(folder)

    def held(batches: Iterator[pa.RecordBatch], read: Callable, pack: Callable) -> Iterator[pa.RecordBatch]:
        """Columns of tokens as `read` gives them for a slice, packed FLUSH_TOKENS at once."""
        parts, n = [], 0
        for batch in batches:
            for part in slices(batch):
                columns = read(*tokens(*text_buffer(part.column("text"))))
                for s in range(0, len(columns[0]), FLUSH_TOKENS):
                    parts.append([c[s : s + FLUSH_TOKENS] for c in columns])
                    n += len(parts[-1][0])
                    if n >= FLUSH_TOKENS:
                        yield _blob_batch(list(pack([np.concatenate(c) for c in zip(*parts, strict=True)])))
                        parts, n = [], 0
        if n:
            yield _blob_batch(list(pack([np.concatenate(c) for c in zip(*parts, strict=True)])))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return held(batches, lambda h, n: [h], lambda columns: _word_blobs(columns[0], shards))

    def sum_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, counts = [], []
        for word, count, more in (_unpack(b.as_py()) for b in table.column("blob")):
            count = count.astype(np.int64)
            count[count == 255] = more
            words.append(word)
            counts.append(count)
        word, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        key = _mix(word)
        order_ = np.argsort(key)
        rank = np.empty(len(word), "<u4")
        rank[np.argsort(-total[order_], kind="stable")] = np.arange(1, len(word) + 1)
        write_table(f"{path}/words-{shard}", key, [total], wide=True)
        temporary = f"{path}/ranks-{shard}.{uuid.uuid4().hex}"
        rank.tofile(temporary)
        os.replace(temporary, f"{path}/ranks-{shard}")
        return pa.table({"tokens": pa.array([int(total.sum())]), "words": pa.array([len(word)], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path, shards, order)
        return held(batches, lambda h, n: grams(reader.words(h)[1], n, order), lambda columns: _gram_blobs(columns, shards))

    def told(level: int, figures: np.ndarray, shard: int) -> tuple[int, bytes]:
        return -1 - shard % 64, _pack(np.array([level], "<i8"), figures)

    def summed(level: int):
        def run(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            blobs = [b.as_py() for b in table.column("blob")]
            if shard < 0:
                sums: dict[int, np.ndarray] = {}
                for at, figures in map(_unpack, blobs):
                    sums[int(at[0])] = sums.get(int(at[0]), 0) + figures
                return _rows([told(k, v, -1 - shard) for k, v in sums.items()])
            sections = _gather(blobs)
            ids, fields = sections[0]
            if level == order:
                ids = [ids[-2], *ids[:-2], ids[-1]]
            else:  # what begins longer n-grams may not end any, and the other way round
                other, stats = sections[1]
                n, m = len(ids[0]), len(other[0])
                ids = [np.concatenate(p) for p in zip(ids, other, strict=True)]
                fields = [np.concatenate([fields[0], np.zeros(m, np.int64)]), *(np.concatenate([np.zeros(n, np.int64), f]) for f in stats)]
            first, inverse, prefix = _distinct(ids)
            ids, fields = [c[first] for c in ids], _sums(inverse, len(first), fields)
            write_table(f"{path}/{level}-{shard}", gram_key(ids) >> _U(16), fields)
            seen = fields[0] > 0
            out = [told(level, _classes(fields[0][seen]), shard)]
            if seen.any():
                below = _shorter([c[seen] for c in ids], fields[0][seen], prefix[seen])
                shard_of = (lambda columns: columns[0] % shards) if level == 2 else (lambda columns: _whole_shard(gram_key(columns), shards))
                out += _blobs(below, [shard_of(columns) for columns, _ in below], shards)
            return _rows(out)

        return run

    def sum_contexts(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blobs = [b.as_py() for b in table.column("blob")]
        if shard >= 0:
            sections = _gather(blobs)
            size = max(int(columns[0].max(initial=0)) for columns, _ in sections) // shards + 1
            fields = [_sums(columns[0] // shards, size, values) for columns, values in sections]
            fields = [*fields[0], *fields[1]]
            write_table(f"{path}/1-{shard}", None, fields)
            blobs = [told(1, _classes(fields[0][fields[0] > 0]), shard)[1]]
        figures = [_unpack(b) for b in blobs]
        return pa.table({"level": pa.array([int(at[0]) for at, _ in figures], pa.int64()), "figures": pa.array([f.tolist() for _, f in figures], pa.list_(pa.int64()))})

    parts = int(min(PARTITIONS, shards))
    grouped = lambda rows, function, shape: rows.repartition(parts, "shard").groupBy("shard").applyInArrow(function, shape)
    blob = "shard bigint, blob binary"
    counted = grouped(source.mapInArrow(count_words, blob), sum_words, "tokens bigint, words bigint").agg(F.sum("tokens"), F.sum("words")).first()
    blobs = source.mapInArrow(count, blob)
    for level in range(order, 1, -1):
        blobs = grouped(blobs, summed(level), blob)
    figures = grouped(blobs, sum_contexts, "level bigint, figures array<bigint>")
    sums = {r.level: [r[f"f{i}"] for i in range(7)] for r in figures.groupBy("level").agg(*(F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(7))).collect()}
    if not sums:
        return NgramModel(path, shards, order, 0, 0, 0, ((0.5, 1.0, 1.5),) * order, (0, 0, 0))
    return NgramModel(
        path, shards, order, counted[0], counted[1], sums[1][6], tuple(discounts(np.array(sums[k][:4])) for k in range(1, order + 1)),
        (sums[1][0], sums[1][1], sums[1][4]),
    )


class Reader:
    """The model's tables, mapped into memory on first use."""

    def __init__(self, path: str, shards: int, order: int):
        self.path, self.shards, self.order, self.open = path, shards, order, {}

    def _file(self, name: str, read: Callable):
        if name not in self.open:
            if len(self.open) >= MAPPED:
                self.open.clear()
            path = f"{self.path}/{name}"
            self.open[name] = read(path) if os.path.exists(path) else None
        return self.open[name]

    def _by_shard(self, shard: np.ndarray, then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places) for each shard; `then` orders the places, so that they touch pages in turn."""
        if not len(shard):
            return
        order = np.argsort(shard.astype(np.uint64) << _U(32) | then)
        ranked = shard[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            yield int(ranked[a]), order[a:b]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and number of each word; 0 and -1 for an unknown one."""
        count, number, keys = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1), _mix(hashes)
        for k, places in self._by_shard(_word_shard(hashes, self.shards), keys >> _U(32)):
            table = self._file(f"words-{k}", Table)
            if table is not None:
                hit, rows = table.find(keys[places])
                count[places[hit]] = table.at(rows)[:, 0]
                number[places[hit]] = self._file(f"ranks-{k}", lambda path: np.memmap(path, "<u4", "r"))[rows].astype(np.int64) * self.shards + k
        return count, number

    def word_stats(self, numbers: np.ndarray) -> np.ndarray:
        """Of each word: the distinct words before it, and as a context the total and classes of what follows."""
        out = np.zeros((len(numbers), 5), np.int64)
        known = np.flatnonzero(numbers >= 0)
        for k, places in self._by_shard(numbers[known] % self.shards, (numbers[known] // self.shards).astype(np.uint64)):
            table = self._file(f"1-{k}", Table)
            if table is not None:
                out[known[places]] = table.at(numbers[known[places]] // self.shards)
        return out

    def gram_stats(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of each n-gram: its count and, unless it is of the longest, the total and classes of what follows."""
        top, key = len(columns) == self.order, gram_key(columns)
        out = np.zeros((len(key), 1 if top else 5), np.int64)
        shard = _top_shard(columns, key, self.shards) if top else _whole_shard(key, self.shards)
        for k, places in self._by_shard(shard, key >> _U(32)):
            table = self._file(f"{len(columns)}-{k}", Table)
            if table is not None:
                out[places] = table.look_up(key[places] >> _U(16))
        return out


def token_scores(m: NgramModel, reader: Reader, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its training count and the log10 of its probability after the tokens before it."""
    first = np.cumsum(counts) - counts
    known, numbers = reader.words(hashes)
    columns = grams(numbers, counts, m.order)
    less = lambda count, d: np.maximum(count - np.choose(np.minimum(count, 3), [0.0, *d]), 0)
    stats = reader.word_stats(numbers)
    d, total = m.discounts[0], max(1, m.pairs)
    spare = sum(x * n for x, n in zip(d, m.word_classes, strict=True)) / total if m.pairs else 1.0
    p = less(stats[:, 0], d) / total + spare / (m.vocabulary + 1)
    for level in range(2, m.order + 1):
        begin = [np.zeros(1, np.int64)] * (level - 1)
        context = np.empty((len(stats), 4), np.int64)
        context[1:] = stats[:-1, 1:]
        context[first] = (reader.word_stats(begin[0]) if level == 2 else reader.gram_stats(begin))[0, 1:]
        stats = reader.gram_stats(columns[m.order - level :])
        d, total = m.discounts[level - 1], context[:, 0]
        p = np.where(total > 0, (less(stats[:, 0], d) + context[:, 1:] @ np.array(d) * p) / np.maximum(total, 1), p)
    return known, np.log10(p)


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    base_score is the sum of log10 of the add-one unigram probability, score the model's log10
    probability of the text; 10 ** (-score / n_tokens) is the perplexity. A null or empty text has
    one token, the end; repeated rows are scored each; an empty table gives an empty result; further
    columns are ignored; a text of any length is scored whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.path, model.shards, model.order)
        for batch in batches:
            for part in slices(batch, limit=SCORE_BYTES):
                h, n = tokens(*text_buffer(part.column("text")))
                count, log = token_scores(model, reader, h, n)
                base = np.log10((count + 1.0) / (model.train_tokens + model.vocabulary + 1.0))
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, log)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.train_tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
