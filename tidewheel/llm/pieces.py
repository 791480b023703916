"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read here (a protocol buffer of pieces, scores, types and settings); the library only
serves as the reference in the tests. A text is normalised as the model says and cut into words that no
piece can cross. The words that a worker hasn't seen are merged together, in flat arrays of symbols:

1. each adjacent pair has the rank of the piece that it would make; one segmented minimum gives each word's best rank;
2. every word merges its leftmost pair of that rank, all words at once, and where ranks allow it all pairs of that rank
   that don't overlap, from the left;
3. arrays are compacted, words without a pair leave, and the next round begins.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm.common import slices, texts_of

SPACE = "▁"
#: What an unknown piece decodes to, as in the library, unless the model says otherwise.
UNKNOWN = " ⁇ "
#: Words whose ids a worker remembers, and the longest of them.
CACHE, CACHED_CHARS = 400_000, 40
NONE = np.int32(2**31 - 1)
#: In words of more symbols, pairs that must merge one by one don't take a round each.
SHORT = 32


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


NORMAL, UNKNOWN_TYPE, CONTROL, USER, UNUSED, BYTE = range(1, 7)


class Model:
    """Pieces, types and settings of a sentencepiece BPE model whose normaliser is the identity."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or trainer.get(24, 0):
            raise ValueError("only BPE models with the identity as normaliser and spaces before words are encoded")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces aren't encoded")
        self.prefix, self.strip, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.surface = trainer[44].decode() if 44 in trainer else UNKNOWN
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if not trainer.get(35, 0) or len(self.bytes) != 256:
            raise ValueError("only models with bytes for unknown characters are encoded")
        self.plain = {i: p.replace(SPACE, " ") for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self._tables(scores)

    def _tables(self, scores: list[float]) -> None:
        """Symbols are piece ids; characters that are no piece but occur in one have numbers after them, all others -1."""
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        symbol = {c: ids[c] for p in ids for c in p if c in ids}
        for c in sorted({c for p in ids for c in p} - symbol.keys()):
            symbol[c] = len(self.pieces) + len(symbol)
        self.symbol = symbol
        self.width = len(self.pieces) + len(symbol) + 1
        name = {**symbol, **ids}
        rank = np.full(self.width, -1, np.int64)
        left, right, made = [], [], []
        for p, i in ids.items():
            if len(p) > 1:
                rank[i] = order[scores[i]]
                for cut in range(1, len(p)):
                    a, b = name.get(p[:cut]), name.get(p[cut:])
                    if a is not None and b is not None:
                        left.append(a), right.append(b), made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        key = left * self.width + right
        by = np.argsort(key)
        self.keys, self.made, self.ranks = key[by], made[by].astype(np.int32), rank[made[by]].astype(np.int32)
        self.pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        # All pairs of a rank may merge in one round if one piece has that rank and whatever that piece becomes part of ranks behind it.
        self.at_once = np.bincount(rank[rank >= 0], minlength=len(order) + 1) == 1
        for part in (left, right):
            early = (rank[part] >= 0) & (rank[made] <= rank[part])
            self.at_once[rank[part[early]]] = False
        many = {c for p in ids if len(p) > 1 for c in p} - {SPACE}
        crossing = any(SPACE in p.lstrip(SPACE) for p in ids)
        self.codes = np.sort(np.array([ord(c) for c in symbol], np.int64))
        self.symbols = np.array([symbol[chr(c)] for c in self.codes], np.int32)
        inner = "[" + "".join(re.escape(c) for c in sorted(many)) + "]" if many else "(?!)"
        self.words = re.compile(".+" if crossing else f"{SPACE}*{inner}+|{SPACE}+|.", re.DOTALL).findall

    def normalise(self, text: str) -> str:
        if self.strip:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else text

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols, NONE for pairs that make no piece, and that piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (left >= 0) & (right >= 0) if len(self.keys) else np.zeros(len(key), bool)
        return np.where(there, self.ranks[at], NONE), np.where(there, self.made[at], -1)

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word (not empty)."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        symbol = np.where(self.codes[at] == code, self.symbols[at], -1).astype(np.int32)
        lengths = np.array([len(w) for w in words])
        word, first = np.repeat(np.arange(len(words)), lengths), np.arange(len(code))  # of each symbol; first: its first character
        rank, piece = self._ranked(symbol, word, first)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            out = np.repeat(best == NONE, sizes)
            ended.append((first[out], symbol[out]))
            symbol, word, first, rank, piece = (x[~out] for x in (symbol, word, first, rank, piece))
            sizes, best = sizes[best != NONE], best[best != NONE]
            if not len(symbol):
                break
            starts = np.cumsum(sizes) - sizes
            at_once = self.at_once[best]
            one_by_one = ~at_once & (sizes > SHORT)
            hits = np.flatnonzero((rank == np.repeat(best, sizes)) & np.repeat(~one_by_one, sizes))
            place = np.arange(len(hits))
            lead = np.diff(word[hits], prepend=-1) != 0
            run = place - np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, place, 0))  # a word's last place never hits
            merged = hits[lead | (run % 2 == 0) & self.at_once[rank[hits]]]
            symbol[merged] = piece[merged]
            keep = np.ones(len(symbol), bool)
            keep[merged + 1] = False
            touched = [merged, np.maximum(merged - 1, 0), np.maximum(merged - 2, 0)]
            for w in np.flatnonzero(one_by_one).tolist():
                a, b = starts[w], starts[w] + sizes[w]
                left = self._from_the_left(symbol[a:b].tolist(), first[a:b].tolist(), int(best[w]))
                symbol[a : a + len(left)], first[a : a + len(left)] = zip(*left, strict=True)
                keep[a + len(left) : b] = False
                touched.append(np.arange(a, a + len(left)))
            again = np.zeros(len(symbol), bool)
            again[np.concatenate(touched)] = True
            again = np.flatnonzero(again[keep])
            symbol, word, first, rank, piece = (x[keep] for x in (symbol, word, first, rank, piece))
            rank[again], piece[again] = self._ranked(symbol, word, again)
        first, symbol = (np.concatenate(x) for x in zip(*ended, strict=True)) if ended else (first, symbol)
        order = np.argsort(first)
        return self._ids(code, np.cumsum(lengths), first[order], symbol[order])

    def _ranked(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at these places; the last symbol of a word begins none."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, piece = self._pairs(symbol[at], symbol[after])
        none = (after == at) | (word[after] != word[at])
        return np.where(none, NONE, rank), np.where(none, -1, piece)

    def _from_the_left(self, symbols: list[int], firsts: list[int], level: int) -> list[tuple[int, int]]:
        """One word whose best rank belongs to several pieces (such as runs of blanks), where merges must go one by one: always the
        leftmost pair of the rank, until none is left or a better one appears. A step right or a merge each, so linear in the word."""
        get, width = self.pair.get, self.width
        pair = lambda a, b: get(a * width + b, (NONE, -1)) if a >= 0 and b >= 0 else (NONE, -1)
        rest = list(zip(symbols, firsts, strict=True))[::-1]
        out = [rest.pop()]
        while rest:
            rank, made = pair(out[-1][0], rest[-1][0])
            if rank != level:
                out.append(rest.pop())
                continue
            rest.pop()
            out[-1] = (made, out[-1][1])
            near = [pair(out[-1][0], rest[-1][0])[0]] if rest else []
            near += [pair(out[-2][0], out[-1][0])[0]] if len(out) > 1 else []
            if min(near, default=NONE) < level:
                break
            if len(out) > 1:
                rest.append(out.pop())
        return out + rest[::-1]

    def _ids(self, code: np.ndarray, ends: np.ndarray, first: np.ndarray, symbol: np.ndarray) -> list[tuple[int, ...]]:
        """Ids by word; what is no piece becomes the bytes of its character."""
        cuts = np.searchsorted(first, ends).tolist()
        flat: list[int] = symbol.tolist()
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        spelt = {k: self.spell(chr(c)) for k, c in zip(odd.tolist(), code[first[odd]].tolist(), strict=True)}
        out, a = [], 0
        odd_ends = np.searchsorted(odd, cuts).tolist()
        seen = 0
        for b, upto in zip(cuts, odd_ends, strict=True):
            ids = flat[a:b] if upto == seen else [i for k in range(a, b) for i in spelt.get(k, (flat[k],))]
            out.append(tuple(ids))
            a, seen = b, upto
        return out

    def spell(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in character.encode("utf-8"))

    def decode(self, ids: Iterable[int], begins: bool = True) -> str:
        """The text of these ids; begins: they begin a text, so that one blank before it goes."""
        if not begins:
            text = "".join([self.plain.get(i, "\ufffd") for i in ids])
            if "\ufffd" not in text:
                return text
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if not 0 <= i < len(self.pieces):
                raise ValueError(f"ids must be from 0 to {len(self.pieces) - 1}")
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == CONTROL:
                continue
            piece = self.surface if kind == UNKNOWN_TYPE else self.pieces[i]
            if begins and not any(out) and (self.prefix or self.strip) and kind == NORMAL:
                cut = piece.lstrip(SPACE) if self.strip else piece.removeprefix(SPACE)
                begins, piece = self.strip and cut != piece, cut
            out.append(piece.replace(SPACE, " ") if kind == NORMAL else piece)
        return "".join(out) + (_utf8(bytes(held)) if held else "")


def _utf8(raw: bytes) -> str:
    """Whole characters as they are, each byte that belongs to none as U+FFFD."""
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as error:
            out.append(raw[: error.start].decode() + "\ufffd")
            raw = raw[error.start + 1 :]
    return "".join(out)


class Codec:
    """A model, and what a worker remembers of words: their ids as text with commas, and what these decode to."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.numbers: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids, joined by commas, and what they decode to. As words are of whole characters, a text
        decodes to what its words do, without the blank that was put before the first."""
        model, numbers, shown = self.model, self.numbers, self.shown
        parts = [model.words(model.normalise(t)) for t in texts]
        new = list(set().union(*parts) - numbers.keys())
        for w, ids in zip(new, model.merge(new), strict=True):
            numbers[w] = ",".join(map(str, ids))
            shown[w] = model.decode(ids, begins=False)
        strip = (lambda t: t.lstrip(" ")) if model.strip else (lambda t: t.removeprefix(" ")) if model.prefix else str
        out = [(",".join(map(numbers.__getitem__, part)), strip("".join(map(shown.__getitem__, part)))) for part in parts]
        if len(numbers) > CACHE:
            numbers.clear(), shown.clear()
        for w in new:
            if len(w) > CACHED_CHARS:
                numbers.pop(w, None), shown.pop(w, None)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row of docs.

    ids are those of the sentencepiece library without begin and end; ids_sha256 is of the decimal ids joined by commas,
    decoded_sha256 of the text that decoding gives back. A null or empty text has no ids; repeated rows and ids are encoded
    each, null ids too; an empty table gives an empty result; further columns are ignored; a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                found = []
                for numbers, text in own.encode(part.column("text").to_pylist()):
                    row = [numbers.count(",") + bool(numbers), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    found.append([*row, [int(i) for i in numbers.split(",") if i]] if ids else row)
                columns = list(zip(*found, strict=True))
                arrays = [part.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays.append(pa.array(columns[3], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's ids, which must be the model's; bytes that form no character give U+FFFD each.

    Null ids count as none; repeated rows are decoded each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).model
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
