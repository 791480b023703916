"""Byte-level BPE encoding and decoding through sentencepiece.

A sentencepiece BPE model is serialised directly from a vocabulary of ranks: every byte string is a
piece of byte-mapped characters, its score is the negative rank, and the normaliser is the identity.
Pre-tokens are encoded on their own and decoding is the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tidewheel.llm.common import slices, texts_of

#: Pre-tokens whose ids a worker remembers.
CACHE = 400_000
#: Longer pre-tokens are not remembered.
CACHED_CHARS = 40


def byte_characters() -> list[str]:
    """A printable character for each byte: the byte's own where Latin-1 has a visible one, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: varint, 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece; a token of rank r is piece r + 1.

    Of trainer_spec: model_type (3) is BPE (2), and beginning, end and padding (41 to 43) don't exist.
    Of normalizer_spec: the identity (1), no dummy prefix (3), no removal (4) or escape (5) of blanks.
    """
    character = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    none = (1 << 64) - 1
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(character[b] for b in token).encode()) + _field(2, -float(rank)) for token, rank in by_rank]
    trainer = _field(3, 2) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))


class Codec:
    """Ids are ranks. A pre-token that is a token itself has that id; others are merged by sentencepiece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.split = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters()))
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda item: item[1])]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts]
        known = self.known
        merge = []
        for p in {p for part in parts for p in part if p not in known}:
            rank = self.ranks.get(p.encode())
            if rank is None:
                merge.append(p)
            else:
                known[p] = (rank,)
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in merge]
        for p, ids in zip(merge, self.pieces.encode(mapped, out_type=int, num_threads=1), strict=True):
            known[p] = tuple(i - 1 for i in ids)
        out = [[i for p in part for i in known[p]] for part in parts]
        if len(known) > CACHE:
            known.clear()
        for p in merge:
            if len(p) > CACHED_CHARS:
                known.pop(p, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        if ids and not (0 <= min(ids) and max(ids) < len(self.tokens)):
            raise ValueError(f"ids must be from 0 to {len(self.tokens) - 1}")
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row of docs.

    ids are ranks of the vocabulary file; ids_sha256 is of them as little-endian unsigned 32-bit
    integers, decoded_sha256 of the bytes that decoding gives back. A null or empty text has no ids;
    repeated rows are encoded each; an empty table gives an empty result; further columns are ignored;
    a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                found = own.encode(part.column("text").to_pylist())
                arrays = [
                    part.column("doc_id"), pa.array([len(i) for i in found], pa.int64()),
                    pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in found]), pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays.append(pa.array(found, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of each row's ids, which must be those of the vocabulary.

    Null ids count as none; repeated rows are decoded each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(i or []) for i in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary")
