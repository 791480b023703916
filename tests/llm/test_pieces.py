"""SentencePiece encoding against the library: ids, decoded texts, and the cases of the fixtures."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tests.llm import fixtures
from tidewheel.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(library, doc_id, text):
    ids = library.encode(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_query_is_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op11_pieces(spark, SF).collect()))
    assert got == sorted(row(library, d.doc_id, d.text) for d in docs)


def test_nulls_empty_long_and_repeated_rows(spark, library):
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in pieces.encode(fixtures.docs(spark), PATH, ids=False).collect()), key=key)
    assert got == sorted((row(library, i, t) for i, t, *_ in fixtures.rows()), key=key)
    assert pieces.encode(fixtures.empty(spark), PATH).collect() == []


def test_decoding_is_the_inverse(spark, library):
    encoded = pieces.encode(fixtures.docs(spark).where("doc_id is not null"), PATH)
    want = {(i, (t or "")) for i, t, *_ in fixtures.rows() if i is not None}
    assert {tuple(r) for r in pieces.decode(encoded, PATH).collect()} == want
    assert pieces.decode(encoded.selectExpr("doc_id", "cast(null as array<int>) as ids"), PATH).select("text").distinct().collect()[0].text == ""


def test_odd_texts_and_ids(library):
    rng, own = random.Random(5), pieces.codec(PATH)
    parts = ["a", "b", "e", " ", "  ", "\n", "the", "ing", "▁", "é", "日", "😀", "\t", "<s>", "</s>", "<0x41>", "\x85", "\0", "th", "er", "ß", "и", "    ", "lo"]
    texts = ["", " ", " " * 1000 + "hello", " " * 33, "a" * 5001, "▁▁▁ ▁", "ab" * 3000, "x" * 30_000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text, (numbers, decoded) in zip(texts, own.encode(texts), strict=True):
        ids = library.encode(text)
        assert numbers == ",".join(map(str, ids)) and decoded == library.decode(ids) == own.model.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(128, 258), rng.randint(259, 31_999), 28_705]) for _ in range(rng.randint(1, 8))]
        assert own.model.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError, match="ids must be"):
        own.model.decode([32_000])


def test_pairs_merge_in_the_order_of_scores():
    """A small model of its own: ties of scores, a piece of a better score than its part, and a character that is no piece."""
    scores = {"a": 0, "b": 0, "▁": 0, "ab": -3, "aa": -2, "aaa": -2, "bb": -1, "abb": -1.5, "ac": -0.5}
    text = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    piece = lambda p, s, k: text(1, text(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k]))
    raw = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(p, s, 1) for p, s in scores.items())
    raw += text(2, bytes([3 << 3, 2]) + bytes([0x98, 0x02, 1])) + text(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model, rng = pieces.Model(raw), random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("aaabbc▁") for _ in range(rng.randint(1, 70)))
        assert [i for ids in model.merge(model.words(model.normalise(word))) for i in ids] == library.encode(word), word
