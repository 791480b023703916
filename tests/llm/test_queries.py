"""The registered queries on the smallest tables, row by row: with SQL, or with a library or plain loops."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.compare import connect, difference
from tests.llm import plain_pii
from tests.llm.test_dedup import brute_components, brute_print
from tests.llm.test_text import PlainModel, assert_packed, plain_network
from tidewheel.llm import bpe, packing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def bucket(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], connect(SF)) is None


def test_op1(spark, texts):
    plain = PlainModel([t for i, t in texts.items() if bucket(i, 7) != 2], 3)
    got = {r.doc_id: r for r in queries.op1_lm_score(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].held_out == (bucket(i, 7) == 2) and tuple(got[i])[2:] == pytest.approx(plain.row(t))


def test_op2(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit(docs, labels.where(queries.bucket_of(labels["doc_id"], 3) != 1), "quality")
    got = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (bucket(i, 3) == 1) and r.predicted == (r.score >= 0.5)
    for i in sorted((i for i in texts if len(texts[i]) < 700), key=lambda i: len(texts[i]))[:: max(1, len(texts) // 30)]:
        assert got[i].score == pytest.approx(plain_network(net, texts[i].encode()), abs=1e-4)


def test_op4(spark, texts):
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = queries.op4_packing(spark, SF).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    assert_packed(got, 1024, packing.lower_bound(np.array([r.length for r in got]), 1024) + 1)


def test_op5(spark, texts):
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = {(i, len(ids := library.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op5_bpe(spark, SF).collect()} == want


def test_op7(spark, texts):
    want = dict(zip(texts, plain_pii.replace(list(texts.values()), queries.PII_KEY), strict=True))
    assert {r.doc_id: (r.text or "", r.n_entities) for r in queries.op7_pii(spark, SF).collect()} == want


def test_op8(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op8_token_counts(spark, SF).collect()} == want


def test_op9(spark, texts):
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (bucket(i, 4) == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1


def test_op10(spark, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    ids = sorted(texts)
    label = brute_components([prints[i] for i in ids], lambda a, b: bin(a ^ b).count("1") <= 3)
    want = {(i, f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, label, strict=True)}
    assert {tuple(r) for r in queries.op10_simhash(spark, SF).collect()} == want
