"""Toxicity: a linear-chain conditional random field over the words of a sentence.

Labels are of documents, so token labels come first: words and word beginnings that occur in the toxic
texts of the sample significantly more often than in its others mark the toxic tokens of toxic texts.
The field learns to tag these tokens from hashed features of each word and from the tags beside it. With two
tags, forward and backward messages are one ratio each, so the marginals
of all sentences of a batch are computed together. A text's score is a logistic function of the sum
and the maximum of its marginals.

A word is a run of letters, digits, apostrophes and bytes beyond ASCII; in scripts without blanks between
words each character is one. A chain is a sentence of any length: long ones are handled in pieces side by
side, with the exact messages carried from piece to piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm.common import slices, text_buffer, texts_of, word_spans
from tidewheel.llm.quality import labelled_sample, trained

#: Bound of the training sample: so many labelled rows of each class at most. Its word features are held by one task.
SAMPLE_ROWS = 3000
#: Hashed features: whole words, and beginnings of so many bytes of longer words.
BEGINNINGS, BITS = (4, 5, 6, 7, 8), 20
#: Tokens of the pieces in which long chains are handled. Bytes of a word that are hashed side by side with those of others.
PIECE, SHORT = 64, 64
STEP_BYTES = 1 << 20
_U = np.uint64
_GAP = np.ones(256, bool)
_GAP[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: First bytes (UTF-8) of characters that are words of their own: kana, Chinese characters, other planes. Of E0: the second bytes of Thai and Lao.
_ALONE = np.zeros(256, bool)
_ALONE[[*range(0xE3, 0xEA), *range(0xF0, 0xF5)]] = True
_THAI = np.zeros(256, bool)
_THAI[0xB8:0xBC] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n|"]] = True
_CODE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CODE[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_FORWARD = np.cumprod(np.concatenate([[_U(1)], np.full(1 << 16, _BASE, np.uint64)]), dtype=np.uint64)


@dataclass
class Tagger:
    """weights by hashed feature; bias; logarithms of the potentials start-toxic, clean-toxic, toxic-clean, toxic-toxic;
    document: logistic weights of a text's sums (see summary) and their bias."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    document: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, 1 + beginnings) hashed features; -1 where a word is no longer than the beginning."""
    out = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int32)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        longest = int((ends - starts).max())
        hashed = np.zeros(len(starts), np.uint64)
        left = np.arange(len(starts))
        for k in range(min(longest, SHORT)):  # byte by byte over all words that are long enough
            left = left[(ends - starts)[left] > k]
            if k in BEGINNINGS:
                out[left, 1 + BEGINNINGS.index(k)] = _fold(hashed[left] + _U(k))
            hashed[left] += _CODE[data[starts[left] + k]] * _FORWARD[k & 0xFFFF]
        for i in np.flatnonzero(ends - starts > SHORT).tolist():  # the rest of long words
            rest = data[starts[i] + SHORT : ends[i]]
            hashed[i] += np.sum(_CODE[rest] * _FORWARD[np.arange(SHORT, SHORT + len(rest)) & 0xFFFF], dtype=np.uint64)
        out[:, 0] = _fold(hashed)
    return out


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> _U(29))) >> _U(64 - BITS)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's number of words."""
    starts, ends, words = word_spans(data, offsets, _GAP)
    if not len(data) or not (_ALONE[data].any() or (data == 0xE0).any()):
        return starts, ends, words
    lead = data & 0xC0 != 0x80
    alone = _ALONE[data]
    alone[:-1] |= (data[:-1] == 0xE0) & _THAI[data[1:]]
    whole = alone[np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))]  # each byte by its character's first
    new = np.zeros(len(data) + 1, bool)
    new[starts] = True
    inside = ~_GAP[data]
    cut = lead & inside & whole
    cut[1:] |= lead[1:] & inside[1:] & inside[:-1] & whole[:-1]
    new[:-1] |= cut
    begins = np.flatnonzero(new[:-1])
    last = np.zeros(len(data) + 1, bool)
    last[ends] = True
    last[begins[1:]] |= inside[begins[1:] - 1]
    return begins, np.flatnonzero(last), np.diff(np.searchsorted(begins, offsets))


def chains(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """First token of each chain: a text's or sentence's first word."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    new = np.zeros(n, bool)
    new[1:] = stops[starts[1:]] > stops[ends[:-1]]
    new[0] = True
    at = np.concatenate([[0], np.cumsum(words)[:-1]])
    new[at[words > 0]] = True
    return np.flatnonzero(new)


def _through(matrices: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A ratio after a step or several: each step is a fractional linear map."""
    return (matrices[:, 0] * odds + matrices[:, 1]) / (matrices[:, 2] * odds + matrices[:, 3])


def _carried(e: np.ndarray, moves: np.ndarray, begin: np.ndarray, length: np.ndarray, chain: np.ndarray, forward: bool) -> np.ndarray:
    """The message that enters each piece of the chains, from the piece before it (forward) or after it.

    The maps of a piece's tokens are multiplied for all pieces side by side; then the messages go from piece to piece.
    """
    start, into, out_of, stay = moves
    n = len(begin)
    product = np.tile(np.array([1.0, 0.0, 0.0, 1.0]), (n, 1))
    for t in range(int(length.max())):
        now = np.flatnonzero(length > t)
        x = e[begin[now] + (t if forward else length[now] - 1 - t)]
        a, b, c, d = product[now].T
        if forward:  # r -> e (into + stay r) / (1 + out_of r)
            step = np.stack([x * (stay * a + into * c), x * (stay * b + into * d), out_of * a + c, out_of * b + d], 1)
        else:  # b -> (out_of + stay e b) / (1 + into e b)
            step = np.stack([stay * x * a + out_of * c, stay * x * b + out_of * d, into * x * a + c, into * x * b + d], 1)
        product[now] = step / step.max(1, keepdims=True)
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    count = np.diff(np.append(first, n))
    entering = np.ones(n)
    for k in range(1, int(count.max())):
        now = first[count > k] + k if forward else (first + count)[count > k] - 1 - k
        before = now - 1 if forward else now + 1
        if forward and k == 1:  # nothing enters the first piece: its first token starts the chain
            r = e[begin[before]] * start
            for t in range(1, PIECE):
                r = e[begin[before] + t] * (into + r * stay) / (1 + r * out_of)
            entering[now] = r
        else:
            entering[now] = _through(product[before], entering[before])
    return entering


def messages(tagger: Tagger, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of each token; their product is the odds of the marginal."""
    moves = np.exp(tagger.moves)
    start, into, out_of, stay = moves
    e = np.exp(np.clip(emission, -30, 30))
    length = np.diff(np.append(first, len(emission)))
    pieces = -(-length // PIECE)
    chain = np.repeat(np.arange(len(first)), pieces)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = first[chain] + place * PIECE, np.minimum(length[chain] - place * PIECE, PIECE)
    r0, b0 = np.zeros(len(begin)), np.ones(len(begin))
    long = np.flatnonzero(pieces[chain] > 1)
    if len(long):
        r0[long] = _carried(e, moves, begin[long], size[long], chain[long], True)
        b0[long] = _carried(e, moves, begin[long], size[long], chain[long], False)
    order = np.argsort(-size, kind="stable")
    begin, size, r0, b0, fresh = begin[order], size[order], r0[order], b0[order], place[order] == 0
    many = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead, back = np.empty_like(e), np.empty_like(e)
    for t, m in enumerate(many):
        at = begin[:m] + t
        r = ahead[at - 1] if t else r0
        ahead[at] = e[at] * (into + r * stay) / (1 + r * out_of)
        if not t:
            ahead[at[fresh]] = e[at[fresh]] * start
    back[begin + size - 1] = b0
    for t in range(len(many) - 1, 0, -1):
        at = begin[: many[t]] + t
        eb = e[at] * back[at]
        back[at - 1] = (out_of + stay * eb) / (1 + into * eb)
    return ahead, back


def emissions(tagger: Tagger, feats: np.ndarray) -> np.ndarray:
    padded = np.append(tagger.weights, np.float32(0))
    total = np.full(len(feats), tagger.bias)
    for k in range(feats.shape[1]):
        total += padded[feats[:, k]]
    return total


def _copies(feats: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts whose words have the same two least hashes as an earlier text's: copies say nothing new about a word."""
    seen, out = set(), np.zeros(len(at) - 1, bool)
    for i in range(len(out)):
        words = np.unique(feats[at[i] : at[i + 1], 0]).astype(np.uint64)
        key = tuple(int(((words + _U(k)) * _U(_BASE) >> _U(20)).min()) for k in (1, 2)) if len(words) else ()
        out[i] = key in seen
        seen.add(key)
    return out


def lexicon(feats: np.ndarray, owner: np.ndarray, toxic: np.ndarray, lift: float = 4.0) -> np.ndarray:
    """Features that occur in toxic texts `lift` times as often as in others, beyond what chance gives among so many."""
    size = 1 << BITS
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    a, b = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for s in range(0, len(toxic), 200):  # texts with a feature are counted by blocks of texts, which bounds the pairs that are held
        part = slice(*np.searchsorted(owner, [s, s + 200]))
        flat, text = feats[part].ravel(), np.repeat(owner[part], feats.shape[1])
        pairs = np.unique(text[flat >= 0] * size + flat[flat >= 0])
        text, feat = pairs // size, pairs % size
        a += np.bincount(feat[toxic[text]], minlength=size)
        b += np.bincount(feat[~toxic[text]], minlength=size)
    share = (a + b) / (n1 + n0)
    part = lambda x, n: x * np.log(np.maximum(x, 1e-9) / np.maximum(n * share, 1e-9))
    ratio = 2 * (part(a, n1) + part(b, n0) + part(n1 - a, n1 * (1 / np.maximum(share, 1e-9) - 1)) + part(n0 - b, n0 * (1 / np.maximum(share, 1e-9) - 1)))
    return np.flatnonzero((ratio > 2 * np.log(max(2, (a + b > 0).sum())) + 4) & (a / n1 > lift * b / n0))


def gradients(tagger: Tagger, feats: np.ndarray, y: np.ndarray, p: np.ndarray, emission: np.ndarray, ahead: np.ndarray, back: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood of tags y, given the marginals p: by the feature weights, and by the bias and the moves."""
    now = np.setdiff1d(np.arange(len(y)), first, assume_unique=True)
    eb, r = np.exp(np.clip(emission[now], -30, 30)) * back[now], ahead[now - 1]
    _, into, out_of, stay = np.exp(tagger.moves)
    total = 1 + into * eb + r * out_of + r * stay * eb
    was, is_ = y[now - 1], y[now]
    small = np.array([
        (y - p).sum(), (y - p)[first].sum(), ((1 - was) * is_ - into * eb / total).sum(),
        (was * (1 - is_) - r * out_of / total).sum(), (was * is_ - r * stay * eb / total).sum(),
    ])
    grad = np.zeros(len(tagger.weights))
    for k in range(feats.shape[1]):
        there = feats[:, k] >= 0
        grad += np.bincount(feats[there, k], (y - p)[there], minlength=len(grad))
    return grad, small


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 5, least_steps: int = 300, batch: int = 60, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Tagger:
    """AdaGrad on the conditional log-likelihood of the tags, over two thirds of the texts; a logistic fit of the
    text's sums over the rest, with weights that restore the classes' shares."""
    tagger = Tagger(np.zeros(1 << BITS, np.float32), -5.0, np.array([-1.0, -1.0, 0.0, -1.0]), np.array([0.0, 0.0, 0.0, -6.0]))
    if not len(texts) or not labels.any():
        return tagger
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, words = tokens(data, offsets)
    feats, owner = features(data, starts, ends), np.repeat(np.arange(len(texts)), words)
    marks = np.zeros((1 << BITS) + 1, bool)
    at = np.concatenate([[0], np.cumsum(words)])
    new = ~_copies(feats, at)
    number = np.cumsum(new) - 1
    marks[lexicon(feats[new[owner]], number[owner[new[owner]]], labels[new] > 0)] = True
    tags = marks[feats].any(1) & (labels > 0)[owner]
    first_all = chains(data, starts, ends, words)
    rng, seen, seen_small = np.random.default_rng(seed), np.full(1 << BITS, 1e-3), np.full(5, 1e-3)
    fold = rng.permutation(len(texts))
    fold, rest = fold[len(texts) // 3 :], fold[: len(texts) // 3]
    for _ in range(max(epochs, -(-least_steps * batch // len(texts)))):
        for part in np.array_split(rng.permutation(fold), max(1, len(fold) // batch)):
            part = part[words[part] > 0]
            if not len(part):
                continue
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
            f, y = feats[rows], tags[rows].astype(float)
            begins = np.zeros(len(starts), bool)
            begins[first_all] = True
            first = np.flatnonzero(begins[rows])
            emission = emissions(tagger, f)
            ahead, back = messages(tagger, emission, first)
            p = ahead * back / (1 + ahead * back)
            grad, small = gradients(tagger, f, y, p, emission, ahead, back, first)
            seen += grad * grad
            seen_small += small * small
            tagger.weights = ((1 - decay) * tagger.weights + rate * grad / np.sqrt(seen)).astype(np.float32)
            move = rate * small / np.sqrt(seen_small)
            tagger.bias += move[0]
            tagger.moves = np.clip(tagger.moves + move[1:], -6, 6)
    ahead, back = messages(tagger, emissions(tagger, feats), first_all)
    x = np.hstack([summary(ahead * back / (1 + ahead * back), words)[rest], np.ones((len(rest), 1))])
    tagger.document = _logistic(x, labels[rest], weights[rest] / weights[rest].mean()) if labels[rest].any() else tagger.document
    return tagger


def summary(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each text: log of 1 + the expected toxic words, the log odds of the largest marginal, the log of its words."""
    at, full = np.concatenate([[0], np.cumsum(words)]), words > 0
    out = np.zeros((len(words), 3))
    out[:, 1] = -7
    if full.any():
        first = at[:-1][full]
        out[full, 0] = np.log1p(np.add.reduceat(np.where(p > 0.02, p, 0), first))
        top = np.clip(np.maximum.reduceat(p, first), 1e-3, 1 - 1e-3)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log(words[full])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weights * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, **options) -> Tagger:
    return trained(*labelled_sample(docs, labels, label, rows, **options), train)


def marginals(tagger: Tagger, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each word is toxic; starts, ends and words of each text."""
    starts, ends, words = tokens(data, offsets)
    ahead, back = messages(tagger, emissions(tagger, features(data, starts, ends)), chains(data, starts, ends, words))
    return ahead * back / (1 + ahead * back), starts, ends, words


def document_scores(tagger: Tagger, p: np.ndarray, words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(summary(p, words) @ tagger.document[:-1] + tagger.document[-1], -30, 30)))


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score[, spans]) of each row of docs, from the marginals of its words.

    spans: begin, end (byte offsets in the UTF-8 text) and probability of each run of words above the
    threshold. A null or empty text, or one without words, has the score of no marginals and no spans;
    repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                data, offsets = text_buffer(part.column("text"))
                p, starts, ends, words = marginals(shared.value, data, offsets)
                arrays, names = [part.column("doc_id"), pa.array(document_scores(shared.value, p, words))], ["doc_id", "score"]
                if spans:
                    at, found = np.concatenate([[0], np.cumsum(words)]), [[] for _ in words]
                    hits = np.flatnonzero(p >= threshold)
                    owner = np.searchsorted(at, hits, side="right") - 1
                    last = -2
                    for i, d in zip(hits.tolist(), owner.tolist(), strict=True):
                        base = int(offsets[d])
                        if i == last + 1 and found[d]:
                            found[d][-1] |= {"end": int(ends[i]) - base, "probability": max(found[d][-1]["probability"], float(p[i]))}
                        else:
                            found[d].append({"begin": int(starts[i]) - base, "end": int(ends[i]) - base, "probability": float(p[i])})
                        last = i
                    arrays.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double" + ", spans array<struct<begin: bigint, end: bigint, probability: double>>" * spans)
