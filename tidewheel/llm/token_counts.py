"""Token counts by prefix dynamic programming.

For each pre-token the exact number of BPE tokens of every one of its prefixes is stored. A prefix's
encoding ends with one token t, and what is before t is the encoding of the shorter prefix, so the
count is one more than there. Which t it is follows from neighbours: a sequence of tokens is an
encoding if each two neighbours are one. Sums over the pre-tokens give the count at every prefix of
a text, so truncation and budget questions need no new encoding.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewheel.llm.bpe import byte_characters
from tidewheel.llm.common import slices, texts_of

#: Pre-tokens, and pairs of tokens, that a worker remembers.
CACHE, PAIRS = 500_000, 1_000_000
CACHED_CHARS = 40


class PrefixCounter:
    """Counts for a tokenizers BPE file with an end-of-word suffix, lower case and dropped blanks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} isn't of the kind that is counted here")
        self.suffix = model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.inner = {t for t in model["vocab"] if not t.endswith(self.suffix)}
        self.final = {t[: -len(self.suffix)] for t in model["vocab"] if t.endswith(self.suffix)}
        self.longest = max(map(len, self.inner | self.final))
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])).split
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.table = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes | list[int]] = {}
        self.pairs: dict[tuple[str | None, str, bool], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE, to settle whether two tokens stay neighbours."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _stay(self, before: str | None, token: str, final: bool) -> bool:
        key = (before, token, final)
        found = self.pairs.get(key)
        if found is None:
            symbols = [*(before or ""), *token]
            if final:
                symbols[-1] += self.suffix
                token += self.suffix
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(symbols) == ([token] if before is None else [before, token])
        return found

    def word(self, text: str) -> list[int]:
        """Tokens of each prefix of a pre-token, by its bytes; entry 0 is the empty one."""
        w = text.encode().decode("latin-1").translate(self.table)
        inner, final, longest, pairs, stay = self.inner, self.final, self.longest, self.pairs, self._stay
        last: list[str | None] = [None]
        count, ended = [0], [0]
        for i in range(1, len(w) + 1):
            low = i - longest if i > longest else 0
            open_ = shut = None
            for j in range(low, i):
                t = w[j:i]
                if open_ is None and t in inner:
                    ok = pairs.get((last[j], t, False))
                    if stay(last[j], t, False) if ok is None else ok:
                        open_ = j
                if shut is None and t in final:
                    ok = pairs.get((last[j], t, True))
                    if stay(last[j], t, True) if ok is None else ok:
                        shut = j
                if open_ is not None and shut is not None:
                    break
            last.append(w[open_:i])
            count.append(count[open_] + 1)
            ended.append(count[shut] + 1)
        return ended

    def counts(self, piece: str) -> bytes | list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.word(piece)
            if len(piece) <= CACHED_CHARS:
                if len(self.known) >= CACHE:
                    self.known.clear()
                found = self.known[piece] = bytes(found)
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> Iterator[list[str] | None]:
        """Pre-tokens between special strings; None for each of those."""
        sections = self.specials(text) if any(m in text for m in self.marks) else [text]
        for i, section in enumerate(sections):
            if i:
                yield None
            yield self.find(self.normal(section))

    def total(self, text: str) -> int:
        n, known, counts = 0, self.known, self.counts
        for part in self.parts(text):
            if part is None:
                n += 1
            else:
                n += sum([(known.get(p) or counts(p))[-1] for p in part])
        return n


class TextPrefixes:
    """The counts at every prefix of a text after normalisation: its pre-tokens' ends and running sums, and the words' tables."""

    def __init__(self, counter: PrefixCounter, text: str):
        if any(m in text for m in counter.marks):
            raise ValueError("prefixes are those of texts without special strings")
        self.counter, self.text = counter, counter.normal(text)
        self.pieces = counter.find(self.text)
        self.starts, at = [], 0
        for p in self.pieces:
            at = self.text.index(p, at)
            self.starts.append(at)
            at += len(p)
        self.ends = [s + len(p) for s, p in zip(self.starts, self.pieces, strict=True)]
        self.sums = [0, *accumulate(counter.counts(p)[-1] for p in self.pieces)]

    def _part(self, piece: str, chars: int) -> int:
        """Tokens of a piece's beginning; a cut contraction is two pre-tokens."""
        return sum(self.counter.counts(p)[-1] for p in self.counter.find(piece[:chars])) if piece[0] == "'" else self.counter.counts(piece)[len(piece[:chars].encode())]

    def count(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        k = bisect_right(self.ends, chars)
        inside = k < len(self.pieces) and chars > self.starts[k]
        return self.sums[k] + (self._part(self.pieces[k], chars - self.starts[k]) if inside else 0)

    def longest(self, budget: int) -> int:
        """Most characters whose tokens are within the budget."""
        k = bisect_right(self.sums, budget) - 1
        if k >= len(self.pieces):
            return len(self.text)
        piece, left = self.pieces[k], budget - self.sums[k]
        if piece[0] == "'":
            return self.starts[k] + max(q for q in range(len(piece)) if q == 0 or self._part(piece, q) <= left)
        table, at, most = self.counter.counts(piece), 0, 0
        for q, char in enumerate(piece[:-1], 1):
            at += len(char.encode())
            most = q if table[at] <= left else most
        return self.starts[k] + most


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit[, cut_chars]) of each row of docs, over its whole text.

    cut_chars: the most characters of the normalised text that stay within the limit, null for a text
    with special strings. A null or empty text has 0 bytes and tokens; repeated rows are counted
    each; an empty table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                n = [own.total(t) for t in texts]
                arrays = [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                if cut:
                    arrays.append(pa.array([None if any(m in t for m in own.marks) else TextPrefixes(own, t).longest(limit) for t in texts], pa.int64()))
                    names.append("cut_chars")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", cut_chars bigint" * cut)
