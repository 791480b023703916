"""String functions (STR-1 to STR-5)."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def clean_label(c: Column) -> Column:
    """STR-1: lower case, no hyphens, line ends as underscores."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("-"), F.lit("")), r"[\r\n]", "_")


def canonical_label(c: Column, names: Iterable[str]) -> Column:
    """STR-2: replaced by each name in turn that it then contains, so the first name that the text contains counts."""
    out = c
    for name in names:
        out = F.when(out.contains(name), F.lit(name)).otherwise(out)
    return out


def part_of(c: Column, separator: str, index: int) -> Column:
    """STR-3: a part of a split text, from the end if the index is negative; missing if there is none."""
    parts = F.split(c, regex.escape(separator))
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def digits_only(c: Column) -> Column:
    """STR-4, FLT-15: whether the text has digits and nothing else."""
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


@lru_cache(maxsize=100_000)
def words_of(text: str) -> frozenset[str]:
    """The different words of a text, in lower case."""
    return frozenset(regex.sub(r"[^\p{L}\p{N}_]+", " ", text).lower().split())


@lru_cache(maxsize=100_000)
def _similarity(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio())


def token_set_score(a: str | None, b: str | None) -> int:
    """STR-5: the best of the ratios between the sorted common words and these with either side's other words.

    0 if either text has no words. Ratios are those of difflib, in percent.
    """
    x, y = words_of(a or ""), words_of(b or "")
    if not x or not y:
        return 0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max(_similarity(common, one) if common else 0, _similarity(common, two) if common else 0, _similarity(one, two))


@F.pandas_udf(IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
