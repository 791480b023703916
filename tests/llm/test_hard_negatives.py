"""Hard negatives against plain loops: ties, odd rows, several tiles, vectors of several lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tidewheel.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, key int, g int, bands string, kind int, score double"


def plain(rows, is_anchor, most=5):
    """rows: {id: (label, vector)}."""
    whole = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in rows.items()}
    out = set()
    for a, (label, q) in whole.items():
        if not is_anchor(a):
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, r, strict=True)), i, lab) for i, (lab, r) in whole.items() if i != a and len(r) == len(q)))
        for p, i, _ in [s for s in scores if s[2] == label][:most]:
            fits = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:most]
            out |= {(a, i, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fits)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, "v", 1, 2, "b", 3, 0.5) for i, lab, v in rows], SCHEMA).repartition(3)


def mined(df, **options):
    return {tuple(r) for r in hard_negatives.mine(df, lambda i: i % 10 == 0, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"rows_each": 40, "anchors_each": 3}])
def test_against_plain_loops(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, i % 3, (centres[rng.integers(6)] + rng.normal(size=8) * 0.3).tolist()) for i in range(150)]
    rows += [(150 + i, i % 3, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(60)]  # many ties
    rows += [(210 + i, i % 2, rng.normal(size=5).tolist()) for i in range(30)]  # another length
    rows += [(250, 0, []), (251, 1, []), (252, 0, []), (260, 1, [0.0] * 8), (270, 2, [1000.0, -2000.0, 3.5, 0.0, 0.0, 0.0, 0.0, 1.0])]
    want = plain({i: (lab, v) for i, lab, v in rows}, lambda i: i % 10 == 0)
    assert len(want) > 200 and mined(frame(spark, rows), **options) == want


def test_odd_rows(spark):
    sound = [(i, i % 2, [math.cos(i), math.sin(i)]) for i in range(40)]
    odd = [(None, 0, [1.0, 0.0]), (100, None, [1.0, 0.0]), (110, 0, None), (120, 0, [float("nan"), 0.0]), (130, 1, [None, 1.0]), (140, 1, [float("inf"), 1.0]), (150, 1, [1e30, 1.0])]
    want = plain({i: (lab, v) for i, lab, v in sound}, lambda i: i % 10 == 0)
    assert mined(frame(spark, sound + odd)) == want
    assert mined(frame(spark, sound + sound[:7])) == want  # repeated rows count once
    assert mined(frame(spark, sound + [(3, 5, [1.0, 0.0])])) == want  # of one id the smallest label
    assert mined(frame(spark, sound).where("vec_id % 10 <> 0")) == set()
    assert hard_negatives.mine(frame(spark, sound).where("false"), lambda i: i % 10 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(frame(spark, sound).where("false")) == set()


def test_intervals_hold_the_score():
    rng = random.Random(4)
    for top in (1, 5, 200, 2**20):
        a = np.array([[rng.randint(-top, top) for _ in range(16)] for _ in range(9)])
        q = np.array([[rng.randint(-top, top) for _ in range(16)] for _ in range(31)])
        exact, widths = a @ q.T, []

        def test(i, low, high, exact=exact, widths=widths):
            assert i is None and (low <= exact).all() and (exact <= high).all()
            widths.append(float((high - low).max()))
            return np.ones(low.shape, bool)

        i, j, score = hard_negatives.survivors(a, q, np.ones(exact.shape, bool), test)
        assert (score == exact[i, j]).all() and len(score) == exact.size and widths[-1] == 0 and widths == sorted(widths, reverse=True)


def test_query_at_more_rows(spark):
    sf = "/root/testdata/sf0.01"
    frame_ = queries.op12_hard_negatives(spark, sf)
    assert difference(frame_, queries.ORACLE_SQL["op12_hard_negatives"], connect(sf)) is None and frame_.select(F.max("rank")).first()[0] == 5
