"""Fuzzy matches against all pairs in plain Python."""

import random

from tests.test_scores import token_set
from tidewheel.operators import lookup, matching

WORDS = "the of republic united north south new san saint islands kingdom people democratic state great".split()


def made(rng, n):
    out = []
    for _ in range(n):
        own = ["".join(rng.choice("aaeeiioubcdlmnrst") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 2))]
        out.append(" ".join(rng.sample(WORDS, rng.randint(0, 3)) + own))
    return out


def spoilt(rng, text):
    kind = rng.random()
    if kind < 0.3:
        at = rng.randrange(len(text))
        return text[:at] + rng.choice("aeiounst") + text[at + 1 :]
    if kind < 0.5:
        return ", ".join(rng.sample(text.split(), len(text.split())))
    return text.upper() if kind < 0.6 else text.replace(" ", "-", 1) + rng.choice(["", " (the)", "."]) if kind < 0.8 else text[: rng.randint(1, len(text))]


def test_same_as_all_pairs(spark):
    rng = random.Random(6)
    choices = made(rng, 250) + ["", " - ", "日本", "Côte d'Ivoire", "x" * 70, "long " + "word " * 60 + "end", "the " * 5 + " ".join(f"w{i}" for i in range(60))]
    names = [spoilt(rng, rng.choice(choices[:250])) for _ in range(120)] + made(rng, 60) + ["", "!!", "日本国", "Cote d Ivoire", "xxxx", "x" * 90, "a word that goes on and on " * 8, None]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    want = {n: max((token_set(n, c), c) for c in choices) for n in names if n is not None}
    for shard, group in ((20_000, 20_000), (40, 30)):
        got = matching.best_matches(frame.selectExpr("n as name"), spark.createDataFrame([(c,) for c in [*choices, None]], "choice string"), shard, group).collect()
        assert {r.name: (r.score, r.match) for r in got} == want
        if shard == 20_000:
            assert sum(r.scored for r in got) < 0.2 * len(want) * len(choices)
    assert lookup.best_names(frame, "n", []).collect() == []
    assert next(r.match for r in lookup.best_names(frame, "n", choices, {"xxxx": "other"}).collect() if r.name == "xxxx") == "other"


def test_pairs_scored_grow_slower_than_pairs():
    rng, share = random.Random(7), []
    for n in (500, 4_000):
        choices = made(rng, n)
        index = matching.Index(choices)
        names = [spoilt(rng, rng.choice(choices)) for _ in range(40)]
        share.append(sum(index.best(name)[2] for name in names) / (len(names) * n))
    assert share[1] < 0.6 * share[0] and share[1] < 0.01
