"""Search for parameters with trials side by side, successive halving and a table of trials that outlives the driver (MDL-5)."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SEED = 27
SCHEMA = "study string, bracket int, trial int, rung int, share double, value double, params string"


@dataclass
class Found:
    """The best parameters at full size and their error; fits: how many were made now, in units of a full one, and altogether."""

    params: dict
    value: float
    made: int
    cost: float
    trials: int


def _unit(kind: object, value: object) -> float:
    """A parameter's place in [0, 1]; a category's number."""
    if isinstance(kind, list):
        return float(kind.index(value))
    low, high = kind[-2:]
    low, high, value = (math.log(x) for x in (low, high, value)) if kind[0] == "log" else (low, high, value)
    return (value - low) / ((high - low) or 1)


def _from_unit(kind: object, place: float) -> object:
    if isinstance(kind, list):
        return kind[int(place)]
    low, high = kind[-2:]
    place = min(1.0, max(0.0, place))
    if kind[0] == "log":
        return min(high, max(low, math.exp(math.log(low) + place * (math.log(high) - math.log(low)))))
    value = low + place * (high - low)
    return min(high, max(low, round(value))) if isinstance(low, int) and isinstance(high, int) else value


def propose(space: Mapping[str, object], seen: Sequence[tuple[dict, float]], rng: random.Random, startup: int = 8, candidates: int = 24) -> dict:
    """Tree-structured Parzen: each parameter is drawn near those of the better quarter seen, and the candidate where these are
    densest against the others is taken; random as long as fewer than `startup` are known.

    space: name: (low, high) of whole or real numbers, ("log", low, high), or a list of categories.
    """
    ranked = sorted(seen, key=lambda s: s[1])
    good, bad = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4) :]
    out = {}
    for name, kind in space.items():
        draw = lambda: rng.randrange(len(kind)) if isinstance(kind, list) else rng.random()  # noqa: B023, E731
        if len(seen) < startup or not bad:
            out[name] = _from_unit(kind, draw())
            continue
        places = [[_unit(kind, p[name]) for p, _ in part] for part in (good, bad)]
        if isinstance(kind, list):
            weight = [(1 + places[0].count(k)) / (len(kind) + len(good)) / ((1 + places[1].count(k)) / (len(kind) + len(bad))) for k in range(len(kind))]
            out[name] = kind[max(range(len(kind)), key=lambda k: weight[k] * (0.5 + rng.random()))]  # noqa: B023
            continue
        density = lambda x, at: sum(math.exp(-0.5 * ((x - p) / 0.2) ** 2) for p in at) / len(at) + 1e-12
        options = [rng.random() if rng.random() < 0.2 else rng.gauss(rng.choice(places[0]), 0.2) for _ in range(candidates)]
        out[name] = _from_unit(kind, max((min(1.0, max(0.0, o)) for o in options), key=lambda x: density(x, places[0]) / density(x, places[1])))  # noqa: B023
    return out


def tune(spark: SparkSession, objective: Callable[[dict, float], float], space: Mapping[str, object], folder: str, study: str, trials: int = 27, shares: Sequence[float] = (1 / 9, 1 / 3, 1.0), side: int = 4, bracket: int = 9, seed: int = SEED) -> Found:
    """MDL-5: the parameters of the least error.

    objective(params, share) fits with that share of the full size (rounds, trees, epochs or rows, as it likes) and gives the
    error; one that isn't finite, or that cannot be fitted for a ValueError, counts as infinite. Trials come in brackets: all
    are fitted at the first share, the better third of them at the next, and so on, so most are never fitted at full size.
    `side` fits run at once, each in a scheduler pool of its own (fair among them if spark.scheduler.mode is FAIR).

    Each fit is a row of the table below `folder`, written as it ends, in a folder of its own as several may end at once. A search that was killed goes on where it was: what a trial
    tries depends on the seed and the brackets before only, and fits in the table aren't made again.
    """
    known = _known(spark, folder, study)
    made = cost = 0

    def fit(job: tuple[int, int, int, dict]) -> float:
        b, t, rung, params = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{t % side}")
        try:
            value = float(objective(params, shares[rung]))
        except ValueError:
            value = math.inf
        value = value if math.isfinite(value) else math.inf
        spark.createDataFrame([(study, b, t, rung, float(shares[rung]), value, json.dumps(params, sort_keys=True))], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{study}-{t}-{rung}")
        return value

    seen: list[tuple[dict, float]] = []
    full: list[tuple[float, dict]] = []
    for b in range(-(-trials // bracket)):
        rng = random.Random(f"{seed}-{b}")
        alive = [(t, propose(space, seen, rng)) for t in range(b * bracket, min(trials, (b + 1) * bracket))]
        for rung in range(len(shares)):
            todo = [(b, t, rung, p) for t, p in alive if (t, rung) not in known]
            with ThreadPoolExecutor(side) as pool:
                found = list(pool.map(inheritable_thread_target(spark)(fit), todo))
            made, cost = made + len(todo), cost + len(todo) * shares[rung]
            known |= {(t, r): v for (_, t, r, _), v in zip(todo, found, strict=True)}
            ranked = sorted(alive, key=lambda x: (known[x[0], rung], x[0]))  # noqa: B023
            if rung == len(shares) - 1:
                full += [(known[t, rung], p) for t, p in ranked]
                break
            keep = max(1, len(ranked) // 3)
            seen += [(p, known[t, rung]) for t, p in ranked[keep:]]
            alive = ranked[:keep]
        seen += [(p, known[t, len(shares) - 1]) for t, p in alive]
    value, params = min(full, key=lambda x: x[0])
    return Found(params, value, made, cost, trials)


def _known(spark: SparkSession, folder: str, study: str) -> dict[tuple[int, int], float]:
    """Fits of earlier runs; there are a few for each trial."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return {}
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder).where(F.col("study") == study).select("trial", "rung", "value").collect()
    return {(r.trial, r.rung): r.value for r in rows}
