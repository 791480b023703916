"""Train, validation and test splits, reallocation and standardisation by entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.nulls import is_true, not_in, ratio
from tidewheel.operators.dedup import drop_short_entities
from tidewheel.operators.ranking import ranked

#: Last year of training, year of validation or None, first year of testing.
COUNTRY_YEARS = {
    "Austria": (2019, 2020, 2021), "Bosnia and Herzegovina": (2020, None, 2021), "Brazil": (2017, 2018, 2019),
    "France": (2019, 2020, 2021), "Germany": (2019, 2020, 2021), "Greece": (2019, 2020, 2021), "India": (2020, None, 2021),
    "Ireland": (2019, 2020, 2021), "Italy": (2019, 2020, 2021), "Latvia": (2019, 2020, 2021), "Montenegro": (2019, 2020, 2021),
    "Portugal": (2019, 2020, 2021), "Russia": (2018, 2019, 2020), "Sweden": (2019, 2020, 2021), "Switzerland": (2019, 2020, 2021),
    "United Kingdom": (2016, 2017, 2018), "United States of America": (2012, 2013, 2014),
}


def split_by_years(df: DataFrame, group: str, date: str, years: Mapping[str, tuple[int, int | None, int]] = COUNTRY_YEARS) -> DataFrame:
    """MLP-1: column split by the group's years. Rows of other groups, and of years in between, have no split and vanish."""
    entry = F.create_map(*(x for g, (a, b, c) in years.items() for x in (F.lit(g), F.struct(F.lit(a).alias("a"), F.lit(b).cast("int").alias("b"), F.lit(c).alias("c")))))[F.col(group)]
    y = F.year(date)
    split = F.when(y <= entry["a"], "train").when(y == entry["b"], "valid").when(y >= entry["c"], "test")
    return df.withColumn("split", split).where("split is not null")


def split_by_entities(df: DataFrame, key: str, date: str, ordinal: str, share: float = 0.7, valid_until: str = "2022-05-01", test_from: str = "2022-06-01") -> DataFrame:
    """MLP-2, WIN-8: entities in order of first appearance (least ordinal); all rows of the first int(n * share) train, the others'
    validate up to a date and test from another.

    Places come from ranges of the first ordinals (`ranking.ranked`), so no task sorts all entities; of equal ones by key.
    """
    first, n = ranked(df.groupBy(F.col(key).alias("_key")).agg(F.min(ordinal).alias("_first")), ["_first", "_key"], "_rank")
    train = F.col("_rank") <= int(n * share)
    split = F.when(train, "train").when(F.col(date) <= F.lit(valid_until).cast("date"), "valid").when(F.col(date) >= F.lit(test_from).cast("date"), "test")
    out = df.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("split", split).where("split is not null").drop("_key", "_first", "_rank")


def reallocate(df: DataFrame, key: str, least: int = 24) -> DataFrame:
    """MLP-3, then MLP-4: entities with fewer than `least` training rows (but some) move all rows to training; then entities without
    training rows and with fewer than `least` (but some) validation rows do."""
    w = Window.partitionBy(key)
    n = lambda s: F.sum((F.col("split") == s).cast("int")).over(w)
    few = (n("train") > 0) & (n("train") < least)
    rest = (n("train") == 0) & (n("valid") > 0) & (n("valid") < least)
    return df.withColumn("split", F.when(few | rest, F.lit("train")).otherwise(F.col("split")))


def entity_scales(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation (of the population; 0 counts as 1) by entity from the first split of train, valid and test with over one row."""
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]
    by = df.groupBy(key, "split").agg(F.count(F.lit(1)).alias("_n"), *stats).where("_n > 1")
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    best = by.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_x"))
    return best.select(key, *(F.struct(F.col(f"_x.{c}.m").alias("m"), F.when(F.col(f"_x.{c}.s") == 0, 1.0).otherwise(F.col(f"_x.{c}.s")).alias("s")).alias(f"_s_{c}") for c in columns))


def standardise(df: DataFrame, key: str, columns: Sequence[str], suffix: str = "_plant_std") -> DataFrame:
    """MLP-5: columns with the suffix, by the scales of `entity_scales`. Where an entity has one row of a split, that row has none.

    All are windows by entity, so one exchange serves them and those of `reallocate` before.
    """
    w, order = Window.partitionBy(key), F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    counts = [F.count(F.when(order == k, 1)).over(w) for k in range(3)]
    out = df.withColumns({"_order": order, "_n": F.array(*counts)})
    out = out.withColumn("_best", F.when(F.col("_n")[0] > 1, 0).when(F.col("_n")[1] > 1, 1).when(F.col("_n")[2] > 1, 2))
    own = {c: F.when(F.col("_order") == F.col("_best"), F.col(c)) for c in columns}
    out = out.withColumns({f"{p}{c}": f(x).over(w) for c, x in own.items() for p, f in (("_m_", F.avg), ("_s_", F.stddev_pop))})
    scaled = {c + suffix: F.when(F.get("_n", F.col("_order")) > 1, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))) for c in columns}
    return out.withColumns(scaled).drop("_order", "_n", "_best", *(p + c for c in columns for p in ("_m_", "_s_")))


def standardise_with(df: DataFrame, fitted: DataFrame, key: str, columns: Sequence[str], suffix: str = "_plant_std") -> DataFrame:
    """MLP-6: an entity's fitted scales, or else those of its own rows here (one row gives 0)."""
    w = Window.partitionBy(key)
    out = df.join(fitted, key, "left").withColumns({f"{p}{c}": f(c).over(w) for c in columns for p, f in (("_m_", F.avg), ("_d_", F.stddev_pop))})
    own = {c: F.struct(F.col(f"_m_{c}").alias("m"), F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}")).alias("s")) for c in columns}
    scale = {c: F.coalesce(F.col(f"_s_{c}"), own[c]) for c in columns}
    return out.withColumns({c + suffix: (F.col(c) - scale[c]["m"]) / scale[c]["s"] for c in columns}).drop(*(p + c for c in columns for p in ("_s_", "_m_", "_d_")))


def within(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """FLT-12: rows of which all columns are within [-limit, limit]; a missing one drops the row."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).between(-limit, limit)
    return df.where(is_true(keep))


def inverse_frequency(df: DataFrame, group: str, entity: str, out: str = "weight") -> DataFrame:
    """AGG-15: 1 / (distinct entities of the group + 1e-8)."""
    n = df.groupBy(F.col(group).alias("_group")).agg((1 / (F.countDistinct(entity) + 1e-8)).alias(out))
    return df.join(n, F.col(group) == F.col("_group"), "left").drop("_group")


def prepare(panel: DataFrame, key: str, columns: Sequence[str], denied: Sequence[str] = (), capacity: str = "installed_capacity_mw", observed: str = "observed_generation_mw", least_capacity: float = 10, least_rows: int = 24, clip: Sequence[str] | None = None) -> DataFrame:
    """MLP-8: denylist, capacity, least rows, complete rows, capacity factor, reallocation, standardisation and limits, in this order."""
    df = panel.where(not_in(F.col(key), denied)).where(F.col(capacity) > least_capacity) if denied else panel.where(F.col(capacity) > least_capacity)
    df = drop_short_entities(df, key, least_rows).dropna(how="any")
    df = df.withColumn("capacity_factor", ratio(F.col(observed), F.col(capacity)))
    df = standardise(reallocate(df, key, least_rows), key, columns)
    return within(df, [f"{c}_plant_std" for c in (clip if clip is not None else columns)])
