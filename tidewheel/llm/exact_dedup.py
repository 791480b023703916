"""Exact deduplication: 128-bit content hash groups, with bytes compared inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import drop_keys, salt, sized_semi_join, staged, texts_of


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Only (id, hash) rows are grouped over the whole input; texts move only for hashes that have
    more than one row, where grouping by (hash, text) compares the bytes. If a hash turns out to
    hold different texts, its rows are grouped by the text itself.

    keep: which id of a group stays, "smallest" or "largest". A null text is the empty one; a null
    id is kept only if its group has no other; of repeated rows with one id exactly one is kept;
    an empty table gives an empty result; further columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    keyed = texts_of(docs, id_col, text_col).select("doc_id", "text", key(F.col("text")).alias("h"))
    rows = staged(keyed.groupBy("h", "doc_id").agg(F.count("*").alias("n"), F.min(F.sha2("text", 256)).alias("sha")).withColumn("salt", salt(F.col("doc_id"))), "hashes")
    part = rows.groupBy("h", "salt").agg(F.sum("n").alias("n"), best("doc_id").alias("keep_id"))
    groups = staged(part.groupBy("h").agg(F.sum("n").alias("size"), best("keep_id").alias("keep_id"), F.collect_list("salt").alias("salts")), "groups")

    many = staged(groups.where("size > 1").select("h"), "shared")
    same = sized_semi_join(keyed, many, ["h"]).groupBy("h", "text").agg(F.count("*").alias("size"), best("doc_id").alias("keep_id"))
    collided = staged(same.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "collided")
    spread = groups.select("h", "size", "keep_id", F.explode("salts").alias("salt"))
    found = rows.join(spread, ["h", "salt"]).select("doc_id", "keep_id", "size", "n", "sha", "h")
    if not collided.isEmpty():
        clash = sized_semi_join(keyed, collided, ["h"])
        exact = clash.groupBy("h", "text", "doc_id").agg(F.count("*").alias("n")).join(clash.groupBy("h", "text").agg(F.count("*").alias("size"), best("doc_id").alias("keep_id")), ["h", "text"])
        found = found.join(collided, "h", "left_anti").unionByName(exact.select("doc_id", "keep_id", "size", "n", F.sha2("text", 256).alias("sha"), "h"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows that exact_duplicates drops, all columns as they are.

    Of repeated rows with one id and text, one stays.
    """
    decided = exact_duplicates(docs, id_col, text_col, keep).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept")
    return drop_keys(docs, {"doc_id": docs[id_col], "sha": F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))}, decided)
