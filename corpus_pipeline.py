"""The corpus pipeline: stages that each take documents and hand on what they keep."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import exact_dedup, packing, pii, quality, simhash
from tidewheel.llm.common import bucket_of, delete, scratch, staged
from tidewheel.llm.queries import PII_KEY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more); labels of held-out documents aren't learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket_of(F.col("doc_id"), 3) != 1)
    return quality.keep_good(docs, quality.fit(docs, labels, "quality"), 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, found by fingerprints of their words, the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs, seeds=6, max_bits=3, words=5, similarity=0.8)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets; the count of characters, if there is one, follows the new text."""
    out = pii.replace_entities(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("pii", replace_private), ("packing", pack)]

#: A trained network, SimHash, keyed hashes and tokenisation are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what a stage staged for itself, and the result before, are then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = staged(stage(spark, docs, sf_dir), name)
            kept = made.pop()
        delete(spark, before)
        before = [kept]
    return docs
