"""The queries that apply the operators to their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, conversations, embed_dedup, exact_dedup, hard_negatives, lm, packing, pieces, pii, quality, simhash, token_counts, toxicity
from tidewheel.llm.common import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 7) == 2
    model = lm.fit(docs.where(~held_out))
    found = lm.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _predicted(found: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), modulus) == remainder
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.where(bucket_of(F.col("doc_id"), 3) != 1), "quality")
    return _predicted(quality.score(docs, net), 3, 1, 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    tagger = toxicity.fit(docs, labels.where(bucket_of(F.col("doc_id"), 4) != 2), "toxic")
    return _predicted(toxicity.score(docs, tagger), 4, 2, 0.3)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


#: A demonstration key; a deployment passes its own secret.
PII_KEY = "demonstration"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY, count_col="n_entities")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(vectors, lambda i: i % 100 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the faults of op13's contract, by a checksum of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    role = F.when(fate == 4, "user").otherwise(text("role")).alias("role")
    words = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("_copy")
    return turns.select("conv_id", "turn", role, words, (fate != 0).alias("present"), copies)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(_table(spark, sf_dir, "conversations"))
    return conversations.repaired(turns, turns["present"], texts=False)[0]


QUERIES = {"op1_lm_score": op1_lm_score, "op2_quality": op2_quality, "op3_exact_dedup": op3_exact_dedup, "op4_packing": op4_packing, "op5_bpe": op5_bpe, "op6_embeddings": op6_embeddings, "op7_pii": op7_pii, "op8_token_counts": op8_token_counts, "op9_toxicity": op9_toxicity, "op10_simhash": op10_simhash, "op11_pieces": op11_pieces, "op12_hard_negatives": op12_hard_negatives, "op13_conversations": op13_conversations}

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.dst FROM reach JOIN links ON reach.other = links.src),
        degree AS (SELECT src, count(*) AS n FROM links GROUP BY src)
        SELECT reach.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = reach.vec_id AS kept
        FROM reach LEFT JOIN degree ON src = reach.vec_id GROUP BY reach.vec_id
    """,
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
              FROM v a JOIN v ON a.vec_id <> v.vec_id AND a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
    """,
}
