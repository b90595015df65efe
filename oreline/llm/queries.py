"""The queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers as tokenizers_files
from pyspark.sql import DataFrame, SparkSession

from oreline.llm import ann, bpe, classlm, langid, packing, quality, simhash, token_counts, topk, warc
from oreline.llm.common import held_out, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizers_files.path("byte_bpe_50k.tiktoken"), tokenizers_files.PATTERN, with_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), held_out=held_out("doc_id", 5))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizers_files.path("piece_bpe_32k.model"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.best(table(spark, sf_dir, "embeddings"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    model = classlm.learn(docs.where("not held_out"))
    return classlm.score(docs, model)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_simhash, op3_best_fit_packing, op4_language, op5_nearest, op6_warc, op7_quality, op8_token_counts, op9_top_k, op10_class_lm)}

#: The others can't be expressed in SQL; tests hold them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             r AS (SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM r""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
