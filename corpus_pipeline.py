"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Every stage but the last returns the columns of ``documents``: language
identification drops documents without an identified language, the quality
classifier those it rejects, near-dedup all but one of each group; the rest is packed.

Null ids and texts, repeated rows, texts of any length, empty tables and further columns are
defined for every stage, in its docstring and its operator's.
"""

from __future__ import annotations

import public_tokenizers as tokenizers_files
from pyspark.sql import DataFrame, SparkSession

from oreline.llm import langid, packing, quality, simhash
from oreline.llm.common import fresh_path, remove, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language: not null, with a letter, and not shuffled bytes. Ids play no part; repeated rows fare alike."""
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose posterior of being good is a half or more. Null texts have their site's alone; repeated rows and null ids are judged like any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies (five words, similarity 0.8). Decided by row: rows with one id and unlike texts all stay, of rows with
    one id and one text one stays, and a null id is an id like any other, after all others. Null and empty texts are copies of each other."""
    return simhash.one_of_each_group(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of at most 2048 tokens, in sequences. Null texts are empty, which is a piece of one token; repeated rows and null ids are packed like any other."""
    return packing.pack_documents(docs, tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL neither learns, fingerprints nor tokenizes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``. What a stage wrote is deleted once the next has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
