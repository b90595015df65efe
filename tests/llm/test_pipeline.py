"""The pipeline's stages, each on its own input, and the whole."""

import zlib

import corpus_pipeline
import pytest

from oreline.llm import queries as llm

STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert list(STAGES) == ["language_id", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]


def test_whole_run(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == DOCUMENTS and out.count() <= docs.count()
            assert out.exceptAll(docs).count() == 0  # rows are kept as they were
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out
    want = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, data).collect()} == want


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_and_empty_input(spark, data, odd_docs, no_docs, name):
    out = STAGES[name](spark, odd_docs, data)
    assert out.count() > 0
    if name != "best_fit_packing":
        assert out.columns == odd_docs.columns
    assert STAGES[name](spark, no_docs, data).count() == 0


def test_clean_documents_stay(spark):
    """Labelled good documents pass both filters; of copies exactly one stays."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = STAGES["quality_classifier"](spark, STAGES["language_id"](spark, docs, d), d)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    left = STAGES["simhash_near_dedup"](spark, docs, d)
    assert left.count() == left.select("text").distinct().count()
    assert left.select("text").distinct().count() >= 0.95 * docs.select("text").distinct().count()


def test_queries_are_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)) and "pipeline" in q
    assert set(llm.ORACLE_SQL) <= set(llm.QUERIES) <= set(q)


def test_contract_columns(spark, data):
    want = {
        "op1_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op2_": ["doc_id", "fingerprint", "component_id"],
        "op3_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op4_": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_": ["query_id", "rank", "vec_id", "score"],
        "op6_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op8_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op9_": ["query_id", "rank", "vec_id", "score"],
        "op10_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    }
    for prefix, columns in want.items():
        name = next(k for k in llm.QUERIES if k.startswith(prefix))
        out = llm.QUERIES[name](spark, data)
        assert set(columns) <= set(out.columns), name
    assert zlib.crc32(b"") == 0
