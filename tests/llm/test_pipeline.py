from pathlib import Path

import pytest

import corpus_pipeline
from tessera.llm import bpe, lines, minhash, mixing, quality


def test_stages_keep_columns_and_follow_their_operators(spark, docs, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_round_trip"]
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    cut = corpus_pipeline.line_dedup(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r["doc_id"] for r in near.collect()} == {r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert corpus_pipeline.mix_sources(spark, docs, "").count() == mixing.mix(docs).count()
    assert corpus_pipeline.bpe_round_trip(spark, docs, "").columns == [*docs.columns, "ids", "decoded"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_run_gives_library_ids(spark):
    t = bpe.tokenizer(bpe.vocabulary_path())
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").limit(40).collect()
    assert rows and all(r["ids"] == t.encode(r["text"], add_special_tokens=False).ids for r in rows)
