"""Queries over whole tables, against plain Python on a small fixture."""

import math
from collections import Counter
from pathlib import Path

import pytest

import tessera.plans  # noqa: F401
from tessera.operators import search
from tessera.queries import QUERIES

#: Planted in 70 documents, more than a pool holds; only every third document has a label.
PASSAGE = "violet harbour lantern"
DOCS = [(i, f"word{i % 7} {PASSAGE} word{i % 5} " + "filler " * (i % 9) if i < 70 else f"word{i % 7} apart{i}" + " violet" * (i == 71), "en", f"src{i % 5}", 10 + i) for i in range(90)]
DOCS.append((500, "deep " * 700 + "quartz meadow", "fr", "src9", 3600))
BENCH = [(0, PASSAGE), (25, "quartz meadow"), (31, "apart72 word1 unknown"), (32, "absent")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    vectors = [(i, [math.cos(i * 0.7), math.sin(i * 0.7)]) for i in range(130)]
    for name, rows, schema in (
        ("documents", DOCS, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", BENCH, "item_id long, text string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>"), ("labels", [(i, 1, 0) for i in range(0, 90, 3)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def sharing():
    return {(q, i) for q, p in BENCH for i, t, *_ in DOCS if set(p.split()) & set(t.split())}


def test_coverage_of_all_pairs_that_share_a_token(spark, sf):
    got = {(r["item_id"], r["doc_id"]): r["coverage"] for r in QUERIES["feature_coverage"](spark, sf).collect()}
    texts, passages = {i: set(t.split()) for i, t, *_ in DOCS}, {q: set(p.split()) for q, p in BENCH}
    assert got == {(q, i): round(len(passages[q] & texts[i]) / len(passages[q]), 6) for q, i in sharing()}
    assert (25, 500) in got


def test_dense_queries_come_from_all_rows(spark, sf):
    got = {}
    for r in QUERIES["dense_top10"](spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    assert sorted(got) == [0, 20, 40, 60, 80, 100, 120]
    for q, rows in got.items():
        best = sorted((math.cos((i - q) * 0.7) for i in range(130)), reverse=True)[:10]
        assert all(abs(s - b) < 2e-5 for (_, s), b in zip(sorted(rows), best, strict=True))


def test_pairs_that_share_a_term_are_all_scored(spark, sf):
    got = {(r["query_id"], r["item_id"]): r["score"] for r in QUERIES["score_pairs"](spark, sf).collect()}
    assert {(q, i) for q, i in sharing() } <= got.keys() and all(s > 0 for s in got.values())


def test_operators_see_documents_beyond_the_pool(spark, sf):
    legal = [r["item_id"] for r in QUERIES["legal_top50"](spark, sf).where("query_id = 0").collect()]
    assert sorted(legal) == list(range(0, 70, 3))
    answers = {r["query_id"]: r["answer"].split() for r in QUERIES["answer_rows"](spark, sf).collect()}
    assert sorted(map(int, answers[0])) == sorted(legal)
    ceiling = QUERIES["candidate_ceiling"](spark, sf).first()
    assert (ceiling["n_queries"], ceiling["ceiling"]) == (2, 1.0)
    tags = {r["item_id"]: r["tags"].split(",") for r in QUERIES["error_tags"](spark, sf).where("query_id = 0").collect()}
    assert len(tags) == 70 and sum("close_rank" in t for t in tags.values()) == 20 and not any("candidate_miss" in t for t in tags.values())
    counts = {r["tag"]: r["n"] for r in QUERIES["error_tag_counts"](spark, sf).collect()}
    assert counts["close_rank"] == 20 and "candidate_miss" not in counts
    tiers = [r["tier"] for r in QUERIES["history_reservation"](spark, sf).where("query_id = 0").collect()]
    assert len(tiers) == 50 and tiers.count(0) == 25
    union = {(r["query_id"], r["item_id"]): r["channels"].split() for r in QUERIES["candidate_union"](spark, sf).collect()}
    assert union.keys() == sharing() and {c for v in union.values() for c in v} == {"word", "coverage", "length"}


def test_deep_passages_and_rare_terms_stay_in_the_index(spark, sf):
    for name in ("bm25_fielded", "bm25_hybrid"):
        assert [r["item_id"] for r in QUERIES[name](spark, sf).where("query_id = 25").collect()] == [500]
    d = spark.createDataFrame([(i, f"common t{i}") for i in range(4)] + [(4, "other")], "item_id long, text string")
    few, all_ = ({r["term"] for r in search.fit_fields(d, {"description": "text"}, cfg=search.SparseConfig(max_features=n)).collect()} for n in (2, None))
    assert len(few) == 2 and {f"w:t{i}" for i in range(4)} | {"w:common", "w:other"} <= all_


def test_class_counts_leave_no_document_out(spark, sf):
    got = {(r["class"], r["term"]): r["c"] for r in QUERIES["nb_counts"](spark, sf).collect()}
    assert got == Counter((lang, w) for _, t, lang, *_ in DOCS for w in t.split())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_texts_with_any_event_are_not_cold(spark):
    at = "/root/testdata/sf0.001"
    parts, bought = spark.read.parquet(f"{at}/part.parquet").select("p_partkey", "p_name").collect(), {r[0] for r in spark.read.parquet(f"{at}/lineitem.parquet").select("l_partkey").distinct().collect()}
    known = {name for key, name in parts if key in bought}
    assert {(r["item_id"], r["cold"]) for r in QUERIES["cold_flags"](spark, at).collect()} == {(key, name not in known) for key, name in parts}
