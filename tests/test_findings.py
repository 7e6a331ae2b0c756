"""Queries on tables that the generated ones don't show at the smallest size, against their SQL."""

import math
import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.operators import boost, dense, features, history, learn, ranking, search
from tessera.plans import retrieval
from tessera.queries import QUERIES, SQL
from tessera.sources.adapters import pool

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


def with_tables(spark, folder, **changed):
    """SF's tables in the folder, some of them changed by a function."""
    for p in SF.glob("*.parquet"):
        if p.stem in changed:
            changed[p.stem](spark.read.parquet(str(p))).write.parquet(f"{folder}/{p.name}")
        else:
            os.symlink(p, Path(folder) / p.name)
    return str(folder)


def both(spark, name, folder):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_splits_without_queries_have_rows(spark, tmp_path):
    got, want = both(spark, "holdout_audit", with_tables(spark, tmp_path, part=lambda d: d.withColumn("p_name", F.lit("one name"))))
    assert got == want == [("ranker_train", 0, 0, 0, 0, 0, True), ("validation", 0, 0, 0, 0, 0, True)]


def test_no_pairs_have_no_fingerprint(spark, tmp_path):
    got, want = both(spark, "pair_audit", with_tables(spark, tmp_path, part=lambda d: d.withColumn("p_size", F.lit(7))))
    assert got == want and got[0][1] == 0 and got[0][4] is None


def test_asked_terms_have_the_weights_of_the_whole_index(spark):
    items = spark.createDataFrame([(1, "red car", "a red car and a boat"), (2, "blue boat", "boat boat house"), (3, "", "house of cards"), (4, None, None)], "item_id long, title string, description string")
    q = spark.createDataFrame([(1, "red boat"), (2, "cards of red cars")], "query_id long, text string")
    cfg, names, terms = search.SparseConfig(max_features=None, char_min_df=1, max_df=1.0), {"title": "title", "description": "description"}, search.query_terms(q)
    rows = lambda d: {(r["term"], r["item_id"]): round(r["w"], 9) for r in d.collect()}
    asked = {r["term"] for r in terms.collect()}
    for whole, part in ((search.fit_fields(items, names, cfg=cfg), search.fit_fields(items, names, cfg=cfg, asked=terms)), (search.fit_field_channel(items, "title"), search.fit_field_channel(items, "title", asked=terms))):
        assert rows(part) == {k: w for k, w in rows(whole).items() if k[0] in asked} and len(rows(part)) < len(rows(whole))
    whole, part = search.SparseRetriever(items, names, cfg=cfg), search.SparseRetriever(items, names, cfg=cfg, queries=q)
    for channel in ("word", "char", "hybrid"):
        a, b = (sorted(map(tuple, r.scores(q, channel).collect())) for r in (whole, part))
        assert a == b and a
    with pytest.raises(ValueError, match="max_features"):
        search.fit_fields(items, names, asked=terms)


def test_only_documents_with_enough_tokens_meet_the_passage(spark, tmp_path):
    docs = [(1, "bored  CART boat"), (2, "red cart boats"), (3, "red boat"), (4, "cart x red"), (5, "a red cart boat b"), (6, "x red Cart\nboat")]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red cart boat"), (2, "ed cart bo"), (7, "red"), (8, "Cart boat"), (9, "red cart boat sail wind")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got, want = both(spark, "literal_match", str(tmp_path))
    assert got == want
    assert {r[:2] for r in got if r[2]} >= {(1, 1), (1, 2), (1, 5), (1, 6), (2, 1)}
    near = retrieval._literal(spark, str(tmp_path), pool(spark, str(tmp_path)))
    assert {(r["query_id"], r["item_id"]) for r in near.collect()} & {(9, 3), (9, 4)} == set()


def test_features_take_what_is_known_of_an_items_text(spark):
    from test_pieces import pair

    p = pair(spark)
    known = p.withColumns({"description_coverage": F.lit(0.25), "exact_title": F.lit(False), "exact_description": F.lit(None).cast("boolean"), "title_tok": F.array(F.lit("red"))}).drop("description")
    r = features.base_features(known).first()
    assert (r["description_coverage"], r["exact_title"], r["exact_description"], r["title_tokens"], r["title_coverage"]) == (0.25, 0.0, 0.0, 1.0, 0.5)


def test_hashed_vectors_tokenise_once(spark):
    d = spark.createDataFrame([("red car",)], "t string").select(dense.hashed_vector(F.col("t"), 16).alias("v"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_mask_pairs_come_once_without_a_last_shuffle(spark):
    rows = [(0, 1, 7, 5), (0, 2, 7, 5), (0, 3, None, 5), (0, 4, None, 6), (1, 1, 7, 5)]
    d = dense.contrastive_mask(spark.createDataFrame(rows, "batch long, pos long, query_id long, item_id long"))
    assert sorted(map(tuple, d.collect())) == [(0, a, b) for a, b in ((1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2))]
    assert d._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Union")


def test_gradients_take_no_pairs_beyond_the_depth(spark):
    draw = random.Random(13)
    rows = [(q, i, round(draw.gauss(0, 2), 1), int(i % 5 < 2)) for q in range(2) for i in range(300)] + [(2, i, float(i), 0) for i in range(80)] + [(3, 0, 1.0, 1)]
    d = learn.lambdas(spark.createDataFrame(rows, "query_id long, item_id long, bm25 double, label int"), "bm25")
    got = {(r["query_id"], r["item_id"]): (r["lambda"], r["hessian"]) for r in d.collect()}
    assert len(got) == len(rows)
    for q in range(4):
        of = [r for r in rows if r[0] == q]
        g, h = boost.gradients(np.array([r[2] for r in of]), np.array([float(r[3]) for r in of]), boost.Settings())
        for i, r in enumerate(of):
            assert got[q, r[1]] == pytest.approx((g[i], h[i]), abs=1e-9)
    assert "Join Inner" not in d._jdf.queryExecution().optimizedPlan().toString()


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_counted_by_class_once(spark, tmp_path):
    folder = with_tables(spark, tmp_path, documents=lambda d: d.withColumn("doc_id", F.col("doc_id") % 50))
    got, want = both(spark, "nb_counts", folder)
    assert got == want  # also where rows share an id
    for name in ("nb_weights_multinomial", "nb_weights_complement", "class_recall_at_k"):
        assert "regexp_extract_all" not in optimized(QUERIES[name](spark, folder))
    assert optimized(QUERIES["nb_predict"](spark, folder)).count("regexp_extract_all") == 1


def test_quotas_bound_channels_before_the_shuffle(spark):
    rows = [(q, i, c, float(i % 7)) for q in range(2) for i in range(20) for c in "ab"]
    d = ranking.union_channels(spark.createDataFrame(rows, "query_id long, item_id long, channel string, score double"), {"a": 3, "b": 1})
    assert "WindowGroupLimit" in optimized(d)
    assert sorted((r["query_id"], r["item_id"], *r["channels"]) for r in d.collect()) == sorted((q, *x) for q in range(2) for x in ((6, "a", "b"), (13, "a"), (5, "a")))


def test_rows_beyond_all_quotas_are_left_out_by_counting(spark):
    draw = random.Random(26)
    rows = [(q, i, round(draw.expovariate(1), 3), draw.choice([None, 0, 1, 2, 500])) for q in range(3) for i in range(400)]
    s, columns, quotas = spark.createDataFrame(rows, "query_id long, item_id long, x double, y long"), {"a": "x", "b": "y"}, {"a": 9, "b": 150}
    few = ranking.within_quotas(s, columns, quotas)
    union = lambda d: sorted((r[0], r[1], *r[2]) for r in ranking.union_channels(features.long_channels(d, columns), quotas).collect())
    assert union(few) == union(s) and few.columns == s.columns and few.count() < 0.7 * len(rows)


def test_ranks_in_the_whole_list_by_counting(spark):
    draw = random.Random(20)
    rows = [(q, i, round(draw.choice([1e-7, 0.5, 1.0, 30.0]) * (q + 1) + draw.randint(0, 3) * 1e-4, 9)) for q in range(3) for i in range(200)] + [(3, 1, 2.0), (3, 0, 2.0), (4, 0, 0.0)]
    s = spark.createDataFrame(rows, "query_id long, item_id long, bm25 double")
    wanted = [(q, i) for q in range(3) for i in range(0, 200, 17)] + [(3, 1), (3, 9), (4, 0)]
    want = {(q, i): k for x in range(4) for k, (_, i, q) in enumerate(sorted((-v, i, q) for q, i, v in rows if q == x), 1) if (q, i) in wanted}
    d = ranking.ranks_of(s, spark.createDataFrame(wanted, "query_id long, item_id long"), "bm25")
    assert {(r["query_id"], r["item_id"]): r["rank"] for r in d.collect()} == want and len(want) == 37
    assert "Join LeftSemi" in optimized(d).split("Window [")[1]  # before its rows are put in order


def test_both_sides_of_a_comparison_take_their_best_rows_only(spark):
    assert optimized(QUERIES["paired_delta"](spark, str(SF))).count("WindowGroupLimit") >= 2


def test_grams_of_a_row_are_counted_where_they_are_made(spark, tmp_path):
    folder = with_tables(spark, tmp_path, part=lambda d: d.withColumn("p_partkey", F.col("p_partkey") % 7))
    got, want = both(spark, "char_ngrams", folder)
    assert got == want
    assert optimized(QUERIES["char_ngrams"](spark, folder)).count("RepartitionByExpression") == 1


def test_clicks_meet_neighbours_where_they_are_summed(spark):
    near = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0)], "text string, neighbour string, sim double")
    clicks = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("b", 2, 1), ("c", 3, 1), (None, 4, 1)], "text string, item_id long, n long")
    d = history.click_evidence(near, clicks)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    e = lambda n, f: f * math.log1p(n)
    want = {("a", 1): 1.3 * e(2, 1) + e(3, 0.3 * 0.5**5), ("a", 2): e(1, 0.3 * 0.5**5), ("b", 1): 1.3 * e(3, 1), ("b", 2): 1.3 * e(1, 1), ("c", 3): e(1, 1), (None, 4): e(1, 1)}
    assert {(r["text"], r["item_id"]): r["evidence"] for r in d.collect()} == pytest.approx(want)
