"""Queries against every item where the items are: blocks, quotas and counted windows give what whole tables give."""

from pathlib import Path

import numpy as np
import pytest

from tessera.operators import blocks, ranking
from tessera.plans import candidates

SF = "/root/testdata/sf0.001"


def test_a_task_keeps_the_best_of_each_query_with_ties_to_smaller_items(monkeypatch):
    monkeypatch.setattr(blocks, "SPARE", 5)
    rng = np.random.default_rng(1)
    s, ids = rng.integers(-2, 4, (200, 3)).astype(float), rng.permutation(200)
    held = blocks._Quota(3, 7)
    for at in range(0, 200, 11):
        held.add(ids[at : at + 11], s[at : at + 11])
    q, score, item = held.cut()
    for n in range(3):
        want = sorted((-s[a, n], ids[a]) for a in range(200) if s[a, n] > 0)[:7]
        assert [(-x, i) for x, i in zip(score[q == n], item[q == n], strict=True)] == want


def test_counted_windows_are_those_of_whole_lists(spark):
    rows = [(1, i, float(i % 9), None if i % 13 == 0 else float(i)) for i in range(120)] + [(2, 1, float("nan"), -0.0), (2, 2, 0.0, 0.0), (3, 5, 1.0, float("inf"))]
    d = spark.createDataFrame(rows, "query_id long, item_id long, a double, b double")
    got, want = (f(d, ["a", "b"]).drop("a", "b") for f in (ranking.augment_counted, ranking.augment))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_no_pair_is_written_before_it_is_chosen_and_blocks_change_nothing(spark, monkeypatch):
    whole = sorted(map(tuple, candidates.features_of(spark, SF).select("query_id", "item_id", "bm25", "geo_dense", "history_click", "pool_percentile_dense").collect()))
    monkeypatch.setattr(blocks, "BLOCK", 2)
    monkeypatch.setattr(blocks, "PAIRS", 64)
    world = candidates.World(spark, SF)
    assert {f.name for f in world.items.schema} == {*candidates.COLUMNS, "vector", "postings"} and world.items.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    monkeypatch.setattr(candidates, "World", lambda *a: world)
    got = sorted(map(tuple, candidates.features_of(spark, SF).select("query_id", "item_id", "bm25", "geo_dense", "history_click", "pool_percentile_dense").collect()))
    assert [r[:2] for r in got] == [r[:2] for r in whole] and np.allclose([r[2:] for r in got], [r[2:] for r in whole], atol=1e-9)


def test_hybrid_scores_of_blocks_are_those_of_tables_and_pairs_are_not_sent(spark, monkeypatch):
    from tessera.operators import search

    monkeypatch.setattr(blocks, "BLOCK", 2)
    texts = [(i, f"word{i % 4} red lamp" if i % 3 else "", f"en src{i % 2}", " ".join(["word1 red", "lamp blue", "word2"][: i % 4])) for i in range(30)]
    items = spark.createDataFrame(texts, "item_id long, title string, params string, description string")
    queries = spark.createDataFrame([(1, "red lamp blue"), (2, "lamp word2 en"), (3, "absent"), (4, "redder lamps")], "query_id int, text string")
    cfg, three = search.SparseConfig(max_features=None, description_chars=None), {n: n for n in ("title", "params", "description")}
    asked, whole = (search.SparseRetriever(items, three, cfg=cfg, queries=q).scores(queries, "hybrid") for q in (queries, None))
    got, want = ({(r["query_id"], r["item_id"]): r["score"] for r in d.where("score > 0").collect()} for d in (asked, whole))
    assert got == want and {q for q, _ in got} == {1, 2, 4}
    assert "Exchange" not in asked._jdf.queryExecution().executedPlan().toString()


def test_base_features_meets_items_once_and_rounds_without_decimals(spark, tmp_path):
    from tessera.queries import QUERIES, SQL

    docs = [(i, ["red lamp shines", "a red lamp", "blue Red  lamp blue", "", "lamp"][i % 5] + f" w{i}", "en", f"src{i % 3}", 10 + i) for i in range(40)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", [(0, "red lamp"), (3, "lamp w7 lamp"), (5, "none")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    d = QUERIES["base_features"](spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "Window" not in plan and plan.count("n_chars") > 0
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(SQL["base_features"]).fetchall()
    assert sorted(map(tuple, d.collect())) == sorted(want) and want
