"""Boosted trees against plain greedy growth, stored models, stages."""

import heapq
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boost, learn
from tessera.plans import models
from tessera.sources.io import kept

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = []
    for q in range(30):
        for i in range(40):
            a, b, c = draw.gauss(0, 1), draw.choice([None, float("nan"), 0.0, 1.0, 2.0]), float(i % 5)
            good = a + (b if b and b == b else 0) + draw.gauss(0, 0.3) > 2.2
            out.append((q, q * 100 + i, int(good), a, b, c))
    return out


@pytest.fixture(scope="module")
def pool(spark, rows):
    return kept(spark.createDataFrame(rows, "query_id long, item_id long, label int, a double, b double, c double").repartition(3))


def binned(rows, edges):
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows], float)
    return np.column_stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(np.array(e), x[:, i], side="left")) for i, e in enumerate(edges.values())])


def plain_tree(bins, g, h, s):
    """[(path, feature, bin)] of a tree grown by the best gain first, in the order of the splits."""
    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in range(s.max_bin):
                left = rows[bins[rows, f] <= b]
                if len(left) < s.least_rows or len(rows) - len(left) < s.least_rows:
                    continue
                gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                gain = round(gl**2 / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt**2 / (ht + s.l2), 9)
                if gain > s.least_gain and (found is None or (gain, -f, -b) > found[0]):
                    found = ((gain, -f, -b), f, b, left, rows[bins[rows, f] > b])
        return found

    heap, out, leaves, n = [], [], 1, 0
    def push(path, rows):
        nonlocal n
        x = best(rows) if len(path) < s.depth else None
        if x:
            n += 1
            heapq.heappush(heap, (-x[0][0], n, path, x))
    push("", np.arange(len(g)))
    while heap and leaves < s.leaves:
        _, _, path, x = heapq.heappop(heap)
        out.append((path, x[1], x[2]))
        leaves += 1
        push(path + "L", x[3])
        push(path + "R", x[4])
    return sorted(out)


def paths(tree):
    at, out = {0: ""}, []
    for k, f in enumerate(tree.feature):
        if f >= 0:
            at |= {tree.left[k]: at[k] + "L", tree.right[k]: at[k] + "R"}
            out.append((at[k], f, tree.at[k]))
    return sorted(out)


@pytest.mark.parametrize("objective,leaves,depth", [("lambdarank", 9, 5), ("logistic", 31, 3), ("logistic", 6, 9)])
def test_a_tree_is_the_greedy_one(spark, pool, rows, objective, leaves, depth):
    s = boost.Settings(objective, leaves=leaves, depth=depth, least_rows=20, max_bin=16)
    edges = boost.bin_edges(pool, NAMES, 16)
    state = boost._advance(boost.pack(pool, edges), "query_id", s, 3, None).cache()
    tree, known = boost._grow(state, s, 3, 16)
    bins, g, h = binned(rows, edges), [], []
    for q in range(30):
        label = np.array([r[2] for r in rows if r[0] == q], float)
        gq, hq = boost.gradients(np.zeros(len(label)), label, s)
        g += list(gq)
        h += list(hq)
    assert paths(tree) == plain_tree(bins, np.array(g), np.array(h), s)
    assert sum(known[k][1] for k, f in enumerate(tree.feature) if f < 0) == len(rows)
    place = tree.place(bins)
    for k, f in enumerate(tree.feature):
        if f < 0:
            assert tree.value[k] == pytest.approx(np.array(g)[place == k].sum() / (np.array(h)[place == k].sum() + s.l2), abs=1e-9)


def test_gradients_are_those_of_the_joined_pairs(pool):
    p = pool.where("query_id < 5").withColumn("score", F.col("a"))
    want = {(r["query_id"], r["item_id"]): (r["lambda"], r["hessian"]) for r in learn.lambdas(p).collect()}
    for q in range(5):
        d = p.where(F.col("query_id") == q).orderBy("item_id").toPandas()
        g, h = boost.gradients(d["a"].to_numpy(), d["label"].to_numpy(float), boost.Settings())
        for i, item in enumerate(d["item_id"]):
            assert want[q, item] == pytest.approx((g[i], h[i]), abs=1e-9)


def ndcg(scored):
    total, n = 0.0, 0
    for q in {r["query_id"] for r in scored}:
        mine = sorted((r for r in scored if r["query_id"] == q), key=lambda r: (-r["score"], r["item_id"]))
        good = int(sum(r["label"] for r in mine))
        if good:
            total += sum(r["label"] / math.log2(k + 2) for k, r in enumerate(mine)) / sum(1 / math.log2(k + 2) for k in range(good))
            n += 1
    return total / n


@pytest.fixture(scope="module")
def model(pool):
    return boost.train(pool, NAMES, boost.Settings(rounds=5, leaves=15, least_rows=10, rate=0.5))


def test_more_rounds_rank_better_and_beat_the_small_trees(pool, model):
    full = ndcg(boost.score(pool, model).collect())
    flat = kept(pool.fillna(0.0).withColumn("label", F.col("label").cast("double")))
    old = ndcg(learn.score_lambda(learn.train_lambda(flat, NAMES, rounds=2, depth=2, keep=kept), flat, NAMES).collect())
    assert full > ndcg(boost.score(pool, boost.truncated(model, 1)).collect()) - 1e-9 and full > old and full > 0.9


def test_expression_and_walk_give_the_same_scores(pool, model):
    model = boost.truncated(model, 2)
    at = lambda n, staged: {r["item_id"]: r["score"] for r in boost.score(pool, model, staged=staged, column_nodes=n).collect()}
    for staged in (False, True):
        assert at(10**9, staged) == at(0, staged)
    last = at(0, False)
    assert all(v[-1] == pytest.approx(last[k]) and len(v) == 2 for k, v in at(0, True).items())


def test_a_stored_model_is_the_same_in_a_new_reading_and_tampering_raises(spark, pool, model, tmp_path):
    at = f"file://{tmp_path}/m"
    boost.save(spark, model, at)
    again = boost.load(spark, at, NAMES)
    assert again.nodes == model.nodes and again.settings == model.settings
    assert boost.score(pool, again).select("item_id", "score").exceptAll(boost.score(pool, model).select("item_id", "score")).count() == 0
    with pytest.raises(ValueError, match="other features"):
        boost.load(spark, at, ["a", "b"])
    t = model.table(spark).withColumn("value", F.when(F.col("tree") == 2, F.col("value") + 1e-9).otherwise(F.col("value")))
    t.coalesce(1).write.mode("overwrite").parquet(f"{at}/nodes")
    with pytest.raises(ValueError, match="manifest"):
        boost.load(spark, at)
    boost.save(spark, model, at)
    spark.createDataFrame([(json.dumps(model.manifest() | {"n_nodes": 1}),)], "value string").write.mode("overwrite").text(f"{at}/manifest")
    with pytest.raises(ValueError):
        boost.load(spark, at)


def test_stages_and_patience(spark):
    r = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5), (4, 0.4), (5, 0.4), (6, 0.9)], "stage long, recall double")
    assert tuple(boost.best_stage(r).first()) == (6, 0.9)
    assert tuple(boost.best_stage(r, patience=3).first()) == (2, 0.5)
    assert tuple(boost.best_stage(r, patience=5).first()) == (6, 0.9)


def test_recall_by_stage(spark):
    s = spark.createDataFrame([(1, 1, [0.0, 2.0]), (1, 2, [1.0, 1.0]), (2, 3, [0.0, 0.0]), (2, 4, [0.0, 1.0])], "query_id long, item_id long, score array<double>")
    t = spark.createDataFrame([(1, 1), (1, 1), (2, 3), (3, 9)], "query_id long, item_id long")
    got = {r["stage"]: r["recall"] for r in boost.staged_recall(s, t, 1).collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 1 / 3})  # first only query 2's tie, then only query 1


def test_nothing_to_learn_from(spark):
    p = spark.createDataFrame([(1, i, 0, float(i), 0.0, 0.0) for i in range(5)], "query_id long, item_id long, label int, a double, b double, c double")
    m = boost.train(p, NAMES, boost.Settings(rounds=2))
    assert {r["score"] for r in boost.score(p, m).collect()} == {0.0}
    assert boost.train(p.limit(0), NAMES, boost.Settings(rounds=1)).nodes[0][2] is None


def test_the_registry_keeps_the_best_and_its_stage(spark, pool):
    t = pool.where("label > 0").select("query_id", "item_id")
    variants = {"weak": boost.Settings(rounds=1, leaves=2, least_rows=10), "strong": boost.Settings(rounds=3, leaves=15, least_rows=10, rate=0.3)}
    found = {n: models.fitted(pool, t, s, NAMES, F.col("query_id") % 3 == 0, 5) for n, s in variants.items()}
    assert boost.choose(found) == "strong"
    assert len(found["strong"].trees()) == found["strong"].metrics["trees"] <= 3


def test_answers_of_two_models_hold_legal_items_only(spark, pool, model):
    legal = pool.where("item_id % 2 = 0").select("item_id")
    out = models.blended_answers(pool, model, boost.truncated(model, 2), legal, 0.9, 7).collect()
    assert len(out) == 30 and all(len(r["answer"].split()) == 7 and all(int(i) % 2 == 0 for i in r["answer"].split()) for r in out)
