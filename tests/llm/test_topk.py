import numpy as np
import pytest

from tessera.llm import topk


def brute(rows, k):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(64 * x)) for x in v]
            vec[i] = min(vec.get(i, q), q)
    out = set()
    for i, v in vec.items():
        if i % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in vec.items() if j != i))[:k]
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8) / 3], 0) for i in range(90)]
    rows += [(200 + i, rows[3][1], 0) for i in range(30)] + [(500, None, 0), (501, [float("nan")] * 8, 0), (502, [None] * 8, 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    got = {tuple(x) for x in topk.top_k(rows_of(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute([(a, b) for a, b, _ in rows], 20)


def test_few_candidates_and_none(spark):
    rows = [(0, [0.5, 1.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)]
    got = {tuple(x) for x in topk.top_k(rows_of(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute([(a, b) for a, b, _ in rows], 20)
    assert topk.top_k(rows_of(spark, [])).count() == 0


def test_large_components_are_exact_or_named(spark):
    rows = [(0, [3e7, -1.0], 0), (1, [1e7, 5.0], 0), (20, [-3e7, 1e7], 0)]
    assert {tuple(x) for x in topk.top_k(rows_of(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()} == brute([(a, b) for a, b, _ in rows], 20)
    for x in (1e9, 3e38):
        with pytest.raises(ValueError, match="scale them down"):
            topk.top_k(rows_of(spark, [(0, [x, x], 0), (1, [x, 1.0], 0)]))


def test_several_blocks_and_names_of_the_caller(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4 if i % 7 else 9)], 0) for i in range(150)]
    d = rows_of(spark, rows).selectExpr("*", "1 AS id", "'x' AS v", "2 AS tau", "3 AS b")
    got = {tuple(x) for x in topk.top_k(d, k=5).select("query_id", "rank", "vec_id", "score").collect()}
    wide = [(i, v + [0.0] * (9 - len(v))) for i, v, _ in rows]
    assert got == brute(wide, 5)
