"""Product codebooks against Lloyd's rounds without bounds."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """[(vec_id, label, code, error)] and the codebooks, from all distances in whole numbers."""
    kept = [(k, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts)) * parts
    kept = [(k, lab, v + [0] * (dim - len(v))) for k, lab, v in kept]
    seeds = sorted((k, v) for k, _, v in kept if k is not None)[:entries]
    w = dim // parts
    books = [[v[p * w : (p + 1) * w] for _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((far(v[p * w : (p + 1) * w], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(p, v)[1] for p in range(parts)] for _, _, v in kept]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for (_, _, v), a in zip(kept, own, strict=True) if a[p] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for k, lab, v in kept:
        best = [near(p, v) for p in range(parts)]
        out.append((k, lab, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    return out, books


def clusters(n, dim, seed=3):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    return [(i * 3 % 1001, [m + draw.gauss(0, 0.05) for m in draw.choice(middle)], draw.choice([None, 1, 2])) for i in range(n)]


def told(out):
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("entries,rounds", [(64, 2), (5, 7), (200, 1)])
def test_bounds_change_nothing(spark, entries, rounds):
    rows = clusters(400, 32) + clusters(30, 32)  # the last ones repeat
    out, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries, rounds=rounds)
    want, plain_books = plain(rows, entries=entries, rounds=rounds)
    assert told(out) == sorted(want, key=str) and books.books.tolist() == plain_books


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, (32, 4))
    x = np.repeat(middle, 50, axis=0) + rng.integers(-20, 20, (1600, 4))
    now = codes._Round.of(middle[None])
    a, u, low = codes._assign(x, middle)
    moved = middle + 1
    then = codes._Round.of(moved[None], now)
    assert codes._reassign(x, a, u, low, moved, then.half[0], then.near[0], then.move[0]) < len(x) * 31 / 20
    assert (a == codes._squares(x, moved).argmin(axis=1)).all()


def test_odd_vectors(spark):
    rows = [
        (5, [0.1, -0.2, 0.3], 1), (5, [0.1, -0.2, 0.3], 1), (None, [0.5] * 20, None), (2, None, 1), (3, [0.1, None], 1), (4, [float("nan")], 1), (6, [float("inf")], 2),
        (7, [], 2), (8, [0.25] * 40, None), (1, [0.25] * 40, 3), (9, [-1e-9], 3),
    ]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS __row", "vec_id AS code", "'e' AS error", "7 AS `a.b`")
    out, books = codes.compress(d)
    want, plain_books = plain(rows)
    assert told(out) == sorted(want, key=str) and books.books.tolist() == plain_books
    assert out.columns == ["vec_id", "label", "__row", "a.b", "code", "error"] and {r["__row"] for r in out.collect()} == {"mine"}
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [3e38], 1)], SCHEMA))


def test_only_vectors_without_a_key_and_none_at_all(spark):
    out, _ = codes.compress(spark.createDataFrame([(None, [0.5] * 16, 1)], SCHEMA))
    assert told(out) == [(None, 1, "00" * 16, 0)]  # the zeros it starts from have moved to it
    out, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and books.dim == 16


def test_decoding_is_near(spark):
    rows = clusters(200, 32)
    out, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    seen = {i: v for i, v, _ in rows}
    for r in codes.decode(out, books).collect():
        gap = sum((a - b) ** 2 for a, b in zip(r["vector"], seen[r["vec_id"]], strict=True))
        assert math.sqrt(gap) < 0.5 and abs(math.sqrt(gap) - math.sqrt(r["error"]) / 256) < 0.05


def test_the_query(spark, tmp_path):
    rows = [*clusters(300, 64), (2000, None, None), (2001, [float("nan")] * 64, 1)]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op12_elkan_codes(spark, str(tmp_path)).collect()
    want, books = plain(rows)
    by = {}
    for _, lab, _, e in want:
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    assert sorted(map(tuple, got)) == sorted((k, c, e, by[lab], sha) for k, lab, c, e in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(codes.SQL).fetchall()) == sorted(map(tuple, got))
