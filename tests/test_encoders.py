"""Pairs, epochs, encoders and bundles against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, encode, pairs

EVENTS = [(f"  Red  LAMP{' ' * (i % 2)}", i % 9) for i in range(40)] + [("blue lamp", 3), ("Straße", 4), ("STRASSE", 4), ("blue lamp", 3)]
ITEMS = [(i, f"item {i}") for i in range(9)] + [(3, "another")]


def frames(spark, events=EVENTS, items=ITEMS):
    return spark.createDataFrame(events, "text string, item_id long"), spark.createDataFrame(items, "item_id long, item_text string")


def test_pairs_against_plain_python(spark):
    got = pairs.prepare_pairs(*frames(spark), cap=5, seed=3)
    norm = lambda t: " ".join(t.casefold().split())
    groups, texts = {}, {}
    for t, i in EVENTS:
        groups.setdefault(norm(t), {}).setdefault(i, set()).add(t)
    for i, t in ITEMS:
        texts[i] = min(t, texts.get(i, t))
    order = lambda n, i: (hashlib.md5(f"{n}\t{i}|3".encode()).hexdigest(), f"{n}\t{i}")
    want = {(n, min(s), i, texts[i]) for n, of in groups.items() for i, s in sorted(of.items(), key=lambda x: order(n, x[0]))[:5]}
    assert {tuple(r) for r in got.pairs.select("query_norm", "query_text", "item_id", "item_text").collect()} == want
    row = got.stats.first().asDict()
    assert (row["input_rows"], row["pairs"], row["query_texts"], row["cap"]) == (44, 7, 3, 5) and not any(row[k] for k in pairs.FAULTS)
    keys = sorted(f"{n}\t{i}" for n, _, i, _ in want)
    assert row["fingerprint"] == hashlib.sha256("\n".join(keys).encode()).hexdigest()


@pytest.mark.parametrize(
    "events, items, held, cold, said",
    [
        (EVENTS, ITEMS, [(3,)], [("green",)], "'held_overlap': 2"),
        (EVENTS, ITEMS, [(77,)], [(" straße ",)], "'cold_overlap': 1"),
        ([*EVENTS, (None, 1), ("  ", 1)], ITEMS, [], [], "'empty_queries': 1"),
        (EVENTS, ITEMS[1:], [], [], "'missing_texts': 1"),
        ([*EVENTS, ("lost", None)], ITEMS, [], [], "'missing_texts': 1"),
    ],
)
def test_planted_faults_raise(spark, events, items, held, cold, said):
    e, i = frames(spark, events, items)
    with pytest.raises(ValueError, match=said):
        pairs.prepare_pairs(e, i, spark.createDataFrame(held, "item_id long"), spark.createDataFrame(cold, "text string"), cap=9)


def test_no_events(spark):
    got = pairs.prepare_pairs(*frames(spark, []))
    row = got.stats.first()
    assert got.pairs.count() == 0 and (row["input_rows"], row["pairs"], row["fingerprint"]) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert pairs.epoch_batches(got.pairs, 2, 4).count() == 0


def test_epochs_are_permutations_cut_into_batches(spark):
    p = spark.range(103).selectExpr("concat('q', id % 10) AS query_norm", "id AS item_id")
    rows = pairs.epoch_batches(p, 3, 8, seed=5).collect()
    for e in range(3):
        mine = sorted((r["batch"] * 8 + r["pos"], r["query_norm"], r["item_id"]) for r in rows if r["epoch"] == e)
        assert [x[0] for x in mine] == list(range(103)) and {x[2] for x in mine} == set(range(103))
        assert [x[2] for x in mine] == sorted(range(103), key=lambda i: hashlib.md5(f"q{i % 10}\t{i}|{e}|5".encode()).hexdigest())
    assert len({tuple(r["item_id"] for r in sorted(rows, key=lambda r: (r["batch"], r["pos"])) if r["epoch"] == e) for e in range(3)}) == 3
    few = pairs.epoch_batches(p, 3, 8, max_pairs=20, seed=5)
    assert few.groupBy("epoch").count().collect() and {r["count"] for r in few.groupBy("epoch").count().collect()} == {20}
    masked = dense.contrastive_mask(few.withColumn("batch", F.col("epoch") * 1000 + F.col("batch")).withColumnRenamed("query_norm", "query_id"))
    at = {(r["epoch"] * 1000 + r["batch"], r["pos"]): r["query_norm"] for r in few.collect()}
    assert all(at[r["batch"], r["a"]] == at[r["batch"], r["b"]] for r in masked.collect()) and masked.count() > 0


TEXTS = [(0, "Ёлка и ёж"), (1, "one two two THREE"), (2, ""), (3, None), (4, "..."), (5, "x" * 9000 + " y"), (6, "日本 語 12"), (7, "one two two THREE")]


def test_hashed_encoder_equals_the_column_expression(spark):
    d = spark.createDataFrame(TEXTS, "item_id long, text string")
    for dim in (8, 64):
        both = d.select(encode.encoded(F.col("text"), encode.HashedEncoder(dim), 2).alias("a"), dense.hashed_vector(F.col("text"), dim).alias("b")).collect()
        for r in both:
            assert np.allclose(r["a"], r["b"], atol=1e-7) and len(r["a"]) == dim


def test_batches_go_by_length_and_rows_stay_in_order():
    seen = []

    def model(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t) + 1.0, 1.0] for t in texts])

    texts = ["a" * n for n in (9, 1, 5, 0, 7, 3, 2)]
    v = encode.encode_batch(texts, model, 2, 3)
    assert seen == [[0, 1, 2], [3, 5, 7], [9]]
    assert np.allclose(v, [[(len(t) + 1) / math.hypot(len(t) + 1, 1), 1 / math.hypot(len(t) + 1, 1)] for t in texts])
    assert v.dtype == np.float32 and encode.encode_batch([], model, 2).shape == (0, 2)
    for bad, said in ((lambda t: np.ones((len(t), 3)), "gave"), (lambda t: np.full((len(t), 2), np.nan), "finite")):
        with pytest.raises(ValueError, match=said):
            encode.encode_batch(texts, bad, 2)


def lengths():
    """Another encoder: any object with these three. Defined here, workers needn't import this file."""

    class Lengths:
        dim = 2

        def settings(self):
            return {"encoder": "lengths"}

        def load(self):
            return lambda texts: np.array([[len(t), 1.0] for t in texts])

    return Lengths()


def test_bundles_are_checked(spark, tmp_path):
    d, at = spark.createDataFrame(TEXTS, "item_id long, text string"), f"file://{tmp_path}/b"
    m = encode.write_bundle(d, at, lengths())
    assert (m["rows"], m["min_dim"], m["zeros"]) == (8, 2, 0)
    back = {r["item_id"]: r["vector"] for r in encode.read_bundle(spark, at, lengths(), d).collect()}
    assert np.allclose(back[1], [17 / math.hypot(17, 1), 1 / math.hypot(17, 1)]) and len(back) == 8
    with pytest.raises(ValueError, match="made by"):
        encode.read_bundle(spark, at, encode.HashedEncoder(2))
    with pytest.raises(ValueError, match="other ids"):
        encode.read_bundle(spark, at, ids=d.where("item_id > 0"))
    spark.read.parquet(f"{at}/vectors").where("item_id = 1").selectExpr("item_id", "array(1f, 0f) AS vector").write.parquet(f"{at}/other")
    kept = spark.read.parquet(f"{at}/vectors").where("item_id <> 1").unionByName(spark.read.parquet(f"{at}/other"))
    kept.write.parquet(f"{at}/more")
    spark.read.parquet(f"{at}/more").write.mode("overwrite").parquet(f"{at}/vectors")
    with pytest.raises(ValueError, match="not the rows"):
        encode.read_bundle(spark, at)


def test_what_no_bundle_is_made_of(spark, tmp_path):
    for rows, said in (([(1, "a"), (1, "b")], "repeat"), ([(None, "a")], "null or repeat")):
        with pytest.raises(ValueError, match=said):
            encode.write_bundle(spark.createDataFrame(rows, "item_id long, text string"), f"file://{tmp_path}/x", lengths())
        assert not (tmp_path / "x" / "manifest").exists()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert encode.write_bundle(empty, f"file://{tmp_path}/e", lengths())["rows"] == 0
    assert encode.read_bundle(spark, f"file://{tmp_path}/e", lengths(), empty).count() == 0
