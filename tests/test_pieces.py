"""Single operators on small cases of their own."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dense, diagnostics, features, intent, learn, ranking, remote, search, split, validate
from tessera.plans import candidates
from tessera.plans.texts import WORDING

SF = "/root/testdata/sf0.001"


def test_wording_of_remote_services(spark):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(WORDING)], "i int, text string")
    got = {WORDING[r["i"]]: (r["online"], r["remote"], r["nationwide"]) for r in remote.query_flags(rows).collect()}
    assert {w for w, f in got.items() if f[0]} == {"Урок он-лайн", "онлайн урок", "он лайн", "English online, daily"}
    assert {w for w, f in got.items() if f[1]} == {"удалённо", "Работаю УДАЛЕННО", "на удалёнке", "удаленный доступ", "дистанционное обучение", "помощь через интернет", "в интернете"}
    assert {w for w, f in got.items() if f[2]} == {"По всей России", "во всей  России", "вся россия", "по России", "из любой точки России", "любой город россии", "все города в России"}


def test_item_wording_joins_online_and_remote_and_cuts_fields(spark):
    d = spark.createDataFrame([("a", "онлайн", None), ("b", None, "x" * 1000 + " удаленно"), ("c", "", "удаленно по России")], "title string, params string, description string")
    assert [(r["item_remote"], r["item_nationwide"]) for r in remote.item_flags(d).orderBy("title").collect()] == [(True, False), (False, False), (True, True)]


def test_city_rows_leave_out_regions_and_nulls(spark):
    e = spark.createDataFrame([(1, 2, "a"), (2, 2, "a"), (9, 2, "a"), (2, None, "a"), (None, 2, "a"), (2, 1, None)], "search_location long, item_location long, class string")
    got = sorted((r["search_location"], r["nonlocal"]) for r in remote.city_rows(e, e.select("item_location")).collect())
    assert got == [(1, 1.0), (2, 0.0)]


def pair(spark, **more):
    row = {
        "query_id": 1, "item_id": 1, "bm25": 1.0, "bm25_rel": 1.0, "char": 0.5, "char_rel": 1.0, "dense": 0.5, "dense_rel": 1.0, "title_bm25": 1.0, "title_rel": 1.0, "params_bm25": 0.0, "vote": 0.5, "supervised": 0.2, "supervised_rel": 0.4, "supervised_rank": 2,
        "confidence": 0.5, "same": 1.0, "prob": 0.1, "km": 3.0, "clicks": 1.0, "popularity": 2.0, "title": "red car", "params": "звезды 5", "description": "a red car", "item_category": 3, "search_category": 0, "rating": 4.0, "reviews": 3.0, "price": 10.0,
        "phone_hidden": True, "message_forbidden": None, "text": "Red  car", "filters": "Вид услуги: ремонт. Рейтинг пользователя 5 звезды и выше",
    } | more
    schema = ", ".join(f"`{k}` {'boolean' if k in ('phone_hidden', 'message_forbidden') else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def test_filter_captions_are_noise(spark):
    r = features.base_features(pair(spark)).first()
    assert r["filter_coverage"] == 0.5  # of "ремонт" and "5", the parameters have "5"; the captions don't count
    assert (r["rating_filter_satisfied"], r["exact_title"], r["category_match"], r["supervised_microcat_rank"]) == (0.0, 1.0, 1.0, 0.5)
    assert features.base_features(pair(spark, rating=5.0)).first()["rating_filter_satisfied"] == 1.0


def test_windows_stand_after_the_features_in_order(spark):
    base = features.base_features(pair(spark).union(pair(spark, item_id=2, bm25=3.0)))
    out = features.all_features(base)
    assert out.columns == ["query_id", "item_id", *features.FEATURES, *(f"pool_{k}_{s}" for s in ("bm25", "geo_bm25", "title_bm25", "char", "dense", "microcat_probability", "supervised_microcat") for k in ("percentile", "gap_best", "gap_50"))]
    r = out.where("item_id = 1").first()
    assert (r["pool_percentile_bm25"], r["pool_gap_best_bm25"], r["pool_gap_50_bm25"], r["pool_percentile_char"]) == (0.0, -2.0, 0.0, 1.0)


def test_scores_that_round_to_a_tie_go_by_id(spark):
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    i = spark.createDataFrame([(10, [0.5000004, 0.0]), (1, [0.5000001, 0.0]), (20, [0.1, 0.0])], "item_id long, vector array<double>").coalesce(1)
    assert dense.retrieve_top_k(q, i, 1).first()["item_id"] == 1


def test_dense_blocks_and_shards_agree_with_one_block(spark, monkeypatch):
    monkeypatch.setattr(dense, "SHARD", 7)
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=4)]) for i in range(40)]
    items = spark.createDataFrame(v, "item_id long, vector array<double>")
    q = items.where("item_id % 5 = 0").withColumnRenamed("item_id", "query_id")
    one, many = ({(r["query_id"], r["rank"], r["item_id"]) for r in dense.retrieve_top_k(q, items, 3, block=b).collect()} for b in (100, 3))
    assert one == many
    every = {(r["query_id"], r["item_id"]): r["score"] for r in dense.all_scores(q, items, block=3, shard=7).collect()}
    assert len(every) == 8 * 40 and all(abs(every[a, b] - np.dot(v[a][1], v[b][1])) < 1e-5 for a, b in every)


def test_blocks_meet_all_shards_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dense, "SHARD", 7)
    monkeypatch.setattr(dense, "STRIP", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        items = spark.createDataFrame([(i, [float(i % 9), 1.0 + i]) for i in range(60)], "item_id long, vector array<double>")
        q = items.where("item_id % 5 = 0").withColumnRenamed("item_id", "query_id")
        one, many = ([tuple(r) for r in dense.retrieve_top_k(q, items, 3, block=b).orderBy("query_id", "rank").collect()] for b in (100, 3))
        assert len(one) == 36 and one == many
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hashed_vectors(spark):
    d = spark.createDataFrame([("red car",), ("car red",), ("",), ("blue boat",)], "t string").select(dense.hashed_vector(F.col("t"), 16).alias("v")).collect()
    assert d[0]["v"] == d[1]["v"] != d[3]["v"] and len(d[0]["v"]) == 16 and math.isclose(sum(x * x for x in d[0]["v"]), 1.0) and set(d[2]["v"]) == {0.0}


def test_error_tags_compare_with_the_distractor(spark):
    names = "rank long, location string, same double, lexical double, title_coverage double, semantic double, class string, d_location string, d_same double, d_lexical double, d_semantic double, d_class string"
    good = (60, "a", 1.0, 0.9, 0.9, 0.9, "x", "a", 1.0, 0.9, 0.9, "x")

    def tags(**changed):
        row = dict(zip([n.split()[0] for n in names.split(", ")], good, strict=True)) | changed
        return spark.createDataFrame([tuple(row.values())], names).select(diagnostics.error_tags().alias("t")).first()["t"]

    assert tags() == ["close_rank"] and tags(rank=None) == ["candidate_miss"] and tags(rank=200) == ["other_ranking"]
    assert tags(rank=200, d_location="b") == ["location_difference"] and tags(rank=200, same=0.0) == ["location_difference"] and tags(rank=200, same=0.0, d_same=0.0) == ["other_ranking"]
    assert tags(rank=200, d_class="y") == ["class_difference"] and tags(rank=200, d_class=None) == ["other_ranking"]
    assert tags(rank=200, lexical=0.3, title_coverage=0.1) == ["low_lexical"] and tags(rank=200, semantic=0.7) == ["low_semantic"]


def test_sparse_weights_equal_the_dense_formula(spark):
    counts = {("x", "a"): 3.0, ("x", "b"): 1.0, ("y", "b"): 2.0}
    d = spark.createDataFrame([(c, t, n) for (c, t), n in counts.items()], "class string, term string, c double")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("new",)], "term string")
    for given, terms in ((None, "ab"), (vocabulary, ("a", "b", "new"))):
        n = lambda c, t: counts.get((c, t), 0.0) + 0.1
        rest = lambda c, t: sum(v for (k, u), v in counts.items() if u == t and k != c) + 0.1
        m = {(r["class"], r["term"]): r["weight"] for r in intent.multinomial(d, 0.1, given).table().collect()}
        k = {(r["class"], r["term"]): r["weight"] for r in intent.complement(d, 0.1, given).table().collect()}
        for c in "xy":
            for t in terms:
                assert math.isclose(m[c, t], math.log(n(c, t)) - math.log(sum(n(c, u) for u in terms)), abs_tol=1e-9)
                assert math.isclose(k[c, t], math.log(sum(rest(c, u) for u in terms)) - math.log(rest(c, t)), abs_tol=1e-9)


def test_merge_needs_unique_keys(spark):
    one, two = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b"), (1, "c")], "k int, y string")
    assert split.many_to_one(two, one, "k").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        split.many_to_one(one, two, "k")


def test_ordered_fingerprint_sees_the_order(spark):
    a, b = ([(0, "x"), (1, "y")], [(0, "y"), (1, "x")])
    f = [validate.ordered_fingerprint(spark.createDataFrame(r, "at int, id string"), "id", "at").first() for r in (a, b)]
    assert f[0]["n"] == 2 and f[0]["fingerprint"] != f[1]["fingerprint"]


def test_answer_files(spark, tmp_path):
    expected = spark.createDataFrame([("q" * 16,), ("r" * 16,)], "query_id string")
    corpus = spark.createDataFrame([("0" * 15 + "1",), ("0" * 15 + "2",)], "item_id string")
    one, two = "0" * 15 + "1", "0" * 15 + "2"

    def codes(text: bytes, **more):
        path = tmp_path / "answer.csv"
        path.write_bytes(text)
        return {r["code"]: r["n"] for r in validate.validate_answer(spark, str(path), expected, corpus, **more).collect()}

    assert codes(f"query_id,answer\r\n{'q' * 16},{one} {two}\r\n{'r' * 16},\r\n".encode()) == {}
    assert codes(f"﻿query_id,answer\r\n\"{'q' * 16}\",\"{one}\"\r\n{'r' * 16},\r\n".encode()) == {}
    assert codes(f"id,answer\n{'q' * 16},{one}\n{'r' * 16},\n".encode()) == {"invalid_header": 1}
    assert codes(f"query_id,answer\n{'q' * 16},{one},more\n{'r' * 16},\n".encode()) == {"wrong_column_count": 1, "missing_query_id": 1}
    assert codes(f"query_id,answer\n{'q' * 16},{one} {two}\n".encode(), k=1) == {"too_many_candidates": 1, "missing_query_id": 1, "wrong_row_count": 1}


def test_retriever_saves_loads_and_checks_its_arguments(spark, tmp_path):
    items = spark.createDataFrame([(1, "red car", "fast"), (2, "red boat", "slow"), (3, "blue house", "old")], "item_id long, title string, description string")
    r = search.SparseRetriever(items, {"title": "title", "description": "description"}, cfg=search.SparseConfig(max_features=None, char_min_df=1, max_df=1.0))
    r.save(str(tmp_path / "index"))
    again = search.SparseRetriever.load(spark, str(tmp_path / "index"), cfg=r.cfg)
    for channel in ("word", "char", "hybrid"):
        a, b = ([(x["item_id"], x["rank"], x["score"]) for x in m.query_one(spark, "red cars", 2, channel).collect()] for m in (r, again))
        assert sorted(a) == sorted(b) and min(a, key=lambda x: x[1])[0] == 1
    q = spark.createDataFrame([(5, "boat"), (6, "nothing here")], "query_id long, text string")
    pairs = spark.createDataFrame([(5, 2), (5, 3), (6, 1)], "query_id long, item_id long")
    got = {(x["query_id"], x["item_id"]): x["score"] for x in r.score_pairs(pairs, q).collect()}
    assert got[5, 2] > 0 == got[5, 3] == got[6, 1]
    for bad in ({"top": 0}, {"channel": "sound"}):
        with pytest.raises(ValueError):
            r.query_batch(q, **bad)


def test_stems_find_other_forms(spark):
    items = spark.createDataFrame([(1, "красивые машины"), (2, "старый дом"), (3, "house")], "item_id long, title string")
    q = spark.createDataFrame([(1, "красивая машина")], "query_id long, text string")
    found = {s: {x["item_id"] for x in search.SparseRetriever(items, {"title": "title"}, cfg=search.SparseConfig(max_features=None, stem=s)).scores(q).where("score > 0").collect()} for s in (True, False)}
    assert found == {True: {1}, False: set()}
    assert spark.createDataFrame([(["дома", "дома", "cat"],), (None,)], "t array<string>").select(T.stemmed(F.col("t")).alias("t")).collect()[0]["t"] == ["дом", "дом", "cat"]


def test_filters_add_their_weight(spark):
    q = spark.createDataFrame([(1, "red car", "car new")], "query_id long, text string, filters string")
    got = {r["term"]: r["qw"] for r in search.query_terms(q, filters="filters").collect()}
    assert got == {"w:red": 1.0, "w:car": 1.15, "b:red_car": 1.0, "w:new": 0.15, "b:car_new": 0.15}


def test_leaves_keep_apart(spark):
    rows = spark.createDataFrame([(1, i, float(i % 4), int(i % 4 == 3)) for i in range(40)], "query_id long, item_id long, x double, label long")
    trees = learn.train_lambda(rows, ["x"], rounds=3, depth=3)
    best = ranking.top_k(learn.score_lambda(trees, rows, ["x"]), 10, positive=False).collect()
    assert all(r["label"] == 1 for r in best)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_features_of_real_candidates(spark):
    out = {(r["query_id"], r["item_id"]): r for r in candidates.features_of(spark, SF).collect()}
    rows = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    part, line = {r["p_partkey"]: r for r in rows("part")}, rows("lineitem")
    n = Counter(r["l_partkey"] for r in line)
    assert {q for q, _ in out} <= {k for k in part if k % candidates.EVERY == 0} and len(out) > 200
    best = {}
    for (q, i), r in out.items():
        ask, title = set(part[q]["p_name"].split()), part[i]["p_name"].split()
        assert math.isclose(r["item_popularity"], math.log1p(n[i])) and r["title_coverage"] == len(ask & set(title)) / len(ask)
        assert r["exact_title"] == float(part[q]["p_name"] in part[i]["p_name"]) and math.isclose(r["log_price"], math.log1p(part[i]["p_retailprice"]))
        best[q] = max(best.get(q, 0.0), r["bm25_relative"])
        assert r["history_click"] > 0 or part[i]["p_name"] != part[q]["p_name"]
    assert set(best.values()) == {1.0}


def test_scans_cut_texts_and_keep_nulls_if_asked(spark, tmp_path):
    from tessera.sources import io

    spark.createDataFrame([(1, "abcdef", None), (2, None, "x")], "id long, text string, other string").write.parquet(str(tmp_path / "t"))
    rows = lambda **k: sorted(tuple(r) for r in io.load_items(spark, str(tmp_path / "t"), ["text", "id"], ("text",), 3, **k).collect() if r["id"])
    assert rows() == [("", 2), ("abc", 1)]
    kept = io.load_items(spark, str(tmp_path / "t"), ["text", "id"], ("text",), 1000, keep_null=True)
    assert {r["id"]: r["text"] for r in kept.collect()} == {1: "abcdef", 2: None} and kept.columns == ["text", "id"]
    assert io.validate_schema(kept, ["text", "id"]) is kept
    for wrong in (["id", "text"], ["text"], ["text", "id", "more"]):
        with pytest.raises(ValueError):
            io.validate_schema(kept, wrong)


def test_checks_of_pools_and_answers(spark):
    pool = spark.createDataFrame([(1, 1, 0.5), (1, 1, float("nan")), (2, 9, None)], "query_id long, item_id long, s double")
    assert tuple(validate.finite_check(pool, ["s"]).first()) == (3, 2)
    known = spark.createDataFrame([(1,)], "query_id long"), spark.createDataFrame([(1,)], "item_id long")
    assert tuple(validate.bounds_check(pool, *known).first()) == (1, 1, 1)
    answers = spark.createDataFrame([("a b c",), ("",), (None,), ("d",)], "answer string")
    assert tuple(validate.candidate_stats(answers).first()) == (0, 3, 1.0, 2)


def test_samples_fill_up_from_other_strata(spark):
    rows = spark.createDataFrame([(i, "big" if i < 30 else "small") for i in range(32)], "k long, stratum string")
    quotas = spark.createDataFrame([("big", 5), ("small", 5)], "stratum string, quota long")
    sample, log = split.sample_with_fallback(rows, quotas, 1, "k", 10)
    assert sample.count() == sample.select("k").distinct().count() == 10
    assert {r["stratum"]: r["short"] for r in log.collect()} == {"big": 0, "small": 3}


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from tessera.streaming.counts import windowed_counts

    d = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "event_type string, t string").select("event_type", F.to_timestamp("t").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(s).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(windowed_counts(d).collect()) and windowed_counts(d).count() == 2


def test_error_groups_examples_and_the_report(spark):
    rows = [(1, 10, 60, "cold", "x", ["close_rank", "low_lexical"]), (2, 11, None, "warm", None, ["candidate_miss"]), (3, 12, 55, "warm", "x", ["close_rank"]), (4, 13, 55, "warm", "y", ["close_rank"])]
    t = spark.createDataFrame(rows, "query_id int, item_id int, rank int, subset string, class string, tags array<string>")
    got = {(r["subset"], r["tag"], r["class"]): r["n"] for r in diagnostics.error_groups(t).collect()}
    want = Counter()
    for _, _, _, s, c, tags in rows:
        for tag in ["all", *tags]:
            want.update([(s, tag, "all"), ("all", tag, c or "none"), ("all", tag, "all"), (s, tag, c or "none")])
    assert got == want and got["all", "all", "all"] == 4
    ex = diagnostics.error_examples(t, 2)
    assert {(r["tag"], r["place"], r["item_id"]) for r in ex.collect()} == {("close_rank", 1, 12), ("close_rank", 2, 13), ("low_lexical", 1, 10), ("candidate_miss", 1, 11)}
    means = spark.createDataFrame([("a|b", 1.0, None)], "feature string, positive double, distractor double")
    text = diagnostics.report(diagnostics.tag_counts(t), means, "T", spark.createDataFrame([("m", 0.5)], "name string, recall double"), diagnostics.error_groups(t), ex)
    assert text.startswith("# T\n") and "| m | 0.5000 |" in text and "| close_rank | 3 |" in text and "| a\\|b | 1.0000 | - |" in text and "| all | all | all | 4 |" in text and "| candidate_miss | 1 | 2 | 11 | - |" in text


def test_ordered_digest_is_a_tree_of_runs(spark):
    import hashlib

    def plain(ids, run):
        level = ids
        while True:
            level = [hashlib.sha256("\n".join(level[i : i + run]).encode()).hexdigest() for i in range(0, len(level), run)]
            if len(level) == 1:
                return level[0]

    rows = [(i % 7, f"id{i}") for i in range(100)] + [(3, None), (None, "first")]
    d = spark.createDataFrame(rows, "at int, id string").repartition(5)
    ids = [k or "" for _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for run in (4, 1000):
        assert tuple(validate.ordered_digest(d, "id", "at", run).first()) == (102, plain(ids, run))
    assert tuple(validate.ordered_digest(d.limit(0), "id", "at").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_known_items_need_the_place_or_a_compatible_one(spark):
    p = spark.createDataFrame([(1, i, "t", 5, i, float(i == 2), 0.0, 9.0 if i != 4 else 1.0) for i in range(1, 6)], "query_id int, item_id int, text string, search_location int, rank int, same_location double, location_probability double, log_distance double")
    c = spark.createDataFrame([("t", 5, 1), ("t", 7, 2), ("t", 7, 3), ("t", 7, 4), ("u", 5, 5), ("t", None, 5)], "text string, search_location int, item_id int")
    assert sorted(r["item_id"] for r in features.known_by_text(p, c).collect()) == [1, 2, 4]
