from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import history, intent, split
from tessera.streaming.counts import event_counts


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    d = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return d.select(expr.alias("x")).first()["x"]


def test_normalisers(spark):
    assert one(spark, T.clean_text(F.col("a"), 3), a="ЁЖИК") == "ежи"
    assert one(spark, T.clean_text(F.col("a")), a=None) == ""
    assert one(spark, T.word_key(F.col("a")), a="Привет_1, мир!") == "привет_1 мир"
    assert one(spark, T.nfkc(F.col("a")), a="ﬁ  Straße") == "fi strasse"
    assert one(spark, T.compact(F.col("a")), a=None) == "—"
    assert one(spark, T.word_features(T.tokens(F.col("a"))), a="A b") == ["w:a", "w:b", "b:a_b"]
    assert one(spark, T.word_features(T.tokens(F.col("a"))), a="") == []


def test_char_grams_of_short_words(spark):
    assert one(spark, T.char_grams(T.tokens(F.col("a"))), a="a") == [" a "]
    assert one(spark, T.char_grams(T.tokens(F.col("a"))), a="ab") == [" ab", "ab ", " ab "]


def test_stems_of_russian_words(spark):
    d = spark.createDataFrame([("красивая",), ("красивые",), ("house",), (None,)], "term string")
    got = {r["term"]: r["stem"] for r in T.stem_terms(d).collect()}
    assert got["красивая"] == got["красивые"] == "красив" and got["house"] == "house" and got[None] is None


def test_numbers(spark):
    assert one(spark, N.number(F.col("a")), a="x1") is None
    assert one(spark, N.finite(F.lit(float("nan")))) == -1e20
    assert one(spark, N.distance_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))) == 20000.0


def test_place_falls_back_to_the_modal_place(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "search_location long, item_location long")
    c = spark.createDataFrame([(2, 10.0, 20.0)], "item_location long, lat double, lon double")
    r = history.search_centres(e, c).first()
    assert (r["lat"], r["lon"]) == (10.0, 20.0)


def test_apportionment_sums_up(spark):
    d = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "stratum string, n long")
    assert {r["stratum"]: r["quota"] for r in split.apportion(d, 4).collect()} == {"a": 2, "b": 1, "c": 1}


def test_unknown_terms_add_nothing(spark):
    counts = spark.createDataFrame([("x", "a", 3.0), ("y", "b", 1.0)], "class string, term string, c double")
    rows = spark.createDataFrame([("x",), ("y",)], "class string")
    q = spark.createDataFrame([(1, "zzz", 1.0)], "query_id long, term string, w double")
    p = intent.predict(q, intent.multinomial(counts), intent.priors(rows)).collect()
    assert {round(r["prob"], 6) for r in p} | {0.5} == {0.5} or not p


def test_stream_and_batch_agree(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "event_type string, value double")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = event_counts(s).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").collect()) == sorted(event_counts(d).collect())
