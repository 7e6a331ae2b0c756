import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ranking, validate
from tessera.sources import io

NAMES = ["00ab34cd56ef7890", "00ab34cd56ef7891", "7fffffffffffffff", "c0ffee00c0ffee00"]


def test_legality_comes_before_k_and_ties_go_by_id(spark):
    rows = [(3, NAMES[3], 9.5), (3, NAMES[1], 0.25), (3, NAMES[0], 0.25), (3, NAMES[2], -4.0), (8, NAMES[2], 7.0), (8, NAMES[0], float("nan"))]
    s = spark.createDataFrame(rows, "query_id long, item_id string, score double")
    legal = spark.createDataFrame([(n,) for n in NAMES[:3]], "item_id string")
    got = {r["query_id"]: r["answer"] for r in ranking.answer_rows(ranking.legal_top(s, legal, 2)).collect()}
    assert got == {3: f"{NAMES[0]} {NAMES[1]}", 8: f"{NAMES[2]} {NAMES[0]}"}


def test_duplicate_candidates_are_an_error(spark):
    s = spark.createDataFrame([(4, NAMES[2], 0.5), (4, NAMES[1], 0.5), (4, NAMES[2], 0.5)], "query_id long, item_id string, score double")
    with pytest.raises(ValueError, match="Duplicate"):
        ranking.legal_top(s, s.select("item_id"), 5)


@pytest.mark.parametrize("parts", [1, 4])
def test_pool_windows_do_not_depend_on_row_order(spark, parts):
    scores = {0: [8.0, 6.5, 6.5, 6.5, 0.5], 1: [-1.0], 2: [float(x) for x in range(60)]}
    s = spark.createDataFrame([(q, 100 * q + i, x) for q, xs in scores.items() for i, x in enumerate(xs)], "query_id long, item_id long, bm25 double").repartition(parts)
    rows = {r["item_id"]: r for r in ranking.augment(s, ["bm25"]).collect()}
    assert [rows[i]["pool_percentile_bm25"] for i in range(5)] == [1, 0.75, 0.75, 0.75, 0]
    assert [rows[i]["pool_gap_best_bm25"] for i in range(5)] == [0, -1.5, -1.5, -1.5, -7.5]
    assert [rows[i]["pool_gap_50_bm25"] for i in range(5)] == [7.5, 6, 6, 6, 0]
    assert (rows[100]["pool_percentile_bm25"], rows[100]["pool_gap_best_bm25"], rows[100]["pool_gap_50_bm25"]) == (1, 0, 0)
    assert rows[259]["pool_gap_50_bm25"] == 49 and rows[200]["pool_gap_50_bm25"] == -10


def test_zscore_stays_inside_groups(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 4.0), ("b", 3, -7.0)], "q string, i long, s double")
    z = [r["z"] for r in sorted(s.select("i", ranking.zscore(F.col("s"), "q").alias("z")).collect())]
    assert z == pytest.approx([-(0.5**0.5), -(0.5**0.5), 2**0.5, 0])


def test_answers_keep_literal_ids(spark):
    query = "0e10ABCDefgh0001"
    expected = spark.createDataFrame([(query,), ("0" * 16,)], "query_id string")
    corpus = spark.createDataFrame([(n,) for n in NAMES[:2]], "item_id string")
    schema = "row long, query_id string, answer string, n_columns int"
    good = spark.createDataFrame([(0, query, f"{NAMES[1]} {NAMES[0]}", 2), (1, "0" * 16, "", 2)], schema)
    assert validate.answer_errors(good, expected, corpus).count() == 0
    bad = spark.createDataFrame([(0, query.lower(), NAMES[0], 2), (1, "0" * 16, f"{NAMES[0]} {NAMES[3]} {NAMES[0]} {NAMES[1].upper()}", 2)], schema)
    got = {r["code"]: r["n"] for r in validate.error_counts(validate.answer_errors(bad, expected, corpus)).collect()}
    assert got == {"unknown_query_id": 1, "missing_query_id": 1, "duplicate_item_id": 1, "item_not_in_corpus": 1, "invalid_item_id_format": 1}


def test_only_the_first_examples_are_kept(spark):
    errors = spark.createDataFrame([("x", f"{i:03}") for i in range(50)] + [("y", None)], "code string, example string")
    got = {r["code"]: (r["n"], r["examples"]) for r in validate.error_counts(errors, 3).collect()}
    assert got == {"x": (50, ["000", "001", "002"]), "y": (1, [])}


def test_archives_hold_what_they_name_and_nothing_else(tmp_path):
    import zipfile

    for n in ("model.bin", "notes.md"):
        (tmp_path / n).write_text(f"content of {n}")
    sums = io.pack(str(tmp_path / "whole.zip"), str(tmp_path), ["model.bin", "notes.md"])
    assert sums["notes.md"] == io.file_sha256(str(tmp_path / "notes.md"))
    assert [p.name for p in io.unpack(str(tmp_path / "whole.zip"), str(tmp_path / "there"), ["model.bin", "notes.md"])] == ["model.bin", "notes.md"]
    with pytest.raises(ValueError, match="Unexpected"):  # a member that wasn't asked for
        io.unpack(str(tmp_path / "whole.zip"), str(tmp_path / "x"), ["model.bin"])

    def archive(name, **members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k.replace("UP", "../../"), v)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="Checksum mismatch"):
        io.unpack(archive("changed.zip", notes="new", **{"manifest.json": '{"notes": "' + "0" * 64 + '"}'}), str(tmp_path / "x"), ["notes"])
    with pytest.raises(ValueError, match="Unexpected"):
        io.unpack(archive("escape.zip", UPevil="x"), str(tmp_path / "x"), ["evil"])
    with pytest.raises(ValueError, match="missing"):
        io.unpack(archive("short.zip", notes="n"), str(tmp_path / "x"), ["notes"])


def test_named_members_come_from_a_nested_archive(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "dataset.zip", "w") as z:
        z.writestr("deep/a.parquet", "A")
        z.writestr("b.parquet", "B")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(tmp_path / "dataset.zip", "some/dataset.zip")
    got = io.extract_named(str(tmp_path / "outer.zip"), str(tmp_path / "out"), ["a.parquet", "b.parquet"])
    assert [p.read_text() for p in got] == ["A", "B"]
    with pytest.raises(ValueError, match="found 0 times"):
        io.extract_named(str(tmp_path / "dataset.zip"), str(tmp_path / "out2"), ["c.parquet"])


def test_json_and_targets(spark, tmp_path):
    io.write_json({"k2": ["b"], "k1": ["a", "c"]}, str(tmp_path / "t.json"))
    assert io.read_json(str(tmp_path / "t.json")) == {"k1": ["a", "c"], "k2": ["b"]}
    assert sorted(map(tuple, io.targets_from_json(spark, str(tmp_path / "t.json")).collect())) == [("k1", "a"), ("k1", "c"), ("k2", "b")]


def test_vectors_are_written_and_read(spark, tmp_path):
    io.save_vectors(spark.createDataFrame([(1, [0.5, 0.25])], "id long, v array<double>"), str(tmp_path / "v"), "id", "v")
    r = io.load_vectors(spark, str(tmp_path / "v"))
    assert r.schema["v"].dataType.simpleString() == "array<float>" and r.first()["v"] == [0.5, 0.25]


def test_answer_file(spark, tmp_path):
    d = spark.createDataFrame([("b", "2 1"), ("a", None)], "query_id string, answer string")
    digest = io.write_answers(d, str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_bytes() == b"query_id,answer\r\na,\r\nb,2 1\r\n"
    assert digest == io.file_sha256(str(tmp_path / "a.csv"))


def test_ranged_ranks_are_those_of_the_whole_list(spark):
    """Long lists, one score for half of them, and ranges of few rows: no task puts a query's whole list in order."""
    d = spark.range(3000).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("item_id"), F.when(F.col("id") % 4 < 2, 1.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("a"), (F.col("id") % 7 / 7).alias("b"))
    got = ranking.ranged_ranks(d, {"x": "a", "y": "b"}, rows=100)
    w = lambda s: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(s), "item_id")).cast("long")
    want = d.withColumn("x", w("a")).withColumn("y", w("b"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert ranking.ranged_ranks(d.limit(0), {"x": "a"}).count() == 0
