"""Arrays and zipped tables as sources."""

import zipfile

import numpy as np
import pytest

from tessera.sources import arrays


@pytest.fixture(scope="module")
def src(spark):
    arrays.register(spark)
    return spark


def rows(df, key="id"):
    return sorted((r[key], [float(x) for x in r["vector"]]) for r in df.collect())


def test_round_trip_by_byte_ranges(src, tmp_path):
    v = np.random.default_rng(1).normal(size=(1000, 7)).astype(np.float32)
    d = src.createDataFrame([(i, v[i].tolist()) for i in range(1000)], "k long, v array<float>").repartition(3)
    at = f"file://{tmp_path}/a"
    d.write.format("npy").mode("append").save(at)
    back = src.read.format("npy").option("split", 700).load(at)
    assert back.rdd.getNumPartitions() >= 40
    assert rows(back) == [(i, [float(x) for x in v[i]]) for i in range(1000)]
    d.where("k < 5").write.format("npy").mode("append").save(at)
    assert src.read.format("npy").load(at).count() == 1005
    d.where("k < 3").write.format("npy").mode("overwrite").save(at)
    assert rows(src.read.format("npy").load(at)) == [(i, [float(x) for x in v[i]]) for i in range(3)]
    assert len(list((tmp_path / "a").glob("*.npz"))) <= 3


def test_files_of_failed_tasks_do_not_count(src, tmp_path):
    at = tmp_path / "lost"
    at.mkdir()
    np.savez(at / f"{arrays.WRITTEN}00000-gone-0000.npz", ids=np.arange(3), vectors=np.ones((3, 2), np.float32))
    np.savez(at / "own.npz", ids=np.array([7]), vectors=np.ones((1, 2), np.float32))
    assert rows(src.read.format("npy").load(str(at))) == [(7, [1.0, 1.0])]
    src.sql("SELECT 8L AS k, array(2f, 2f) AS v").write.format("npy").mode("append").save(str(at))
    assert rows(src.read.format("npy").load(str(at))) == [(7, [1.0, 1.0]), (8, [2.0, 2.0])]


def test_text_ids_doubles_and_files_of_several_batches(src, tmp_path, monkeypatch):
    d = src.range(20_000).selectExpr("concat('n', id) AS k", "array(cast(id AS double), 0.1D) AS v").coalesce(1)
    d.write.format("npy").mode("append").save(f"{tmp_path}/t")
    back = src.read.format("npy").load(f"{tmp_path}/t")
    assert back.schema.simpleString() == "struct<file:string,id:string,vector:array<double>>"
    assert back.where("vector[1] = 0.1D AND concat('n', cast(vector[0] AS long)) = id").count() == 20_000


def test_bare_and_compressed_files(src, tmp_path):
    v = np.arange(30, dtype=">f4").reshape(10, 3)
    np.save(tmp_path / "x.npy", v)
    got = src.read.format("npy").option("split", 24).load(str(tmp_path / "x.npy"))
    assert rows(got, "row") == [(i, v[i].tolist()) for i in range(10)]
    np.savez_compressed(tmp_path / "y.npz", ids=np.arange(10, 20), vectors=v.astype(np.float32))
    assert rows(src.read.format("npy").load(str(tmp_path / "y.npz"))) == [(i + 10, v[i].tolist()) for i in range(10)]


def test_what_is_refused(src, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((4, 3))))
    np.savez(tmp_path / "short.npz", ids=np.arange(3), vectors=np.ones((4, 2)))
    np.save(tmp_path / "cut.npy", np.ones((4, 3)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    for name, said in (("f.npy", "by column"), ("short.npz", "3 ids"), ("none.npy", "nothing there"), ("cut.npy", "ends before")):
        with pytest.raises(Exception, match=said):
            src.read.format("npy").load(str(tmp_path / name)).collect()
    bad = {"null, array(1f)": "must not be null", "1L, array(1f, null)": "no nulls", "1L, cast(null AS array<float>)": "must not be null"}
    for i, (made, said) in enumerate(bad.items()):
        with pytest.raises(Exception, match=said):
            src.sql(f"SELECT cast(a AS long) a, b FROM (SELECT {made}) t(a, b)").write.format("npy").mode("append").save(str(tmp_path / f"n{i}"))
        assert not (tmp_path / f"n{i}" / arrays.MANIFEST).exists()
    with pytest.raises(Exception, match="one length"):
        src.sql("SELECT * FROM VALUES (1L, array(1f)), (2L, array(1f, 2f)) t(a, b)").coalesce(1).write.format("npy").mode("append").save(str(tmp_path / "u"))


def test_an_empty_table(src, tmp_path):
    src.createDataFrame([], "k long, v array<float>").write.format("npy").mode("append").save(str(tmp_path / "e"))
    assert src.read.format("npy").schema("file string, id long, vector array<float>").load(str(tmp_path / "e")).collect() == []
    with pytest.raises(Exception, match="give a schema"):
        src.read.format("npy").load(str(tmp_path / "e"))


@pytest.mark.parametrize("packed", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("nested", [False, True])
def test_tables_inside_archives(src, tmp_path, packed, nested):
    import pandas as pd

    t = pd.DataFrame({"a": np.arange(500), "b": [f"t{i}" for i in range(500)]})
    t.to_parquet(tmp_path / "t.parquet", row_group_size=100)
    inner = tmp_path / ("dataset.zip" if nested else "out.zip")
    with zipfile.ZipFile(inner, "w", packed) as z:
        z.write(tmp_path / "t.parquet", "some/folder/t.parquet")
        z.writestr("notes.txt", "x")
    if nested:
        with zipfile.ZipFile(tmp_path / "out.zip", "w", packed) as z:
            z.write(inner, "deep/dataset.zip")
    d = src.read.format("zipped").option("member", "t.parquet").load(str(tmp_path / "out.zip"))
    assert d.rdd.getNumPartitions() == (5 if packed == zipfile.ZIP_STORED else 1)
    assert [tuple(r) for r in d.orderBy("a").collect()] == list(t.itertuples(index=False, name=None))
    with pytest.raises(Exception, match="no u.parquet"):
        src.read.format("zipped").option("member", "u.parquet").load(str(tmp_path / "out.zip"))


def test_a_name_found_twice(src, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/t.parquet", "x")
        z.writestr("b/t.parquet", "x")
    with pytest.raises(Exception, match="2 times"):
        src.read.format("zipped").option("member", "t.parquet").load(str(tmp_path / "z.zip"))
