"""Readers and writers: pruned Parquet, CSV answers, JSON, archives, dense arrays, schema checks."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("tessera")


def load_items(spark: SparkSession, path: str, columns: list[str] | None = None, text_columns: tuple = (), chars: int | None = 1800, keep_null: bool = False) -> DataFrame:
    """The columns in the order asked for; texts are cut at the scan unless chars is None, and null ones empty unless keep_null."""
    d = spark.read.parquet(path)
    whole = lambda c: F.col(c) if keep_null else F.coalesce(F.col(c), F.lit(""))
    cut = lambda c: (whole(c) if chars is None else F.substring(whole(c), 1, chars)).alias(c)
    return d.select(*(cut(c) if c in text_columns else F.col(c) for c in (columns or d.columns)))


def validate_schema(df: DataFrame, expected: T.StructType | list[str]) -> DataFrame:
    """df, if it has these columns in this order (and types); else a ValueError that names the first difference."""
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields] if isinstance(expected, T.StructType) else [(n, None) for n in expected]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    for i, (n, t) in enumerate(want):
        if i >= len(have) or have[i][0] != n or (t and have[i][1] != t):
            raise ValueError(f"column {i}: expected {n} {t or ''}, found {have[i] if i < len(have) else 'nothing'}")
    if len(have) > len(want):
        raise ValueError(f"unexpected column {have[len(want)][0]}")
    return df


def kept_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir), or in a local session without one a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/tessera-kept"
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{kept_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_answers(df: DataFrame, path: str, check=None) -> str:
    """The answer table as one CSV file (query_id,answer; CRLF; UTF-8): written aside, checked, then moved into place.

    Returns its SHA-256. One file of one row a query: the driver streams rows in order of id, it doesn't hold them.
    """
    target, aside = Path(path), Path(f"{path}.tmp")
    digest = hashlib.sha256()
    with aside.open("wb") as f:
        put = lambda x: (f.write(x), digest.update(x))
        put(b"query_id,answer\r\n")
        for r in df.orderBy("query_id").toLocalIterator():
            put(f"{r['query_id']},{r['answer'] or ''}\r\n".encode())
    if check is not None and not check(str(aside)):
        aside.unlink()
        raise ValueError("the answer file didn't pass its check")
    os.replace(aside, target)
    return digest.hexdigest()


def write_json(value, path: str) -> None:
    aside = Path(f"{path}.tmp")
    aside.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(aside, path)


def read_json(path: str):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def targets_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(qkey, item_id) of a JSON object of key -> list of ids."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return d.select(F.explode("m").alias("qkey", "ids")).select("qkey", F.explode("ids").alias("item_id"))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def extract_named(archive: str, destination: str, names: Iterable[str], nested: str = "dataset.zip") -> list[Path]:
    """Exactly these base names of a ZIP, or of one ZIP of that name inside it; a name found twice or never is an error."""
    names, out = list(names), []
    with zipfile.ZipFile(archive) as z:
        inner = [i for i in z.infolist() if Path(i.filename).name == nested]
        found = {n: [i for i in z.infolist() if Path(i.filename).name == n] for n in names}
        if inner and not any(found.values()):
            Path(destination).mkdir(parents=True, exist_ok=True)
            aside = Path(destination) / f".{nested}"
            aside.write_bytes(z.read(inner[0]))
            try:
                return extract_named(str(aside), destination, names, nested="")
            finally:
                aside.unlink()
        for n, hits in found.items():
            if len(hits) != 1:
                raise ValueError(f"{n}: found {len(hits)} times")
        Path(destination).mkdir(parents=True, exist_ok=True)
        for n, (hit,) in found.items():
            (Path(destination) / n).write_bytes(z.read(hit))
            out.append(Path(destination) / n)
    return out


def pack(archive: str, root: str, members: Iterable[str]) -> dict[str, str]:
    """A ZIP of the members under root with their checksums in manifest.json; returns these."""
    sums = {m: file_sha256(str(Path(root) / m)) for m in members}
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for m in sums:
            z.write(Path(root) / m, m)
        z.writestr("manifest.json", json.dumps(sums, sort_keys=True))
    return sums


def unpack(archive: str, destination: str, members: Iterable[str]) -> list[Path]:
    """The members of a ZIP made by pack(): nothing else may be in it, no path may leave the destination, all checksums must hold."""
    want, top = {*members, "manifest.json"}, Path(destination).resolve()
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
        for n in names:
            if n not in want or not (top / n).resolve().is_relative_to(top):
                raise ValueError(f"Unexpected member {n}")
        if len(names) != len(want):
            raise ValueError("Members are missing or repeated")
        sums = json.loads(z.read("manifest.json"))
        for n in sorted(want - {"manifest.json"}):
            data = z.read(n)
            if hashlib.sha256(data).hexdigest() != sums.get(n):
                raise ValueError(f"Checksum mismatch: {n}")
            (top / n).parent.mkdir(parents=True, exist_ok=True)
            (top / n).write_bytes(data)
    return [top / n for n in sorted(want - {"manifest.json"})]


def save_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
