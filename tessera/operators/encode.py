"""Encoders of texts as plug-ins, batches by length, and stored bundles of vectors that are checked before use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dense import norm
from tessera.operators.validate import ordered_digest

#: Tokens whose places a worker remembers.
REMEMBERED = 300_000
#: How far from 1 the norm of a stored vector may be.
TOLERANCE = 1e-5


class Encoder(Protocol):
    """What a task needs of a model: how long its vectors are, what tells it from others, and how to load it."""

    dim: int

    def settings(self) -> dict: ...

    def load(self) -> Callable[[list[str]], np.ndarray]:
        """Called once in each Python worker's task; the result maps texts to an array of (texts, dim)."""
        ...


@dataclass(frozen=True)
class HashedEncoder:
    """No model: each token counts up or down in a component, both by its hash. With "xxh64" it gives the vectors of
    dense.hashed_vector; "md5" is a hash that every SQL engine has."""

    dim: int = 64
    hash: str = "xxh64"

    def settings(self) -> dict:
        return {"encoder": "hashed", **asdict(self)}

    def place(self, token: str) -> tuple[int, float]:
        if self.hash == "md5":
            h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
            return h % self.dim, -1.0 if (h >> 16) % 2 else 1.0
        import xxhash

        h = xxhash.xxh64_intdigest(token.encode(), seed=42)
        h -= (h >> 63) << 64  # as a signed number
        return h % self.dim, 1.0 if (h >> 32) % 2 == 0 else -1.0

    def load(self) -> Callable[[list[str]], np.ndarray]:
        import regex

        if self.hash not in ("md5", "xxh64"):
            raise ValueError(f"unknown hash {self.hash}")
        token, known = regex.compile(r"[\p{L}\p{N}]+"), {}

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim))
            for row, t in zip(out, texts, strict=True):
                for w in token.findall(t.lower().replace("ё", "е")):
                    if w not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = self.place(w)
                    slot, sign = known[w]
                    row[slot] += sign
            return out

        return run


def encode_batch(texts: list[str], model: Callable[[list[str]], np.ndarray], dim: int, batch_size: int = 128) -> np.ndarray:
    """(texts, dim) of unit vectors (float32) in the texts' order. Batches are made in order of length, so that padding
    stays small; an array of another shape and components that aren't finite raise a ValueError."""
    out = np.zeros((len(texts), dim), np.float32)
    order = np.argsort(np.fromiter((len(t) for t in texts), np.int64, len(texts)), kind="stable")
    for start in range(0, len(texts), batch_size):
        at = order[start : start + batch_size]
        v = np.asarray(model([texts[i] for i in at]), np.float64)
        if v.shape != (len(at), dim):
            raise ValueError(f"the encoder gave {v.shape} for {len(at)} texts of {dim} components")
        if not np.isfinite(v).all():
            raise ValueError("the encoder gave a component that isn't finite")
        out[at] = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    return out


def encoded(text: Column, encoder: Encoder, batch_size: int = 128) -> Column:
    """Unit vectors (array<float>) of the whole texts, null as empty. A task loads the encoder once, and rows stay in
    their order; a vector of zeros stays one. Memory is bounded by Arrow's batch of rows."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.load()
        for s in parts:
            yield pd.Series(list(encode_batch(s.fillna("").tolist(), model, encoder.dim, batch_size)), index=s.index, dtype=object)

    return run(F.coalesce(text, F.lit("")))


def _summary(vectors: DataFrame, key: str) -> dict:
    """What a bundle's manifest says of its rows. Sums of hashes don't depend on the order, so no task holds all rows."""
    n, v = norm(F.col("vector")), F.col("vector")
    finite = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = vectors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids"), F.min(F.size(v)).alias("min_dim"), F.max(F.size(v)).alias("max_dim"),
        F.count(F.when(~finite, 1)).alias("not_finite"), F.count(F.when(n == 0, 1)).alias("zeros"),
        F.coalesce(F.max(F.when(n > 0, F.abs(n - 1))), F.lit(0.0)).alias("norm_error"),
        F.coalesce(F.sum(F.xxhash64(key, "vector").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("vectors"),
    ).first()
    return r.asDict() | {"id_sha256": ordered_digest(vectors, key, key).first()["fingerprint"]}


def write_bundle(rows: DataFrame, path: str, encoder: Encoder, key: str = "item_id", text: str = "text", batch_size: int = 128) -> dict:
    """Encodes rows into a folder, as (key, vector) with a manifest of the encoder, the ids and the vectors; returns it.

    The manifest is written last and from what was written: a folder without one is no bundle. Ids that are null or
    repeat, and vectors that aren't finite or of norm 1 (or all zeros, as texts without words give) raise a ValueError
    before there is a manifest.
    """
    spark = rows.sparkSession
    rows.select(key, encoded(F.col(text), encoder, batch_size).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    m = _summary(spark.read.parquet(f"{path}/vectors"), key) | {"key": key, "encoder": encoder.settings(), "dim": encoder.dim}
    if m["ids"] != m["rows"]:
        raise ValueError(f"{m['rows'] - m['ids']} of {m['rows']} ids are null or repeat")
    if m["not_finite"] or m["norm_error"] >= TOLERANCE or (m["rows"] and not m["min_dim"] == m["max_dim"] == encoder.dim):
        raise ValueError(f"vectors aren't of norm 1 and {encoder.dim} components: {m}")
    spark.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return m


def read_bundle(spark: SparkSession, path: str, encoder: Encoder | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(key, vector) of a bundle, if its rows are those of its manifest, made by that encoder, for those ids (a table
    that has the key): else a ValueError that names what differs."""
    m = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    vectors = spark.read.parquet(f"{path}/vectors")
    have = _summary(vectors, m["key"])
    off = sorted(k for k in have if have[k] != m[k])
    if off:
        raise ValueError(f"{path}: not the rows of the manifest ({', '.join(off)})")
    if encoder is not None and encoder.settings() != m["encoder"]:
        raise ValueError(f"{path}: made by {m['encoder']}")
    if ids is not None and ordered_digest(ids, m["key"], m["key"]).first()["fingerprint"] != m["id_sha256"]:
        raise ValueError(f"{path}: made for other ids")
    return vectors
