"""Exact top-k inner products by the three-phase uniform threshold algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, parts, table

K, SCALE = 20, 64
SOURCES = 2
QUERY_BLOCK, VECTOR_BLOCK = 1024, 2048
#: What stands for components beyond it, whose products no score could hold.
HUGE = 1 << 62
_PACK = "b int, s int, n int, ids binary, x binary, tau binary"
_LIST = "qb int, cb int, s int, code binary, score binary"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; one row an id, ids and vectors that are null or not finite left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c) * scale < float(HUGE), F.floor(c * scale).cast("long")).otherwise(F.lit(HUGE)))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(ok).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _packed(rows: DataFrame, sources: int, dim: int) -> DataFrame:
    """One row for each block and source: the ids of the block and their components of that source."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), dim), np.int64)
        for i, v in enumerate(pdf["v"]):
            x[i, : len(v)] = v
        ids, tau = pdf["id"].to_numpy(np.int64).tobytes(), pdf["tau"].to_numpy(np.float64).tobytes()
        cuts = [dim * s // sources for s in range(sources + 1)]
        return pd.DataFrame([(int(pdf["b"].iloc[0]), s, len(pdf), ids, np.ascontiguousarray(x[:, cuts[s] : cuts[s + 1]]).tobytes(), tau) for s in range(sources)], columns=["b", "s", "n", "ids", "x", "tau"])

    return rows.groupBy("b").applyInPandas(pack, _PACK)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles while every sum stays under 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return q.astype(np.float64) @ c.T.astype(np.float64) if most < 2.0**53 else q @ c.T


def _block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    qi, ci = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
    s = _scores(np.frombuffer(row.q_x, np.int64).reshape(len(qi), -1), np.frombuffer(row.c_x, np.int64).reshape(len(ci), -1))
    return qi, ci, s, np.frombuffer(row.q_tau, np.float64)


def _pairs(queries: DataFrame, vectors: DataFrame, n_blocks: int, wide: int, asked: DataFrame | None = None) -> DataFrame:
    """Every query block beside every vector block, source by source: a stated query set in blocks; or those of `asked`."""
    q = queries.select(F.col("b").alias("qb"), "s", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("tau").alias("q_tau"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))) if asked is None else q.join(asked, ["qb", "s"])
    c = vectors.select(F.col("b").alias("cb"), "s", F.col("ids").alias("c_ids"), F.col("x").alias("c_x"))
    return q.repartition(wide, "cb", "s").join(c.repartition(wide, "cb", "s").hint("shuffle_hash"), ["cb", "s"])


def top_k(vectors: DataFrame, queries=None, k: int = K, scale: int = SCALE, sources: int = SOURCES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the other vectors, ties to smaller ids.

    queries: a condition on `id` that names the query rows; all others, and the queries among themselves, are
    candidates. Components are cut into `sources` groups, each a source that knows only its share of every score.
    Phase 1 gathers each source's own k best for every query, and scores those exactly: the k-th of them is a safe
    cutoff, for at least k candidates reach it. Phase 2 sends the cutoff with the query blocks; a candidate whose every
    share stays under cutoff / sources can't reach it, so the sources send only entries from there on. Phase 3 adds the
    shares sent and asks the sources for those that weren't. Blocks bound what a task holds; nothing grows with the
    table but their number. Null or non-finite vectors and null ids take no part, repeated ids count once (with the
    least of their vectors), shorter vectors count as padded with zeros. Fewer than k candidates: all are returned.
    Vectors whose scores may pass 2^63 raise a ValueError.
    """
    spark = vectors.sparkSession
    queries = (F.col("id") % 20 == 0) if queries is None else queries
    v = materialize(quantised(vectors, key, vector, scale))
    widest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    n, n_queries, dim, most = v.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(queries, 1)), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(widest), F.lit(0))).first()
    if dim * most * most >= 1 << 63:
        raise ValueError("scores of these vectors may pass 2^63: scale them down")
    dim = max(dim, sources)
    c_blocks, q_blocks = max(1, math.ceil(n / VECTOR_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    wide = max(parts(spark), min(4096, c_blocks * sources))
    packed = materialize(_packed(v.select(F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int").alias("b"), "id", "v", F.lit(0.0).alias("tau")), sources, dim))
    asked = v.where(queries).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("b"), "id", "v")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                qi, ci, s, _ = _block(row)
                s = np.where(qi[:, None] == ci[None, :], -np.inf, s)
                m = min(k, len(ci))
                at = np.argpartition(s, len(ci) - m, axis=1)[:, len(ci) - m :]
                got = np.take_along_axis(s, at, 1)
                out = pd.DataFrame({"query_id": np.repeat(qi, m), "s": row.s, "vec_id": ci[at].ravel(), "local": got.ravel()})
                yield out[np.isfinite(out["local"])]

    first = _pairs(_packed(asked.withColumn("tau", F.lit(0.0)), sources, dim), packed, c_blocks, wide).mapInPandas(best, "query_id long, s int, vec_id long, local double")
    lists = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "s").orderBy(F.desc("local"), "vec_id"))).where(F.col("r") <= k)
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t + x)
    known = lists.select("query_id", "vec_id").distinct().join(v.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").join(v.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id").select("query_id", dot.alias("score"))
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    cutoff = ranked.where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("tau"))
    # Without k candidates there's no cutoff, and every entry is sent.
    asked = materialize(_packed(asked.join(cutoff, "id", "left").select("b", "id", "v", F.coalesce("tau", F.lit(float("-inf"))).alias("tau")), sources, dim))

    def sufficient(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                qi, ci, s, tau = _block(row)
                q, c = np.nonzero((s * sources >= tau[:, None]) & (qi[:, None] != ci[None, :]))
                yield pd.DataFrame([(row.qb, row.cb, row.s, (q * len(ci) + c).astype(np.int64).tobytes(), s[q, c].astype(np.int64).tobytes())], columns=["qb", "cb", "s", "code", "score"])

    sent = _pairs(asked, packed, c_blocks, wide).mapInPandas(sufficient, _LIST)

    def coordinate(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {r.s: (np.frombuffer(r.code, np.int64), np.frombuffer(r.score, np.int64)) for r in pdf.itertuples(index=False)}
        every = np.unique(np.concatenate([c for c, _ in lists.values()]))
        qb, cb, rows = int(pdf["qb"].iloc[0]), int(pdf["cb"].iloc[0]), []
        total = np.zeros(len(every), np.int64)
        for s, (code, score) in lists.items():
            total[np.searchsorted(every, code)] += score
            rows.append((qb, cb, s, np.setdiff1d(every, code, assume_unique=True).tobytes(), b""))
        return pd.DataFrame([*rows, (qb, cb, -1, every.tobytes(), total.tobytes())], columns=["qb", "cb", "s", "code", "score"])

    held = materialize(sent.groupBy("qb", "cb").applyInPandas(coordinate, _LIST))

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                s, code = _block(row)[2], np.frombuffer(row.code, np.int64)
                yield pd.DataFrame([(row.qb, row.cb, row.s, row.code, s.ravel()[code].astype(np.int64).tobytes())], columns=["qb", "cb", "s", "code", "score"])

    missing = _pairs(asked, packed, c_blocks, wide, held.where("s >= 0").select("qb", "cb", "s", "code")).mapInPandas(resolve, _LIST)
    names = packed.where("s = 0").select(F.col("b").alias("cb"), F.col("ids").alias("c_ids"))
    q_names = asked.where("s = 0").select(F.col("b").alias("qb"), F.col("ids").alias("q_ids"), F.col("tau").alias("q_tau"))
    shares = held.where("s < 0").union(missing).groupBy("qb", "cb").agg(F.collect_list(F.struct("s", "code", "score")).alias("lists")).join(names, "cb").join(q_names, "qb")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                qi, ci, tau = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64), np.frombuffer(row.q_tau, np.float64)
                lists = sorted(((x["s"], np.frombuffer(x["code"], np.int64), np.frombuffer(x["score"], np.int64)) for x in row.lists), key=lambda x: x[0])
                every, total = lists[0][1], lists[0][2].copy()
                for _, code, score in lists[1:]:
                    total[np.searchsorted(every, code)] += score
                q, c = every // len(ci), every % len(ci)
                yes = total >= tau[q]
                yield pd.DataFrame({"query_id": qi[q[yes]], "vec_id": ci[c[yes]], "score": total[yes]})

    exact = shares.mapInPandas(add, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
