"""Cosine search and scores over array columns, and checks of stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ranking import top_k

#: Queries of one block; blocks, not the whole query set, go to the workers.
BLOCK = 4096
#: Items of a shard that meets one block of queries.
SHARD = 16_384
#: Queries of a block that meet a shard at once: their scores are all that a task holds beside the two.
STRIP = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector of the text without any model: each word counts up or down, by its hash, in a component of its hash.
    Texts without words give zeros."""
    slots = F.transform(T.tokens(text), lambda w: F.xxhash64(w))
    at = lambda h, i: F.when(F.pmod(h, F.lit(dim)) == i, F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.lit(0.0))
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  a variable of a lambda: computed once a row
    sums = bound(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(s, F.lit(0.0), lambda t, h: t + at(h, i))))
    size = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, y: t + y * y)), F.lit(1e-12))
    return bound(sums, lambda v: bound(size(v), lambda n: F.transform(v, lambda x: x / n)))


def every(n: int) -> Column:
    """Copies of a row for the numbers 0 to n - 1, of the type of pmod(xxhash64, n): keys of other types hash elsewhere,
    and the two sides of a cogroup wouldn't meet."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def all_scores(queries: DataFrame, items: DataFrame, q: str = "query_id", item: str = "item_id", vector: str = "vector", block: int = 256, shard: int = 4096) -> DataFrame:
    """(query, item, score) of a stated query set with every item, for channels that rank the whole corpus. Blocks of
    queries meet shards of items; both stay small, whatever the tables' sizes."""
    kind, kind_q = items.schema[item].dataType.simpleString(), queries.schema[q].dataType.simpleString()
    blocks, shards = max(1, -(-queries.count() // block)), max(1, -(-items.count() // shard))
    at = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    qs = queries.select(F.col(q).alias("q"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", at("q", blocks)).withColumn("s", every(shards))
    its = items.select(F.col(item).alias("i"), F.col(vector).cast("array<double>").alias("v")).withColumn("s", at("i", shards)).withColumn("b", every(blocks))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({q: [], item: [], "score": []})
        s = np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T
        return pd.DataFrame({q: np.repeat(left["q"].to_numpy(), len(right)), item: np.tile(right["i"].to_numpy(), len(left)), "score": np.round(s.ravel(), 6)})

    return qs.groupBy("b", "s").cogroup(its.groupBy("b", "s")).applyInPandas(both, f"{q} {kind_q}, {item} {kind}, score double")


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame, q: str = "query_id", item: str = "item_id", vector: str = "vector") -> DataFrame:
    """The given pairs with the inner product of their vectors: two equi-joins."""
    a = queries.select(q, F.col(vector).alias("__a"))
    b = items.select(item, F.col(vector).alias("__b"))
    return pairs.join(a, q).join(b, item).select(q, item, dot(F.col("__a"), F.col("__b")).alias("score"))


def retrieve_top_k(queries: DataFrame, items: DataFrame, k: int, q: str = "query_id", item: str = "item_id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """Exhaustive top k by inner product, ties to smaller ids.

    Queries are packed into blocks of bounded size, which meet the items' batches one by one; each batch gives its own
    k best per query, and one window merges them. Items are never copied but for the number of query blocks.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    packed = queries.select(F.pmod(F.xxhash64(q), F.lit(blocks)).alias("b"), F.struct(F.col(q).alias("q"), F.col(vector).cast("array<double>").alias("v")).alias("x")).groupBy("b").agg(F.collect_list("x").alias("x")).collect() if blocks == 1 else None
    kind, kind_q = items.schema[item].dataType.simpleString(), queries.schema[q].dataType.simpleString()
    schema = f"{q} {kind_q}, {item} {kind}, score double"

    def against(ids, matrix, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f) or not len(ids):
                continue
            vectors, names = np.stack(f["v"].to_numpy()).astype(np.float64).T, f["i"].to_numpy()
            m = min(k, len(names))
            for at in range(0, len(ids), STRIP):
                s = matrix[at : at + STRIP] @ vectors
                cut = np.partition(s, len(names) - m, axis=1)[:, len(names) - m, None]
                a, b = np.nonzero(s >= cut - 2e-6)  # what rounds to the edge's score stays for the window, which rounds first
                yield pd.DataFrame({q: ids[at + a], item: names[b], "score": s[a, b]})

    flat = items.select(F.col(item).alias("i"), F.col(vector).alias("v"))
    if packed is not None:
        rows = packed[0]["x"] if packed else []
        ids, matrix = np.array([r["q"] for r in rows]), np.array([r["v"] for r in rows])
        shared = items.sparkSession.sparkContext.broadcast((ids, matrix))
        got = flat.mapInPandas(lambda frames: against(*shared.value, frames), schema)
    else:
        qs = queries.select(F.pmod(F.xxhash64(q), F.lit(blocks)).alias("b"), F.col(q).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        shards = max(1, -(-items.count() // SHARD))  # as many as keep a shard small, however many items there are
        its = flat.withColumn("s", F.pmod(F.xxhash64("i", F.lit(3)), F.lit(shards))).withColumn("b", every(blocks))
        each = qs.withColumn("s", every(shards))

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = list(against(left["q"].to_numpy(), np.stack(left["v"].to_numpy()) if len(left) else None, iter([right])))
            return pd.concat(out) if out else pd.DataFrame({q: [], item: [], "score": []})

        got = each.groupBy("b", "s").cogroup(its.groupBy("b", "s")).applyInPandas(both, schema)
    return top_k(got.withColumn("score", F.round("score", 6)), k, q=q, tie=item, positive=False)


def audit(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: rows, dimensions, non-finite rows, largest distance of a norm from 1, rows beyond 1e-5."""
    off = F.abs(norm(F.col(vector)) - 1.0)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size(vector)).cast("long").alias("min_dim"), F.max(F.size(vector)).cast("long").alias("max_dim"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("n_bad"), F.round(F.max(off), 5).alias("max_off"), F.sum(F.when(off > 1e-5, 1).otherwise(0)).cast("long").alias("n_off"),
    )


def contrastive_mask(batch: DataFrame, q: str = "query_id", item: str = "item_id", group: str = "batch") -> DataFrame:
    """(batch, a, b): pairs of rows of one batch that are no negatives of each other: same query or same item.

    One equi-join by query and one by item, so rows meet only those they match; a pair that has both comes by the query
    alone, so the pairs (many more than the rows) need not meet again. `pos` names a row within its batch.
    """
    rows = batch.select(group, q, item, "pos").distinct()
    x, y = (rows.select(group, F.col(q).alias(f"__q{n}"), F.col(item).alias(f"__i{n}"), F.col("pos").alias(n)) for n in ("a", "b"))
    y = y.withColumnRenamed(group, "__g")
    one = F.col(group) == F.col("__g")
    by_query = x.join(y, one & (F.col("__qa") == F.col("__qb"))).where("a <> b")
    by_item = x.join(y, one & (F.col("__ia") == F.col("__ib"))).where((F.col("a") != F.col("b")) & ~F.coalesce(F.col("__qa") == F.col("__qb"), F.lit(False)))
    return by_query.select(group, "a", "b").union(by_item.select(group, "a", "b"))
