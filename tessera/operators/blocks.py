"""A stated query set against every item, where the items are: no pair of query and item is written or sent before it is chosen.

An item is a row with its vector and its postings of the queries' terms; queries go to the workers in blocks, as matrices.
Whatever asks for the scores again (the best of each query, each channel's quota, the chosen pairs) makes them again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the repository

#: Queries of one block.
BLOCK = 1024
#: Pairs whose scores a task holds at once.
PAIRS = 1 << 19
#: Rows of a channel that a task holds beyond its quotas before it drops those that can't be among them.
SPARE = 1 << 19


def item_postings(channels: dict[str, DataFrame], item: str = "item_id") -> DataFrame:
    """(item, postings): an item's (channel, term, w) of all channels' tables (term, item, w) in one row."""
    rows = None
    for k, d in channels.items():
        d = d.select(F.col(item), F.struct(F.lit(k).alias("channel"), "term", F.col("w").cast("double").alias("w")).alias("p"))
        rows = d if rows is None else rows.union(d)
    return rows.groupBy(item).agg(F.collect_list("p").alias("postings"))


class Block:
    """Queries of one block, on the driver and by broadcast: their ids, vectors, and terms by channel.

    rounded: channels whose sums are rounded to six digits, as search.search() does.
    """

    def __init__(self, ids: list, vectors: np.ndarray | None, terms: dict[str, list[tuple]], rounded: set[str]):
        """terms: by channel (query, term, weight)."""
        self.ids, self.vectors, self.rounded, self.terms = np.array(ids), vectors, rounded, {}
        at = {q: i for i, q in enumerate(ids)}
        for k, rows in terms.items():
            rows = sorted((t, at[q], float(w)) for q, t, w in rows)
            names = sorted({t for t, _, _ in rows})
            n = pd.Series([t for t, _, _ in rows], dtype=object).groupby([t for t, _, _ in rows], sort=True).size().to_numpy() if rows else np.zeros(0, int)
            self.terms[k] = (names, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), np.array([q for _, q, _ in rows], np.int64), np.array([w for _, _, w in rows]))

    def shared(self, spark: SparkSession):
        """The block for the workers, in types that they know without this module."""
        return spark.sparkContext.broadcast((self.ids, self.vectors, self.terms, self.rounded))


def scores(block: tuple, vectors: pa.Array | None, postings: pa.Array) -> dict[str, np.ndarray]:
    """Matrices of items by queries: each channel's sums, and `dense` if there are vectors."""
    ids, of_queries, terms, rounded = block
    n, m = len(postings), len(ids)
    flat = postings.flatten()
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(postings), 0).to_numpy(zero_copy_only=False))
    channel, term, weight = (flat.field(i) for i in range(3))
    out = {}
    for k, (names, starts, queries, weights) in terms.items():
        found = np.zeros(n * m)
        if names and len(flat):
            mine = pc.equal(channel, k).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(term, value_set=pa.array(names, term.type)), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(mine & (at >= 0))
            each = starts[at[hit] + 1] - starts[at[hit]]
            place = np.repeat(starts[at[hit]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            w = np.repeat(weight.to_numpy(zero_copy_only=False)[hit], each) * weights[place]
            if len(w):  # or the zeros would be whole numbers
                found = np.bincount(np.repeat(row[hit], each) * m + queries[place], weights=w, minlength=n * m)
        out[k] = (np.round(found, 6) if k in rounded else found).reshape(n, m)
    if vectors is not None:
        v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        out["dense"] = np.round(v @ of_queries.T, 6)
    return out


def _parts(block: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    step = max(1, PAIRS // max(1, len(block[0])))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, scores(block, part.column("vector") if "vector" in part.schema.names else None, part.column("postings"))


def best(items: DataFrame, block: Block, names: list[str], item: str = "item_id") -> dict[str, np.ndarray]:
    """Each query's best score over all items, by channel; 0 at least. A task gives one row a query."""
    shared = block.shared(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {k: np.zeros(len(shared.value[0])) for k in names}
        for _, s in _parts(shared.value, batches):
            for k in names:
                most[k] = np.maximum(most[k], s[k].max(axis=0))
        yield pa.RecordBatch.from_pydict({"q": np.arange(len(shared.value[0])), **most})

    rows = items.select(*(c for c in ("vector", "postings") if c in items.columns)).mapInArrow(run, "q long, " + ", ".join(f"`{k}` double" for k in names)).groupBy("q").agg(*(F.max(k).alias(k) for k in names)).collect()
    out = {k: np.zeros(len(block.ids)) for k in names}
    for r in rows:
        for k in names:
            out[k][r["q"]] = r[k]
    return out


class _Quota:
    """The best rows of each query of one channel, as a task has seen them: score, then the smaller item."""

    def __init__(self, n: int, quota: int):
        self.quota, self.rows, self.size, self.full = quota, [], 0, n * quota
        self.edge, self.edge_item, self.has = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        take = (s > self.edge) | (self.has & (s == self.edge) & (ids[:, None] < self.edge_item))
        a, q = np.nonzero(take)
        self.rows.append((q, s[a, q], ids[a]))
        self.size += len(q)
        if self.size > self.full + SPARE:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, i = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.quota - 1
        self.edge[q[last]], self.edge_item[q[last]], self.has[q[last]] = s[last], i[last], True
        stay = place < self.quota
        q, s, i = q[stay], s[stay], i[stay]
        self.rows, self.size = [(q, s, i)], len(q)
        return q, s, i


def within_quotas(items: DataFrame, block: Block, blend: Callable[[pa.RecordBatch, dict], dict[str, np.ndarray]], columns: list[str], quotas: dict[str, int], item: str = "item_id", kind_q: str = "bigint") -> DataFrame:
    """(query, item, channel, score): each task's rows that a channel may take for its quota, positive ones only. Whole
    numbers name items. blend(items with `columns`, scores) gives the channels' matrices."""
    shared = block.shared(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        held = {k: _Quota(len(ids), n) for k, n in quotas.items()}
        for part, s in _parts(shared.value, batches):
            name = part.column("item_id").to_numpy(zero_copy_only=False)
            for k, v in blend(part, s).items():
                held[k].add(name, v)
        for k, h in held.items():
            q, s, i = h.cut()
            yield pa.RecordBatch.from_pydict({"query_id": ids[q], "item_id": i, "channel": pa.array([k] * len(q), pa.string()), "score": s})

    return items.select(F.col(item).alias("item_id"), "vector", "postings", *columns).mapInArrow(run, f"query_id {kind_q}, item_id long, channel string, score double")


def chosen(items: DataFrame, block: Block, columns: list[str], always: str, kind_q: str = "bigint") -> DataFrame:
    """The items' columns with `pairs`, an array of (query_id, a score a channel): the queries in an item's `picked` (array)
    and those whose channel `always` is positive. Items without any are left out."""
    shared = block.shared(items.sparkSession)
    names = [*block.terms, "dense"]
    q_type = T.LongType() if kind_q == "bigint" else T.IntegerType()
    pair = T.StructType([T.StructField("query_id", q_type), *(T.StructField(k, T.DoubleType()) for k in names)])
    schema = T.StructType([*(items.schema[c] for c in columns), T.StructField("pairs", T.ArrayType(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        order = np.argsort(ids)
        for part, s in _parts(shared.value, batches):
            take = s[always] > 0
            picked = part.column("picked")
            q = picked.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(picked), 0).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(ids, q, sorter=order), len(ids) - 1)
            mine = ids[order[at]] == q if len(q) else np.zeros(0, bool)
            take[row[mine], order[at][mine]] = True
            a, b = np.nonzero(take)
            fields = [pa.array(ids[b], pa.int64() if kind_q == "bigint" else pa.int32()), *(pa.array(s[k][a, b]) for k in names)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(take.sum(axis=1))]), pa.int32())
            pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["query_id", *names]))
            has = pa.array(take.any(axis=1))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pairs], [*columns, "pairs"]).filter(has)

    return items.select(*columns, "vector", "postings", "picked").mapInArrow(run, schema)


def sums(items: DataFrame, block: Block, weights: dict[str, np.ndarray], item: str = "item_id", q: str = "query_id", kind_q: str = "bigint") -> DataFrame:
    """(query, item, score): channels' scores, each times the query's weight, summed up; positive ones only."""
    shared = block.shared(items.sparkSession)
    kind = items.schema[item].dataType.simpleString()
    whole = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}.get(kind_q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _parts(shared.value, batches):
            total = sum(s[k] * w for k, w in weights.items())
            a, b = np.nonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][b], whole), part.column(item).take(pa.array(a)), pa.array(total[a, b])], [q, item, "score"])

    return items.select(item, "postings").mapInArrow(run, f"`{q}` {kind_q}, `{item}` {kind}, score double")
