"""Gradient-boosted trees as Spark jobs: binned features, one histogram aggregation a step, leaf-wise growth, a table of nodes.

A query's pool is one packed row, so gradients need no shuffle; pools are bounded by the quotas of their channels. What
reaches the driver is one split a node.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.io import kept

NODES = "tree int, node int, feature string, threshold double, left int, right int, value double, gain double, n long"


@dataclass(frozen=True)
class Settings:
    """objective: lambdarank (pairs weighted by the NDCG they change, ranks up to `cut`) or logistic. leaves bounds a tree's
    leaves, which are split by the best gain first; depth, least_rows and least_gain bound its splits."""

    objective: str = "lambdarank"
    rounds: int = 20
    leaves: int = 31
    depth: int = 9
    rate: float = 0.1
    l2: float = 5.0
    least_rows: int = 30
    least_gain: float = 1e-9
    max_bin: int = 63
    cut: int = 50


#: Named settings, each a candidate of the registry.
REGISTRY = {
    "logistic_depth6": Settings("logistic", 60, 64, 6, 0.07),
    "logistic_depth8": Settings("logistic", 60, 128, 8, 0.07),
    "lambda31": Settings(rounds=60, leaves=31, rate=0.045),
    "lambda63": Settings(rounds=60, leaves=63, rate=0.045),
    "lambda_depth9": Settings(rounds=100, leaves=127, depth=9, rate=0.035, l2=10.0, least_rows=40, max_bin=127),
}


@dataclass(frozen=True)
class Model:
    """The nodes of all trees, as rows of NODES, and what they were trained with. A row goes right where its feature is
    above the threshold; null and NaN go left. Leaves have no feature; their value includes the rate."""

    nodes: tuple
    features: tuple
    settings: Settings
    metrics: dict = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(n) for n in self.nodes], NODES)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps([list(n) for n in self.nodes], separators=(",", ":")).encode()).hexdigest()

    def trees(self) -> list[list[tuple]]:
        out: dict[int, list] = {}
        for n in sorted(self.nodes, key=lambda x: (x[0], x[1])):
            out.setdefault(n[0], []).append(n)
        return list(out.values())

    def manifest(self) -> dict:
        return {"features": list(self.features), "settings": asdict(self.settings), "metrics": self.metrics, "fingerprint": self.fingerprint(), "n_nodes": len(self.nodes)}


def bin_edges(pool: DataFrame, features: list[str], max_bin: int = 63, accuracy: int = 10_000) -> dict[str, list[float]]:
    """At most max_bin - 1 different edges of each feature, from one pass of approximate quantiles."""
    shares = [i / max_bin for i in range(1, max_bin)]
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = pool.agg(*(F.percentile_approx(real(c), shares, accuracy).alias(f"e{i}") for i, c in enumerate(features))).first()
    return {c: sorted(set(r[f"e{i}"] or [])) for i, c in enumerate(features)}


def pack(pool: DataFrame, edges: dict[str, list[float]], q: str = "query_id", item: str = "item_id", label: str = "label") -> DataFrame:
    """(query, n, labels, bins): one row for each query's pool, in order of the item, with a byte a feature and row."""
    names, cuts = list(edges), [np.array(e) for e in edges.values()]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.zeros((len(pdf), len(names)), np.uint8)
        for i, c in enumerate(names):
            v = pdf[c].to_numpy(np.float64, na_value=np.nan)
            x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(cuts[i], v, side="left"))
        return pd.DataFrame({q: [pdf[q].iloc[0]], "n": [len(pdf)], "labels": [(pdf[label].to_numpy() > 0).astype(np.uint8).tobytes()], "bins": [x.tobytes()]})

    return pool.select(q, item, label, *names).groupBy(q).applyInPandas(packed, f"{q} {pool.schema[q].dataType.simpleString()}, n long, labels binary, bins binary")


def gradients(score: np.ndarray, label: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """What each row of one pool is drawn by, and the curvature. Equal scores are ranked in the pool's order."""
    if s.objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-score))
        return label - p, p * (1.0 - p)
    order = np.argsort(-score, kind="stable")
    rank = np.empty(len(score), np.int64)
    rank[order] = np.arange(1, len(score) + 1)
    discount = np.where(rank <= s.cut, 1.0 / np.log2(rank + 1.0), 0.0)
    up, down = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    g, h = np.zeros(len(score)), np.zeros(len(score))
    for i in up:  # few rows of a pool are relevant
        rho = 1.0 / (1.0 + np.exp(np.clip(score[i] - score[down], -500, 500)))
        w = rho * np.abs(discount[i] - discount[down])
        g[i] += w.sum()
        g[down] -= w
        w = w * (1.0 - rho)
        h[i] += w.sum()
        h[down] += w
    return g, h


@dataclass
class _Tree:
    """Splits by bin: feature (-1 for a leaf), bin, left and right node, value."""

    feature: list
    at: list
    left: list
    right: list
    value: list

    @staticmethod
    def root() -> _Tree:
        return _Tree([-1], [0], [0], [0], [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        k = len(self.feature)
        for x, v in ((self.feature, -1), (self.at, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            x += [v, v]
        self.feature[node], self.at[node], self.left[node], self.right[node] = feature, at, k, k + 1
        return k, k + 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        f, at, left, right = (np.array(x) for x in (self.feature, self.at, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := f[node] >= 0).any():
            over = bins[rows, np.maximum(f[node], 0)] > at[node]
            node = np.where(inner, np.where(over, right[node], left[node]), node)
        return node


_STATE = "{q} {kind}, n long, labels binary, bins binary, score binary, g binary, h binary"


def _advance(state: DataFrame, q: str, s: Settings, n_features: int, tree: _Tree | None) -> DataFrame:
    """The pools with their scores after a tree and the gradients there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = {c: b.column(c).to_pylist() for c in b.schema.names if c != q}
            score, g, h = [], [], []
            for k, n in enumerate(d["n"]):
                bins, label = np.frombuffer(d["bins"][k], np.uint8).reshape(n, n_features), np.frombuffer(d["labels"][k], np.uint8).astype(np.float64)
                now = np.zeros(n) if tree is None else np.frombuffer(d["score"][k], np.float64) + s.rate * np.array(tree.value)[tree.place(bins)]
                gk, hk = gradients(now, label, s)
                score.append(now.tobytes())
                g.append(gk.tobytes())
                h.append(hk.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (q, "n", "labels", "bins")), *(pa.array(x, pa.binary()) for x in (score, g, h))], names=[q, "n", "labels", "bins", "score", "g", "h"])

    return state.mapInArrow(run, _STATE.format(q=q, kind=state.schema[q].dataType.simpleString()))


def histograms(state: DataFrame, tree: _Tree, wanted: list[int], n_features: int, n_bins: int) -> DataFrame:
    """(node, feature, bin, n, g, h): sums over the rows of the wanted nodes. A task sends its own sums only."""
    slot = np.full(len(tree.feature), -1)
    slot[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(wanted) * n_features * n_bins))
        for b in batches:
            for n, bins, g, h in zip(*(b.column(c).to_pylist() for c in ("n", "bins", "g", "h")), strict=True):
                x = np.frombuffer(bins, np.uint8).reshape(n, n_features)
                at = slot[tree.place(x)]
                mine = at >= 0
                if mine.any():
                    key = ((at[mine, None] * n_features + np.arange(n_features)[None, :]) * n_bins + x[mine]).ravel()
                    for i, w in enumerate((None, np.frombuffer(g, np.float64), np.frombuffer(h, np.float64))):
                        total[i] += np.bincount(key, None if w is None else np.repeat(w[mine], n_features), minlength=total.shape[1])
        met = np.flatnonzero(total[0])
        node, rest = np.divmod(met, n_features * n_bins)
        cols = (np.array(wanted)[node].astype(np.int32), (rest // n_bins).astype(np.int32), (rest % n_bins).astype(np.int32), total[0, met].astype(np.int64), total[1, met], total[2, met])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "feature", "bin", "n", "g", "h"])

    parts = state.select("n", "bins", "g", "h").mapInArrow(run, "node int, feature int, bin int, n long, g double, h double")
    return parts.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "g", "h")))


def split_gains(hist: DataFrame, l2: float = 5.0, least_rows: int = 30) -> DataFrame:
    """(node, feature, bin, gain, n, g, h, left_n, left_g, left_h): what a split after each bin gains, of those that leave
    least_rows on both sides. A window holds the bins of one node and feature."""
    w = Window.partitionBy("node", "feature")
    to = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = hist.select("node", "feature", "bin", *(F.sum(x).over(to).alias(f"left_{x}") for x in ("n", "g", "h")), *(F.sum(x).over(w).alias(x) for x in ("n", "g", "h")))
    part = lambda g, h: g * g / (h + l2)
    right = lambda x: F.col(x) - F.col(f"left_{x}")
    gain = part(F.col("left_g"), F.col("left_h")) + part(right("g"), right("h")) - part(F.col("g"), F.col("h"))
    return c.withColumn("gain", F.round(gain, 9)).where((F.col("left_n") >= least_rows) & (right("n") >= least_rows))


def best_splits(gains: DataFrame) -> DataFrame:
    """The best split of each node; ties to the first feature, then the lowest bin."""
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n", "g", "h", "left_n", "left_g", "left_h")).alias("x")
    b = gains.groupBy("node").agg(best)
    return b.select("node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), *(F.col(f"x.{c}").alias(c) for c in ("gain", "n", "g", "h", "left_n", "left_g", "left_h")))


def _grow(state: DataFrame, s: Settings, n_features: int, n_bins: int) -> tuple[_Tree, dict]:
    """A tree that splits the leaf of the best gain first, and what is known of its nodes.

    A pass sums up all nodes that the best-first order may reach next, some of which it then leaves out; so a tree takes
    about as many passes as it has levels.
    """
    every, depth, best = _Tree.root(), {0: 0}, {}
    stats: dict[int, tuple] = {}

    def look(nodes: list[int]) -> None:
        for r in best_splits(split_gains(histograms(state, every, nodes, n_features, n_bins), s.l2, s.least_rows)).collect():
            if r["node"] == 0:
                stats[0] = (r["n"], r["g"], r["h"])
            if r["gain"] > s.least_gain:
                best[r["node"]] = r

    look([0])
    while True:
        heap, taken, unknown = ([(-best[0]["gain"], 0)] if 0 in best else []), [], []
        while heap and len(taken) + 1 < s.leaves:
            _, node = heapq.heappop(heap)
            taken.append(node)
            if every.feature[node] < 0:
                unknown.append(node)
                continue
            for child in (every.left[node], every.right[node]):
                if child in best and depth[child] < s.depth:
                    heapq.heappush(heap, (-best[child]["gain"], child))
        if not unknown:
            break
        wanted = []
        for node in unknown:
            b = best[node]
            kids = every.split(node, b["feature"], b["bin"])
            sides = ((b["left_n"], b["left_g"], b["left_h"]), (b["n"] - b["left_n"], b["g"] - b["left_g"], b["h"] - b["left_h"]))
            for kid, side in zip(kids, sides, strict=True):
                depth[kid], stats[kid] = depth[node] + 1, side
                if depth[kid] < s.depth and side[0] >= 2 * s.least_rows:
                    wanted.append(kid)
        if wanted:
            look(wanted)
    # Only the splits taken stay; the others end as leaves.
    tree, known, todo = _Tree.root(), {}, [(0, 0)]
    chosen = set(taken)
    while todo:
        old, new = todo.pop()
        n, g, h = stats.get(old, (0, 0.0, 0.0))
        known[new] = (best[old]["gain"] if old in chosen else None, n)
        tree.value[new] = g / (h + s.l2) if n else 0.0
        if old in chosen:
            kids = tree.split(new, every.feature[old], every.at[old])
            todo += list(zip((every.left[old], every.right[old]), kids, strict=True))
    return tree, known


def train(pool: DataFrame, features: list[str], s: Settings = Settings(), q: str = "query_id", item: str = "item_id", label: str = "label") -> Model:
    """Boosts s.rounds trees on the pools (query, item, label, features). Every round's scores are written, so a lost
    executor costs no earlier round. A pool has to fit in a row; queries without a relevant item teach a ranker nothing
    and stay. No rows give trees of one leaf, of value 0."""
    edges = bin_edges(pool, features, s.max_bin)
    n_bins = max(2, max((len(e) for e in edges.values()), default=0) + 1)
    state, tree, nodes = kept(pack(pool, edges, q, item, label)), None, []
    for t in range(s.rounds):
        state = kept(_advance(state, q, s, len(features), tree))
        tree, known = _grow(state, s, len(features), n_bins)
        for i, f in enumerate(tree.feature):
            gain, n = known[i]
            inner = f >= 0
            nodes.append((t, i, features[f] if inner else None, float(edges[features[f]][tree.at[i]]) if inner else None, tree.left[i] if inner else None, tree.right[i] if inner else None, None if inner else float(s.rate * tree.value[i]), gain, int(n)))
    return Model(tuple(nodes), tuple(features), s)


def as_column(nodes: list[tuple]) -> Column:
    """One tree as an expression: a flat choice between the paths to its leaves."""
    by, paths = {n[1]: n for n in nodes}, []
    todo = [(0, [])]
    while todo:
        k, path = todo.pop()
        _, _, feature, threshold, left, right, value, *_ = by[k]
        if feature is None:
            paths.append((path, value))
        else:
            over = F.coalesce((F.col(feature).cast("double") > threshold) & ~F.isnan(F.col(feature).cast("double")), F.lit(False))
            todo += [(right, [*path, over]), (left, [*path, ~over])]
    out = None
    for path, value in paths[:-1]:
        both = reduce(lambda a, b: a & b, path)
        out = F.when(both, F.lit(value)) if out is None else out.when(both, F.lit(value))
    return F.lit(paths[-1][1]) if out is None else out.otherwise(F.lit(paths[-1][1]))


def _outputs(x: np.ndarray, model: Model) -> np.ndarray:
    """Each row's value in each tree, from its features."""
    out, at = np.zeros((len(x), 0)), {f: i for i, f in enumerate(model.features)}
    for nodes in model.trees():
        f = np.array([-1 if n[2] is None else at[n[2]] for n in nodes])
        cut, left, right, value = (np.array([n[i] or 0 for n in nodes]) for i in (3, 4, 5, 6))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := f[node] >= 0).any():
            over = x[rows, np.maximum(f[node], 0)] > cut[node]  # never for NaN
            node = np.where(inner, np.where(over, right[node], left[node]), node)
        out = np.column_stack([out, value[node]])
    return out


#: Nodes that a model may have to be scored as an expression; a plan of more takes longer to compile than trees to walk.
COLUMN_NODES = 64


def score(pool: DataFrame, model: Model, out: str = "score", staged: bool = False, column_nodes: int = COLUMN_NODES) -> DataFrame:
    """pool with the model's score in place of a column of that name; staged: an array of the scores after each tree.
    A small model is one expression, a larger one walks its trees in Arrow batches, with the same sums in the same order."""
    rest = [c for c in pool.columns if c.lower() != out.lower()]
    if len(model.nodes) <= column_nodes:
        each = F.array(*(as_column(t) for t in model.trees()))
        if staged:
            start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all"))
            value = F.aggregate(each, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["all"], F.array(a["s"] + x)).alias("all")), lambda a: a["all"])
        else:
            value = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return pool.select(*(F.col(c) for c in rest), value.alias(out))
    slim = pool.select(F.struct(*rest).alias("row"), F.array(*(F.col(f).cast("double") for f in model.features)).alias("x"))
    kind = T.ArrayType(T.DoubleType()) if staged else T.DoubleType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            sums = np.cumsum(_outputs(x, model), axis=1)
            values = pa.array(list(sums), pa.list_(pa.float64())) if staged else pa.array(sums[:, -1])
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["row", "score"])

    done = slim.mapInArrow(run, T.StructType([slim.schema["row"], T.StructField("score", kind)]))
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in rest), F.col("score").alias(out))


def staged_recall(staged: DataFrame, truth: DataFrame, k: int = 50, score: str = "score", q: str = "query_id", item: str = "item_id") -> DataFrame:
    """(stage, recall): the mean recall at k of the queries with a relevant item, after each tree, from one pass of scores."""
    long = staged.select(q, item, F.posexplode(score).alias("stage", "s"))
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("stage", q).orderBy(F.desc("s"), item))).where(F.col("r") <= k)
    t = truth.select(q, item).distinct()
    found = top.join(t, [q, item], "left_semi").groupBy("stage", q).agg(F.count(F.lit(1)).alias("found"))
    size = t.groupBy(q).agg(F.count(F.lit(1)).alias("n"))
    stages = staged.limit(1).select(F.posexplode(score).alias("stage", "s")).select("stage")
    j = size.crossJoin(F.broadcast(stages)).join(found, ["stage", q], "left")
    return j.groupBy("stage").agg(F.avg(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall")).select((F.col("stage") + 1).cast("long").alias("stage"), "recall")


def best_stage(recalls: DataFrame, patience: int | None = None) -> DataFrame:
    """(stage, recall): the earliest best stage; with patience, of those before the recall stopped growing for so long."""
    r = recalls
    if patience is not None:
        up = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a tree
        r = r.withColumn("most", F.max(F.struct("recall", (-F.col("stage")).alias("s"))).over(up))
        late = r.where(F.col("stage") + F.col("most.s") >= patience).agg(F.min("stage").alias("end"))
        r = r.crossJoin(F.broadcast(late)).where(F.col("end").isNull() | (F.col("stage") <= F.col("end")))
    return r.agg(F.max(F.struct(F.round("recall", 9).alias("r"), (-F.col("stage")).alias("s"), "recall")).alias("x")).select((-F.col("x.s")).alias("stage"), "x.recall")


def truncated(model: Model, trees: int) -> Model:
    return Model(tuple(n for n in model.nodes if n[0] < trees), model.features, model.settings, model.metrics)


def save(spark: SparkSession, model: Model, path: str) -> None:
    """The node table and its manifest, as tables of one folder that Spark writes wherever the path leads."""
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(model.manifest(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, features: list[str] | None = None) -> Model:
    """The model of a folder, if its nodes are those that its manifest names and its features those expected."""
    m = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    nodes = tuple(tuple(r) for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect())  # bounded by the settings
    out = Model(nodes, tuple(m["features"]), Settings(**m["settings"]), m["metrics"])
    if out.fingerprint() != m["fingerprint"] or len(nodes) != m["n_nodes"]:
        raise ValueError(f"{path}: the nodes aren't those of the manifest")
    if features is not None and tuple(features) != out.features:
        raise ValueError(f"{path}: trained on other features")
    return out


def choose(models: dict[str, Model], metric: str = "validation_recall") -> str:
    """The name of the best model by a metric of its manifest; ties to the first name."""
    return min(models, key=lambda n: (-models[n].metrics[metric], n))
