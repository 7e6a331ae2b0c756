"""Recall, summaries, paired comparisons and candidate ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_per_query(ranked: DataFrame, truth: DataFrame, k: int = 50, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, n_relevant, n_found, recall) for each query of the truth; queries without answers have recall 0."""
    t = truth.select(q, item).distinct()
    hit = ranked.where(F.col("rank") <= k).select(q, item, F.lit(1).alias("hit")).distinct()
    j = t.join(hit, [q, item], "left").groupBy(q).agg(F.count(F.lit(1)).alias("n_relevant"), F.count("hit").alias("n_found"))
    return j.withColumn("recall", F.col("n_found").cast("double") / F.col("n_relevant"))


def summarize(per_query: DataFrame, flag: str = "cold") -> DataFrame:
    """One row: mean recall over all, cold and warm queries."""
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg(F.when(F.col(flag), F.col("recall"))).alias("recall_cold"), F.avg(F.when(~F.col(flag), F.col("recall"))).alias("recall_warm"))


def paired_delta(a: DataFrame, b: DataFrame, q: str = "query_id", eps: float = 1e-12) -> DataFrame:
    """One row: mean of b - a over the queries of both, its standard error, and how many queries got better or worse."""
    d = a.select(q, F.col("recall").alias("x")).join(b.select(q, F.col("recall").alias("y")), q).select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("standard_error"), F.sum(F.when(F.col("d") > eps, 1).otherwise(0)).cast("long").alias("improved"), F.sum(F.when(F.col("d") < -eps, 1).otherwise(0)).cast("long").alias("worsened"))


def ceiling(pool: DataFrame, truth: DataFrame, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """Recall of the whole pool."""
    return recall_per_query(pool.select(q, item, F.lit(1).alias("rank")), truth, 1, q, item)


def channel_recall(channels: DataFrame, truth: DataFrame, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """(channel, recall): macro recall of each channel's rows, in one pass over the long table."""
    t = truth.select(q, item).distinct()
    n = t.groupBy(q).agg(F.count(F.lit(1)).alias("n"))
    names = channels.select("channel").distinct()
    hit = channels.select(q, item, "channel").distinct().join(t, [q, item], "left_semi").groupBy(q, "channel").agg(F.count(F.lit(1)).alias("h"))
    j = n.crossJoin(F.broadcast(names)).join(hit, [q, "channel"], "left")
    return j.groupBy("channel").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def best_variant(metrics: DataFrame, metric: str = "recall", name: str = "variant", base: str | None = None, margin: float = 1e-12) -> DataFrame:
    """The best variant, ties to the first name; with a base, another wins only by more than the margin."""
    if base is None:
        return metrics.orderBy(F.desc(metric), name).limit(1)
    b = metrics.where(F.col(name) == base).select(F.col(metric).alias("__b"))
    ok = metrics.crossJoin(F.broadcast(b)).where((F.col(name) == base) | (F.col(metric) > F.col("__b") + margin)).drop("__b")
    return ok.orderBy(F.desc(metric), name).limit(1)
