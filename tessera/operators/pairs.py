"""Training pairs of an encoder: normalised, capped, audited for leaks; and their epochs in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.split import cap_per_group, hash_order
from tessera.operators.validate import ordered_digest
from tessera.sources.io import kept

#: What must be 0 in pairs that may be trained on.
FAULTS = ("held_overlap", "cold_overlap", "empty_queries", "missing_texts")


@dataclass(frozen=True)
class Pairs:
    """pairs (query_norm, query_text, item_id, item_text), and one row of figures."""

    pairs: DataFrame
    stats: DataFrame


def _pair_key() -> Column:
    return F.concat_ws("\t", "query_norm", F.col("item_id").cast("string"))


def prepare_pairs(events: DataFrame, items: DataFrame, held: DataFrame | None = None, cold: DataFrame | None = None, cap: int = 5, seed: int = 42) -> Pairs:
    """Pairs of the events (text, item_id) with the items' texts (item_id, item_text), at most `cap` for each normalised text.

    Texts that are equal after normalising are one query, which carries the least of its spellings (null counts as
    empty); which items stay goes by hash. An item that repeats gives its least text. Items in `held` (item_id), texts in
    `cold` (text), empty queries and items without a text raise a ValueError that names their numbers, and no table is
    returned. They are observed while the pairs are written; a stage that Spark runs again may count twice, so input_rows
    can be too high after a loss, and the faults can't be missed.

    Repeated events meet before they are normalised, and the window of the cap stops at `cap` rows in each task, so a
    text that a third of the events have does not meet in one task.
    """
    seen, audit, spark = Observation(), Observation(), events.sparkSession
    raw = events.select(F.coalesce("text", F.lit("")).alias("query_text"), "item_id").observe(seen, F.count(F.lit(1)).alias("n"))
    once = raw.distinct().withColumn("query_norm", T.nfkc(F.col("query_text")))
    once = once.groupBy("query_norm", "item_id").agg(F.min("query_text").alias("query_text")).withColumn("pair", _pair_key())
    chosen = cap_per_group(once, "query_norm", "pair", cap, seed).drop("pair")
    texts = items.groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    out = chosen.join(texts, "item_id", "left")
    mark = lambda d, key, name: d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    none = lambda name: F.lit(None).cast("boolean").alias(name)
    out = out.join(mark(held, "item_id", "is_held"), "item_id", "left") if held is not None else out.select("*", none("is_held"))
    if cold is not None:
        norm = cold.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(T.nfkc(F.col("text")).alias("query_norm"))
        out = out.join(mark(norm, "query_norm", "is_cold"), "query_norm", "left")
    else:
        out = out.select("*", none("is_cold"))
    number = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = out.observe(
        audit, number(F.col("is_held"), "held_overlap"), number(F.col("is_cold"), "cold_overlap"),
        number(F.col("query_norm") == "", "empty_queries"), number(F.col("item_text").isNull(), "missing_texts"),
    )
    pairs = kept(out.select("query_norm", "query_text", "item_id", "item_text"))
    found, n = audit.get, seen.get
    wrong = {k: found.get(k, 0) for k in FAULTS if found.get(k, 0)}
    if wrong:
        raise ValueError(f"pairs can't be trained on: {wrong}")
    figures = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_norm").alias("query_texts"), F.count_distinct("item_id").alias("items"))
    digest = ordered_digest(pairs.select(_pair_key().alias("pair")), "pair", "pair").select("fingerprint")
    stats = figures.crossJoin(F.broadcast(digest))  # one row each
    return Pairs(pairs, stats.select(F.lit(n.get("n", 0)).cast("long").alias("input_rows"), "*", F.lit(cap).cast("long").alias("cap"), *(F.lit(0).cast("long").alias(k) for k in FAULTS)))


def epoch_batches(pairs: DataFrame, epochs: int, batch_size: int, max_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """(epoch, batch, pos, and the pairs' columns): each epoch's pairs in an order of their own by hash, the first
    max_pairs of it, cut into batches; all numbers from 0.

    Places come from ranges of that order, each numbered by its own task from where the earlier ones end: no task sorts
    an epoch. Pairs are unique by (query_norm, item_id).
    """
    each = pairs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else pairs.withColumn("epoch", F.lit(0)).limit(0)
    salted = F.concat_ws("|", _pair_key(), F.col("epoch").cast("string"))
    r = each.withColumn("__h", hash_order(salted, seed)).withColumn("__k", _pair_key())
    r = kept(r.repartitionByRange("epoch", "__h", "__k").withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy("epoch").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = r.groupBy("epoch", "__p").agg(F.count(F.lit(1)).alias("n")).select("epoch", "__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy("epoch", "__p").orderBy("__h", "__k")) - 1
    r = r.withColumn("__at", at).join(starts, ["epoch", "__p"]).withColumn("__at", F.col("__at") + F.col("__start"))
    if max_pairs is not None:
        r = r.where(F.col("__at") < max_pairs)
    return r.select(F.col("epoch").cast("long").alias("epoch"), F.floor(F.col("__at") / batch_size).alias("batch"), (F.col("__at") % batch_size).cast("long").alias("pos"), *pairs.columns)
