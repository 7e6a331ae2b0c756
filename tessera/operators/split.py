"""Leakage-safe splitting: query keys, apportionment, hash-ordered sampling, holdouts and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.io import kept


#: The parts of a holdout.
SPLITS = ("validation", "ranker_train")


def query_key(*fields: Column) -> Column:
    """One hash of the normalised search fields: equal fields, equal keys."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def hash_order(key: Column, seed: int) -> Column:
    """An order that looks random and is the same in every run and engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def apportion(counts: DataFrame, total: int, key: str = "stratum", n: str = "n") -> DataFrame:
    """(key, n, quota): largest remainders; quotas sum to the total. The table holds one row a stratum."""
    every = counts.agg(F.sum(n).alias("__all"))
    x = counts.crossJoin(F.broadcast(every)).withColumn("share", F.col(n) * float(total) / F.col("__all"))
    x = x.withColumn("base", F.floor("share"))
    left = x.agg((F.lit(total) - F.sum("base")).alias("__left"))
    r = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), key))
    return x.crossJoin(F.broadcast(left)).withColumn("r", r).select(key, n, (F.col("base") + F.when(F.col("r") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, seed: int, key: str, stratum: str = "stratum") -> DataFrame:
    """The first `quota` rows of each stratum by hash; rows of a stratum without a quota go."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    s = rows.withColumn("r", F.row_number().over(w)).join(F.broadcast(quotas.select(stratum, "quota")) if quotas.count() <= 10_000 else quotas.select(stratum, "quota"), stratum)
    return s.where(F.col("r") <= F.col("quota")).drop("r", "quota")


def assign_texts(rows: DataFrame, text: str, stratum: str, seed: int) -> DataFrame:
    """One row for each text: the scarcest of its strata, and there the first by hash, so that no text is used twice."""
    size = rows.groupBy(stratum).agg(F.count_distinct(text).alias("__size"))
    w = Window.partitionBy(text).orderBy("__size", stratum, hash_order(F.concat_ws("|", F.col(text), F.col(stratum)), seed))
    return rows.join(size, stratum).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__size")


def sample_with_fallback(rows: DataFrame, quotas: DataFrame, seed: int, key: str, total: int, stratum: str = "stratum") -> tuple[DataFrame, DataFrame]:
    """The stratified sample filled up to the total from unused rows by hash, and (stratum, quota, got, short)."""
    s = stratified_sample(rows, quotas, seed, key, stratum).withColumn("__tier", F.lit(0))
    rest = rows.join(s.select(key), key, "left_anti").withColumn("__tier", F.lit(1))
    out = s.unionByName(rest).orderBy("__tier", hash_order(F.col(key), seed + 1), key).limit(total).drop("__tier")
    got = s.groupBy(stratum).agg(F.count(F.lit(1)).alias("got"))
    log = quotas.select(stratum, "quota").join(got, stratum, "left").select(stratum, "quota", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("short"))
    return out, log


def cap_per_group(rows: DataFrame, group: str, key: str, cap: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def cold_flags(queries: DataFrame, history: DataFrame, text: str = "text") -> DataFrame:
    """queries with `cold`: the text has no history."""
    known = history.select(text).distinct().withColumn("__known", F.lit(True))
    return queries.join(known, text, "left").withColumn("cold", F.col("__known").isNull()).drop("__known")


def cold_quota(queries: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """queries with `forced`: cold ones, and by hash as many of the others as the share still asks for. Keys are unique."""
    n, cold = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("cold").cast("long")), F.lit(0))).first()
    more = queries.where(~F.col("cold")).select(key).orderBy(hash_order(F.col(key), seed), key).limit(max(math.ceil(n * share) - cold, 0))
    return queries.join(more.withColumn("__more", F.lit(True)), key, "left").withColumn("forced", F.col("cold") | F.col("__more").isNotNull()).drop("__more")


def dense_codes(rows: DataFrame, column: str, out: str = "code") -> DataFrame:
    """rows with a number from 0 for each value of the column (a class or a label: few values), in their order."""
    codes = rows.select(column).where(F.col(column).isNotNull()).distinct()
    codes = codes.withColumn(out, F.dense_rank().over(Window.orderBy(column)).cast("long") - 1)
    return rows.join(codes, column, "left")


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, whose keys must not repeat: else a ValueError, before anything is joined."""
    if right.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats on the side that must be unique")
    return left.join(right, key, "left")


def fit_rows(events: DataFrame, held: DataFrame, cold_texts: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Events whose item isn't held out and whose text isn't cold: two anti joins, so nulls are kept."""
    return events.join(held.select(item).distinct(), item, "left_anti").join(cold_texts.select(text).distinct(), text, "left_anti")


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables, one row a key; rows of the first win."""
    u = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(key).orderBy("__p", *[c for c in first.columns if c != key])
    return u.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__p", "__r")


def leakage(fit: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """(key, shared): values that both tables have; all must be 0."""
    out = None
    for k in keys:
        n = fit.select(k).distinct().join(held.select(k).distinct(), k, "left_semi").agg(F.count(F.lit(1)).alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = n if out is None else out.union(n)
    return out


@dataclass(frozen=True)
class Holdout:
    """queries (qkey, text, stratum, split, cold), targets (qkey, item), held items, fit events, and the log of the strata."""

    queries: DataFrame
    targets: DataFrame
    held: DataFrame
    fit: DataFrame
    log: DataFrame


def sample_texts(contexts: DataFrame, asked: DataFrame, sizes: dict[str, int], seed: int) -> tuple[DataFrame, DataFrame]:
    """(qkey, text, stratum, split) of texts drawn for the strata, and (stratum, wanted, got, short).

    contexts (qkey, text, stratum): a text may stand in several strata. asked (stratum, n): how often each stratum is asked
    for; each split's size is apportioned by it. Strata are drawn one after the other, the scarcest first (texts for each
    place, then the name): from the texts that no earlier stratum took, the first by hash, of which the first share goes
    to the first split. What a split still lacks is filled with unused texts of any stratum by hash. A drawn text takes
    one of its contexts by hash. A stratum is one pass over the texts and a limit; what it takes is at most the sizes.
    """
    order = lambda c: hash_order(F.col(c), seed)
    texts = kept(contexts.select("stratum", "text").distinct())
    quotas = None
    for name, total in sizes.items():
        a = apportion(asked, total).select("stratum", F.col("quota").alias(name))
        quotas = a if quotas is None else quotas.join(a, "stratum")
    have = texts.groupBy("stratum").agg(F.count(F.lit(1)).alias("have"))
    wanted = F.lit(0)
    for name in sizes:
        wanted = wanted + F.col(name)
    strata = quotas.join(have, "stratum", "left").fillna(0, ["have"]).withColumn("wanted", wanted).orderBy(F.col("have") / F.greatest("wanted", F.lit(1)), "stratum").collect()  # a row a stratum
    spark, schema = contexts.sparkSession, "text string, stratum string, split string"
    drawn, log, (first, second) = spark.createDataFrame([], schema), [], sizes
    rows: list[tuple] = []
    for s in strata:
        free = texts.where(F.col("stratum") == s["stratum"]).join(F.broadcast(drawn.select("text")), "text", "left_anti")  # at most the sizes' sum
        got = [r["text"] for r in free.orderBy(order("text"), "text").limit(s["wanted"]).collect()] if s["wanted"] else []
        ahead = min(len(got), math.floor(len(got) * s[first] / max(1, s["wanted"]) + 0.5))
        rows += [(x, s["stratum"], first if i < ahead else second) for i, x in enumerate(got)]
        log.append((s["stratum"], s["wanted"], len(got), s["wanted"] - len(got)))
        drawn = spark.createDataFrame(rows, schema)
    for name, size in sizes.items():
        missing = size - sum(r[2] == name for r in rows)
        if missing > 0:
            free = texts.select("text").distinct().join(F.broadcast(drawn.select("text")), "text", "left_anti")
            rows += [(r["text"], None, name) for r in free.orderBy(order("text"), "text").limit(missing).collect()]
            drawn = spark.createDataFrame(rows, schema)
    j = contexts.join(F.broadcast(drawn.withColumnRenamed("stratum", "of")), "text").where(F.col("of").isNull() | (F.col("of") == F.col("stratum")))
    one = F.row_number().over(Window.partitionBy("text").orderBy(hash_order(F.col("qkey"), seed + 1), "qkey"))
    picked = j.withColumn("r", one).where("r = 1").select("qkey", "text", "stratum", "split")
    return picked, spark.createDataFrame(log, "stratum string, wanted long, got long, short long")


def build_holdout(events: DataFrame, asked: DataFrame, known_texts: DataFrame, sizes: tuple[int, int] = (1500, 4500), seed: int = 17, most_items: int = 15, cold_share: float | None = None) -> Holdout:
    """Holds out queries of the events (qkey, text, stratum, item_id, ...) for validation and for training a ranker.

    Query groups of 1 to most_items different items are eligible. Texts are drawn for strata as often as `asked` (text,
    stratum) asks for them, a quarter at most for validation. All events of the items of drawn groups leave the fit
    events; texts without any event left are cold, and by hash as many others are made cold, and leave too, as the share
    asks for: by default that of the asked texts which known_texts lacks. Ends with a check that nothing leaks.
    """
    e = kept(events)
    pairs = e.select("qkey", "item_id").distinct()
    groups = pairs.groupBy("qkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(1, most_items))
    contexts = kept(e.select("qkey", "text", "stratum").distinct().join(groups.select("qkey"), "qkey", "left_semi"))
    total = min(sum(sizes), contexts.select("text").distinct().count())
    ahead = min(sizes[0], total // 4)
    picked, log = sample_texts(contexts, asked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), dict(zip(SPLITS, (ahead, total - ahead), strict=True)), seed)
    picked = kept(picked)
    targets = kept(pairs.join(F.broadcast(picked.select("qkey")), "qkey", "left_semi"))  # at most the sizes' sum
    held = kept(targets.select("item_id").distinct())
    left = e.join(held, "item_id", "left_anti")
    if cold_share is None:
        cold_share = asked.join(known_texts.select("text").distinct().withColumn("known", F.lit(True)), "text", "left").agg(F.avg(F.col("known").isNull().cast("double"))).first()[0] or 0.0
    flagged, out = kept(cold_flags(picked, left)), None
    for name in SPLITS:
        part = cold_quota(flagged.where(F.col("split") == name), cold_share, seed + 2, "qkey")
        out = part if out is None else out.union(part)
    queries = kept(out.select("qkey", "text", "stratum", "split", F.col("forced").alias("cold")))
    fit = kept(fit_rows(e, held, queries.where("cold").select("text")))
    warm = queries.where("NOT cold").join(fit.select("text").distinct(), "text", "left_anti").limit(1).count()
    shared = leakage(fit, held, ["item_id"]).first()["shared"] + leakage(fit, queries.where("cold"), ["text"]).first()["shared"]
    if shared or warm or queries.groupBy("text").count().where("count > 1").limit(1).count():
        raise ValueError("the holdout leaks")
    return Holdout(queries, targets, held, fit, log)
