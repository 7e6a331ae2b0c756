"""Openness of offers to remote work: flags, smoothed rates and expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import clip01


def smoothed_rate(rows: DataFrame, group: str, value: str, strength: float = 50.0, default: float = 0.10) -> DataFrame:
    """(group, n, rate) = (sum + strength * prior) / (n + strength); the prior is the mean over all rows, or the default."""
    v = F.col(value).cast("double")
    prior = rows.agg(F.coalesce(F.avg(v), F.lit(default)).alias("prior"))
    g = rows.groupBy(group).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"))
    return g.crossJoin(F.broadcast(prior)).select(group, "n", ((F.col("s") + strength * F.col("prior")) / (F.col("n") + strength)).alias("rate"))


def city_rows(events: DataFrame, items: DataFrame, search: str = "search_location", place: str = "item_location", cls: str = "class") -> DataFrame:
    """Events fit to learn from: their search place is one that an item has, in the corpus or the events (a city, not a
    region), and none of search place, item place and class is null. With `nonlocal`: the item is elsewhere."""
    cities = items.select(F.col(place).alias(search)).union(events.select(F.col(place).alias(search))).where(F.col(search).isNotNull()).distinct()
    ok = events.where(F.col(search).isNotNull() & F.col(place).isNotNull() & F.col(cls).isNotNull())
    return ok.join(cities, search, "left_semi").withColumn("nonlocal", (F.col(search) != F.col(place)).cast("double"))


def query_flags(queries: DataFrame, text: str = "text", params: str | None = None, chars: int = 1000) -> DataFrame:
    """queries with online, remote and nationwide wording of the text and the first `chars` of the filters."""
    c = F.col(text) if params is None else F.concat_ws(" ", F.coalesce(text, F.lit("")), F.substring(F.coalesce(params, F.lit("")), 1, chars))
    return queries.select("*", *T.flags(c))


def item_flags(items: DataFrame, title: str = "title", params: str = "params", description: str = "description", params_chars: int = 1000, chars: int = 1000) -> DataFrame:
    """items with item_remote (online or remote wording) and item_nationwide, over title and the cut other fields."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    online, remote, nationwide = T.flags(F.concat_ws(" ", F.coalesce(title, F.lit("")), cut(params, params_chars), cut(description, chars)))
    return items.select("*", (online | remote).alias("item_remote"), nationwide.alias("item_nationwide"))


def text_mean(rows: DataFrame, text: str, rate: str = "rate") -> DataFrame:
    return rows.groupBy(text).agg(F.avg(rate).alias("text_rate"))


def expected_rate(probs: DataFrame, rates: DataFrame, q: str = "query_id", cls: str = "class", prior: float = 0.10) -> DataFrame:
    """(query, expected): sum of p * rate over sum of p, the prior where nothing has a probability."""
    j = probs.join(rates.select(cls, "rate"), cls, "left").groupBy(q).agg(F.sum(F.when(F.col("rate").isNotNull(), F.col("prob") * F.col("rate"))).alias("a"), F.sum(F.when(F.col("rate").isNotNull(), F.col("prob"))).alias("b"))
    return j.select(q, clip01(F.when(F.coalesce("b", F.lit(0.0)) > 0, F.col("a") / F.col("b")).otherwise(F.lit(prior))).alias("expected"))


def openness(queries: DataFrame, exact: DataFrame, expected: DataFrame, given: DataFrame | None = None, q: str = "query_id", text: str = "text") -> DataFrame:
    """(query, prior): a rate given for the query, else the mean of its exact text, else the expectation over its classes."""
    j = queries.join(exact, text, "left").join(expected, q, "left")
    j = j.withColumn("given", F.lit(None).cast("double")) if given is None else j.join(given.select(q, F.col("rate").alias("given")), q, "left")
    return j.select(q, F.coalesce("given", "text_rate", "expected").alias("prior"))


def remote_aware(pool: DataFrame, relative: str = "bm25_rel", geo: str = "geo_bm25", openness: str = "openness") -> DataFrame:
    """pool with remote_aware_bm25: the relative score times the larger of openness and the geographic share."""
    share = F.when(F.col(relative) > 0, F.col(geo) / F.col(relative)).otherwise(F.lit(0.0))
    return pool.withColumn("remote_aware_bm25", F.col(relative) * F.greatest(F.col(openness), share))
