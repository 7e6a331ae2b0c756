"""Signals from past interactions: popularity, places, class votes, neighbours and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import distance_km
from tessera.operators.ranking import top_k
from tessera.operators.search import by_item, char_tfidf, small, unit
from tessera.sources.io import kept


def click_counts(events: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    return events.groupBy(text, item).agg(F.count(F.lit(1)).alias("n"))


def popularity(events: DataFrame, items: DataFrame | None = None, item: str = "item_id") -> DataFrame:
    """(item, popularity): log1p of the item's events; items without events have 0."""
    p = events.groupBy(item).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("popularity"))
    return p if items is None else items.select(item).distinct().join(p, item, "left").select(item, F.coalesce("popularity", F.lit(0.0)).alias("popularity"))


def location_probability(events: DataFrame, search: str = "search_location", place: str = "item_location") -> DataFrame:
    """P(place of the item | place of the search)."""
    c = events.groupBy(search, place).agg(F.count(F.lit(1)).alias("n"))
    return c.select(search, place, "n", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(search))).alias("prob"))


def location_centres(items: DataFrame, place: str = "item_location", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Exact medians of each place's coordinates; null ones are left out."""
    return items.groupBy(place).agg(F.percentile(F.col(lat), 0.5).alias("lat"), F.percentile(F.col(lon), 0.5).alias("lon"))


def location_mode(events: DataFrame, search: str = "search_location", place: str = "item_location") -> DataFrame:
    """The most frequent place for each search place; ties to the largest id."""
    c = events.groupBy(search, place).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(search).agg(F.max(F.struct("n", place))[place].alias("mode"))


def search_centres(events: DataFrame, centres: DataFrame, search: str = "search_location", place: str = "item_location") -> DataFrame:
    """Every search place's own centre, or that of its most frequent item place."""
    own = centres.select(F.col(place).alias(search), F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))
    alt = centres.select(F.col(place).alias("mode"), F.col("lat").alias("alt_lat"), F.col("lon").alias("alt_lon"))
    m = location_mode(events, search, place).join(own, search, "left").join(alt, "mode", "left")
    return m.select(search, F.coalesce("own_lat", "alt_lat").alias("lat"), F.coalesce("own_lon", "alt_lon").alias("lon"))


def location_scores(pairs: DataFrame, probs: DataFrame, centres: DataFrame, places: DataFrame, search: str = "search_location", place: str = "item_location") -> DataFrame:
    """pairs with same, prob and km. A search without any centre is far from everything."""
    a = centres.select(search, F.col("lat").alias("__a"), F.col("lon").alias("__b"))
    b = places.select(place, F.col("lat").alias("__c"), F.col("lon").alias("__d"))
    j = pairs.join(probs.select(search, place, "prob"), [search, place], "left").join(a, search, "left").join(b, place, "left")
    km = distance_km(F.col("__a"), F.col("__b"), F.col("__c"), F.col("__d"))
    return j.select(*pairs.columns, (F.col(search) == F.col(place)).cast("double").alias("same"), F.coalesce("prob", F.lit(0.0)).alias("prob"), km.alias("km"))


def class_votes(events: DataFrame, text: str = "text", cls: str = "class") -> DataFrame:
    """(text, class, vote): shares of the classes clicked for a text."""
    c = events.groupBy(text, cls).agg(F.count(F.lit(1)).alias("n"))
    return c.select(text, cls, (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(text))).alias("vote"))


def text_vectors(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, term, w): words and neighbouring words (0.8) beside character n-grams (0.6), each of unit length, then again."""
    t = texts.select(text).distinct()
    tok = F.filter(T.tokens(F.col(text)), lambda x: F.length(x) > 1)
    from tessera.operators.search import document_frequency, term_counts

    p = term_counts(t, text, T.word_features(tok))
    n = t.agg(F.count(F.lit(1)).alias("n_items"))
    w = p.join(document_frequency(p), "term").crossJoin(F.broadcast(n))
    w = unit(w.select("term", text, ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * (F.log((F.col("n_items") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w")), text)
    c = char_tfidf(t, text, T.tokens(F.col(text)))
    both = w.select(F.concat(F.lit("word "), "term").alias("term"), text, (F.col("w") * 0.8).alias("w")).union(c.select(F.concat(F.lit("char "), "term").alias("term"), text, (F.col("w") * 0.6).alias("w")))
    return unit(both, text)


def neighbours(vectors: DataFrame, k: int = 25, least: float = 0.10, text: str = "text", of: DataFrame | None = None) -> DataFrame:
    """(text, neighbour, sim): each text's k most similar texts, itself among them, above the least similarity; with `of`
    (text) of these texts only."""
    other = vectors.select("term", F.col(text).alias("neighbour"), F.col("w").alias("v"))
    s = (vectors if of is None else vectors.join(of.select(text), text, "left_semi")).join(other, "term").groupBy(text, "neighbour").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("sim"))
    return top_k(s.where(F.col("sim") > least), k, "sim", text, "neighbour").select(text, "neighbour", "sim")


def vote_features(near: DataFrame, votes: DataFrame, text: str = "text", cls: str = "class") -> DataFrame:
    """Votes of the neighbours by sim^5, normalised; a text with votes of its own counts these 0.75, the neighbours 0.25."""
    v = near.join(votes.withColumnRenamed(text, "neighbour"), "neighbour").groupBy(text, cls).agg(F.sum(F.pow("sim", F.lit(5.0)) * F.col("vote")).alias("s"))
    v = v.withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy(text))).select(text, cls, "p")
    known = votes.select(text).distinct().withColumn("known", F.lit(True))
    j = v.join(votes, [text, cls], "full").join(known, text, "left")
    p = F.coalesce("p", F.lit(0.0))
    return j.select(text, cls, F.when(F.col("known"), F.coalesce("vote", F.lit(0.0)) * 0.75 + p * 0.25).otherwise(p).alias("vote"))


def click_shares(near: DataFrame, clicks: DataFrame, text: str = "text") -> DataFrame:
    """(text, neighbour, share): what a click of the neighbour counts for the text; its own count whole, beside its share
    as its own neighbour."""
    own = clicks.select(F.col(text), F.col(text).alias("neighbour"), F.lit(1.0).alias("share")).distinct()
    return near.select(text, "neighbour", (F.lit(0.3) * F.pow("sim", F.lit(5.0))).alias("share")).union(own)


def click_evidence(near: DataFrame, clicks: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """log1p of the text's own clicks, plus 0.3 sim^5 log1p of each neighbour's (the text is a neighbour of itself).
    Clicks are dealt by item and meet the neighbours there, so what they give is summed up where it is made."""
    shares, _ = small(click_shares(near, clicks, text))
    c = kept(clicks)
    most = shares.groupBy("neighbour").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    c = by_item(c, c.count() * most, item).select(F.col(text).alias("__of"), item, "n")
    e = c.join(shares, F.col("__of").eqNullSafe(F.col("neighbour"))).select(text, item, (F.col("share") * F.log1p(F.col("n").cast("double"))).alias("e"))
    return e.groupBy(text, item).agg(F.sum("e").alias("evidence"))
