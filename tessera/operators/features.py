"""Channel scores, candidate pools and the 41 base features of a (query, item) pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import flag, geo_blend, log_positive
from tessera.operators.ranking import augment, augment_counted
from tessera.operators.search import small

#: The order of the features is a contract with trained models.
FEATURES = [
    "bm25", "bm25_relative", "char", "char_relative", "dense", "dense_relative", "title_bm25", "title_relative", "params_bm25", "microcat_probability",
    "same_location", "location_probability", "log_distance", "near_10km", "near_50km", "history_click", "item_popularity", "rating", "log_reviews", "log_price",
    "phone_hidden", "message_forbidden", "category_match", "query_tokens", "title_tokens", "title_coverage", "description_coverage", "params_coverage", "exact_title", "exact_description",
    "filter_coverage", "rating_filter_satisfied", "has_filters", "geo_bm25", "geo_dense", "microcat_bm25", "microcat_dense",
    "supervised_microcat", "supervised_microcat_relative", "supervised_microcat_rank", "microcat_confidence",
]
#: The sources of the pool windows, in the order of the columns after the 41 features.
WINDOW_SOURCES = ["bm25", "geo_bm25", "title_bm25", "char", "dense", "microcat_probability", "supervised_microcat"]
#: Candidates of each channel.
QUOTAS = {"word": 250, "char": 150, "dense": 250, "geo_bm25": 300, "geo_dense": 250, "microcat_bm25": 200, "microcat_dense": 150, "rule": 150}
TINY_QUOTAS = {"tiny": 200, "tiny_geo": 450, "tiny_microcat": 250, "tiny_rule": 150}


def channel_scores(w: Column, c: Column, d: Column, geo: Column, vote: Column, supervised: Column, greatest=F.greatest) -> dict[str, Column]:
    """Blends of relative lexical, character and dense scores with place and class; of matrices with NumPy's maximum."""
    m = greatest(vote, supervised * 0.7)
    return {
        "geo_bm25": w * (geo * 0.85 + 0.15),
        "geo_dense": d * (geo * 0.85 + 0.15),
        "microcat_bm25": w * (m * 0.8 + 0.2) * (geo * 0.75 + 0.25),
        "microcat_dense": d * (m * 0.8 + 0.2) * (geo * 0.75 + 0.25),
        "rule": (w * 0.48 + c * 0.18 + d * 0.34) * (geo * 0.85 + 0.15) * (m * 0.6 + 0.4),
    }


def all_features(base: DataFrame, counted: bool = False) -> DataFrame:
    """The 41 base features and, after them, the three pool windows of each of the seven sources: 62 columns in order.
    counted: the windows come from counts of each score, so base is made twice, and its rows aren't sent."""
    names = [f"pool_{k}_{s}" for s in WINDOW_SOURCES for k in ("percentile", "gap_best", "gap_50")]
    return (augment_counted if counted else augment)(base, WINDOW_SOURCES).select("query_id", "item_id", *FEATURES, *names)


def long_channels(pool: DataFrame, columns: dict[str, str], q: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, item, channel, score) of the named columns: one explode instead of a union of scans."""
    each = F.array(*(F.struct(F.lit(ch).alias("channel"), F.col(c).cast("double").alias("score")) for ch, c in columns.items()))
    return pool.select(q, item, F.explode(each).alias("x")).select(q, item, "x.channel", "x.score")


def filter_tokens(filters: Column, noise: tuple = T.FILTER_NOISE) -> Column:
    return F.array_except(T.tokens(filters), F.array(*(F.lit(x) for x in noise)))


def has_filters(filters: Column) -> Column:
    return F.length(F.btrim(F.coalesce(filters, F.lit("")))) > 0


def base_features(pairs: DataFrame, noise: tuple = T.FILTER_NOISE) -> DataFrame:
    """pairs as (query_id, item_id, the 41 features).

    Expected columns: scores bm25, char, dense, title_bm25 with their relatives *_rel (taken before pooling), params_bm25;
    vote, supervised, supervised_rel, supervised_rank, confidence; same, prob, km; clicks, popularity; the item's title,
    params, description, item_category, rating, reviews, price, phone_hidden, message_forbidden; the query's text,
    filters, search_category. Nulls count as 0. Token arrays text_tok, title_tok, params_tok and description_tok,
    and description_coverage, exact_title, exact_description, query_tokens, title_tokens, title_coverage,
    params_coverage, filter_coverage, rating_filter_satisfied and has_filters, are taken as they are where pairs has them: callers work them out once for
    each item or query, or from terms, instead of for each pair.
    """
    have = set(pairs.columns)
    c = F.col
    ft = [] if "filter_coverage" in have else [filter_tokens(c("filters"), noise).alias("__filters")]
    # Tokens are needed only where what comes of them isn't there.
    of = {"text": {"query_tokens", "title_coverage", "params_coverage", "description_coverage"}, "title": {"title_tokens", "title_coverage"}, "params": {"params_coverage", "filter_coverage"}, "description": {"description_coverage"}}
    asked = [x for x in of if of[x] - have]
    d = pairs if not asked and not ft else T.once(pairs, *((c(f"{x}_tok") if f"{x}_tok" in have else T.tokens(c(x))).alias(f"__{x}") for x in asked), *ft)
    geo = geo_blend(c("same"), c("prob"), c("km"))
    ch = channel_scores(c("bm25_rel"), c("char_rel"), c("dense_rel"), geo, c("vote"), c("supervised_rel"))
    one = lambda x: x.cast("double")
    distinct = lambda x: F.size(F.array_distinct(c(x)))
    rating = F.coalesce(one(c("rating")), F.lit(0.0))
    text = lambda name, f: c(name) if name in have else f()
    values = [
        c("bm25"), c("bm25_rel"), c("char"), c("char_rel"), c("dense"), c("dense_rel"), c("title_bm25"), c("title_rel"), c("params_bm25"), c("vote"),
        c("same"), c("prob"), F.log1p(c("km")), c("km") < 10, c("km") < 50, c("clicks"), c("popularity"), rating, log_positive(c("reviews")), log_positive(c("price")),
        flag(c("phone_hidden")), flag(c("message_forbidden")), (c("item_category") == c("search_category")) | (c("search_category") == 0), text("query_tokens", lambda: distinct("__text")), text("title_tokens", lambda: distinct("__title")),
        text("title_coverage", lambda: T.coverage(c("__text"), c("__title"))), text("description_coverage", lambda: T.coverage(c("__text"), c("__description"))), text("params_coverage", lambda: T.coverage(c("__text"), c("__params"))), text("exact_title", lambda: T.contains_literal(c("title"), c("text"))), text("exact_description", lambda: T.contains_literal(c("description"), c("text"))),
        text("filter_coverage", lambda: T.coverage(c("__filters"), c("__params"))), text("rating_filter_satisfied", lambda: rating >= T.minimum_rating(c("filters"))), text("has_filters", lambda: has_filters(c("filters"))), ch["geo_bm25"], ch["geo_dense"], ch["microcat_bm25"], ch["microcat_dense"],
        c("supervised"), c("supervised_rel"), F.lit(1.0) / c("supervised_rank"), c("confidence"),
    ]
    return d.select("query_id", "item_id", *(F.coalesce(one(v), F.lit(0.0)).alias(n) for n, v in zip(FEATURES, values, strict=True)))


def compatible_geography(same: str = "same_location", prob: str = "location_probability", log_km: str = "log_distance") -> Column:
    return (F.col(same) > 0) | (F.col(prob) > 0.10) | (F.col(log_km) < F.log1p(F.lit(50.0)))


def positives_per_pool(pool: DataFrame, q: str = "query_id", label: str = "label") -> DataFrame:
    """(query, positives, size): relevant rows of each pool, and its rows, as a ranker takes its groups."""
    return pool.groupBy(q).agg(F.sum(label).cast("long").alias("positives"), F.count(F.lit(1)).alias("size"))


def bounded_positives(rows: DataFrame, q: str = "query_id", item: str = "item_id", least: int = 1, most: int = 15) -> DataFrame:
    """(query, n): queries with at least `least` and at most `most` different relevant items."""
    return rows.groupBy(q).agg(F.count_distinct(item).alias("n")).where(F.col("n").between(least, most))


def class_index(items: DataFrame, classes: DataFrame, cls: str = "class", item: str = "item_id") -> DataFrame:
    """(item, index) of classes (class, index): -1 for items of no class or an unknown one."""
    return items.select(item, cls).join(classes.select(cls, "index"), cls, "left").select(item, F.coalesce("index", F.lit(-1)).cast("long").alias("index"))


def label(pool: DataFrame, truth: DataFrame, q: str = "query_id", item: str = "item_id") -> DataFrame:
    """pool with `label` (1 where the pair is in the truth), every row kept. Few pairs of the truth go to the pool's rows."""
    t, _ = small(truth.select(q, item).distinct().withColumn("__t", F.lit(1)))
    return pool.join(t, [q, item], "left").withColumn("label", F.coalesce("__t", F.lit(0)).cast("long")).drop("__t")


def known_by_text(pool: DataFrame, clicks: DataFrame, text: str = "text", search: str = "search_location", q: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, item, rank) of a pool's items that clicks (text, search_location, item) know for the query's text: those
    clicked from the query's place, and those whose geography is compatible. pool has text, search_location, rank and the
    features that compatible_geography() reads."""
    c = clicks.select(text, item, F.col(search).alias("__from")).distinct()
    j = pool.join(c, [text, item])
    near = F.coalesce(F.col("__from") == F.col(search), F.lit(False)) | F.coalesce(compatible_geography(), F.lit(False))
    return j.where(near).select(q, item, "rank").distinct()
